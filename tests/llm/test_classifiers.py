import random
import tracemalloc

import numpy as np
import pyarrow as pa

from switchback.llm import language_id, licences, toxicity
from switchback.llm import textcore as tc
from switchback.llm.store import Workspace

from .conftest import AWKWARD, prose


def model_of(spark, texts):
    rows = spark.createDataFrame([("xx", t) for t in texts], "lang string, text string")
    return language_id.models(language_id.gram_counts(rows))["xx"]


KN_TEXTS = ["the cat sat on the mat", "that hat", "a cat at the hat", "the cattle"] * 3


def brute_kneser_ney(texts, context, symbol, alphabet, order=language_id.ORDER, discount=language_id.DISCOUNT):
    """Interpolated Kneser-Ney by its definition, on strings."""
    grams = [set() for _ in range(order + 1)]
    count = {}
    for t in texts:
        x = " " * (order - 1) + t
        for k in range(order - 1, len(x)):
            g = x[k - order + 1 : k + 1]
            count[g] = count.get(g, 0) + 1
    counts = {order: count}
    for m in range(order - 1, 0, -1):
        counts[m] = {}
        for g in counts[m + 1]:
            counts[m][g[1:]] = counts[m].get(g[1:], 0) + 1
    p = 1 / alphabet
    for m in range(1, order + 1):
        ctx = context[len(context) - m + 1 :] if m > 1 else ""
        own = {g: c for g, c in counts[m].items() if g[:-1] == ctx}
        if own:
            total = sum(own.values())
            p = max(own.get(ctx + symbol, 0) - discount, 0) / total + discount * len(own) / total * p
    return p


def test_kneser_ney_equals_its_definition_and_sums_to_one(spark):
    m = model_of(spark, KN_TEXTS)
    alphabet = sorted(set("".join(KN_TEXTS)))
    for context in ("    ", "   t", " the", "at t", "zqxj"):
        total = 0.0
        for c in alphabet:
            h = tc.prefix_hash(np.array([ord(x) for x in context + c], np.uint32))
            p = float(np.exp(m.log_prob(h, np.array([len(context) + 1]), len(alphabet)))[0])
            assert abs(p - brute_kneser_ney(KN_TEXTS, context, c, len(alphabet))) < 1e-6
            total += p
        assert abs(total - 1) < 1e-5


def test_a_cut_model_still_sums_to_one(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["the cat sat on the mat and the dog in the rain " + prose(rng, 30) for _ in range(20)]
    whole = model_of(spark, texts)
    monkeypatch.setattr(language_id, "KEEP", 60)
    cut = model_of(spark, texts)
    assert len(cut.gram[5]) < len(whole.gram[5]) / 4 and 30 < len(cut.gram[5]) < 100
    alphabet = sorted(set("".join(texts)))
    for context in (" the", "ing ", " and", "    ", "zqxj"):
        p = [float(np.exp(cut.log_prob(tc.prefix_hash(np.array([ord(x) for x in context + c], np.uint32)), np.array([5]), len(alphabet)))[0]) for c in alphabet]
        assert abs(sum(p) - 1) < 1e-5


def test_a_language_whose_n_grams_are_equally_rare_keeps_a_model(spark, monkeypatch):
    monkeypatch.setattr(language_id, "KEEP", 50)
    signs = "".join(chr(0x4E00 + k) for k in range(200))
    rows = [("xx", signs), *[("en", "the cat and the dog " * 3)] * 5]
    got = language_id.models(language_id.gram_counts(spark.createDataFrame(rows, "lang string, text string")))
    assert set(got) == {"en", "xx"} and 20 < len(got["xx"].gram[1]) < 100
    model = language_id.Identifier(got)
    docs = spark.createDataFrame([(signs[20:60], 1, "a", "b"), ("the dog", 2, "a", "b")], "text string, score int, __text string, row string")
    out = language_id.identify(docs, model)
    assert out.columns == ["__text", "row", "lang_pred", "score", "cross_entropy", "rejected"]
    assert [r.lang_pred for r in out.collect()] == ["xx", "en"]


def test_counts_of_a_model_cover_all_texts(spark):
    """Counts grow with the labelled rows, whatever their number."""
    rows = lambda n: spark.createDataFrame([("xx", f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}") for k in range(n)], "lang string, text string")
    few, many = (language_id.gram_counts(rows(n)).agg({"n": "sum"}).first()[0] for n in (100, 5000))
    assert few == 300 and many == 15_000


def task_counts_of(batches):
    """(counts by language and n-gram, rows of each batch) of the task that `gram_counts` runs."""
    got, sizes = {}, []
    for out in language_id.task_counts(batches):
        sizes.append(out.num_rows)
        for lang, gram, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[lang, gram] = got.get((lang, gram), 0) + n
    return got, sizes


def brute_counts(rows):
    want = {}
    for lang, text in rows:
        x = "    " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" "))
        while "     " in x[4:]:
            x = x[:4] + x[4:].replace("  ", " ")
        for k in range(4, len(x)):
            want[lang, x[k - 4 : k + 1]] = want.get((lang, x[k - 4 : k + 1]), 0) + 1
    return want


def test_a_task_counts_all_n_grams_whatever_it_holds(monkeypatch):
    """Alphabets and counts that are full are sent, and small batches leave a task; nothing is lost or counted twice."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 30)) for _ in range(60)] + ["\u65e5\u672c\u8a9e \U00010428\u00e9\u00df\u0434", "", "".join(chr(0x4E00 + k) for k in range(300))]
    rows = [("en" if k % 3 else "fr", t) for k, t in enumerate(texts)]
    batches = [pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows[k : k + 7]], "text": [t for _, t in rows[k : k + 7]]}) for k in range(0, len(rows), 7)]
    want = brute_counts(rows)
    assert task_counts_of(batches)[0] == want
    for name, value in (("SENT", 50), ("FLUSH", 100), ("SYMBOL_BITS", 5), ("SYMBOL_BITS", 3)):
        monkeypatch.setattr(language_id, name, value)
        got, sizes = task_counts_of(batches)
        assert got == want and max(sizes) <= 50


def test_a_task_that_counts_takes_little_memory():
    """2.6 million n-grams, nearly all different: some 60 MB, where a list of them as strings took 400."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, x)) for x in rng.integers(97, 123, (26, 100_000))]
    batches = [pa.RecordBatch.from_pydict({"lang": ["xx"], "text": [t]}) for t in texts]
    list(language_id.task_counts(batches[:1]))  # tables that are made once
    tracemalloc.start()
    total = sum(int(b.column(2).to_numpy().sum()) for b in language_id.task_counts(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 2_600_000 and peak < 120e6


def test_languages(spark, make_docs, folder):
    rng = random.Random(2)
    lo, hi = [w for w in ("alpha bravo delta gamma zeta theta omega sigma").split()], [w for w in ("ubo wiku xyne qorra vypp jumo kizz").split()]
    rows = [(i, prose(rng, 40, lo if i % 2 else hi), "aa" if i % 2 else "bb", "s") for i in range(200)]
    folder.write("documents", make_docs(rows + [(900, None, "aa", "s"), (901, "123 ...", "bb", "s"), (902, "", None, "s")]))
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, folder.path).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values()) and 20 < sum(r.held_out for r in got.values()) < 90


def test_n_grams_beyond_the_broadcast_count_too(spark, make_docs, folder, monkeypatch):
    """Models over the limit of a broadcast, and n-grams over that of their probabilities, give what whole models give."""
    rng = random.Random(5)
    lo, hi = "alpha bravo delta gamma zeta theta omega sigma".split(), "ubo wiku xyne qorra vypp jumo kizz\u0434\U00010400".split()
    rows = [(i, prose(rng, rng.randrange(1, 40), lo if i % 2 else hi), "aa" if i % 2 else "bb", "s") for i in range(120)]
    folder.write("documents", make_docs(rows + [(0, rows[0][1], "bb", "s"), (900, None, "aa", "s"), (901, "123 ...", "bb", "s"), (None, "delta ubo", None, "s")]))
    run = lambda: sorted(tuple(-1 if v is None else v for v in r) for r in language_id.op1_language_id(spark, folder.path).collect())
    want = run()
    monkeypatch.setattr(language_id, "KEEP", 60)
    monkeypatch.setattr(language_id, "PART_GRAMS", 200)
    for most in (1 << 22, 600, 0):
        monkeypatch.setattr(language_id, "CACHED", most)
        got = run()
        assert len(got) == len(want) == 124
        for a, b in zip(got, want, strict=True):
            assert a[:3] == b[:3] and a[5] == b[5] and abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) < 1e-6


def test_languages_without_labels(spark, make_docs):
    docs = make_docs([(i, t, None, s) for i, t, _, s in AWKWARD])
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == len(AWKWARD)
    assert language_id.identify(make_docs([]), language_id.train(make_docs([]))).count() == 0


def score(text, stems=None):
    return toxicity.clause_features(toxicity.Lexicon(stems or {}), *tc.column_bytes(pa.array([text])))[0]


def test_grammar_weighs_clauses():
    plain = score("what an idiot")[0]
    assert score("you are an idiot")[0] > plain
    assert score("not an idiot")[0] < plain and score("she said idiot")[0] < score("she is an idiot")[0]
    assert score("I will kill you")[0] > 0 and score("I will kill the lights")[0] == 0
    assert score("idiot. Idiot!")[0] == 0 and score("an idiot. what an idiot")[2] == 2 and score("idiotic")[0] == 0
    assert score("idiot that is")[0] == plain and score("idiot, you")[0] == 1.5 * plain
    assert score("a zorblatt", {"zor": 3.0})[0] == 3.0 and score("zorblatt", {"zor": 3.0})[0] == 0 and score("")[0] == 0


def test_composition_is_the_product():
    """The composed table agrees with running the machines side by side."""
    machines = [toxicity.Machine(0, s) for s in (toxicity._insult, toxicity._negation, toxicity._report, toxicity._target, toxicity._threat)]
    rng = random.Random(1)
    for _ in range(300):
        roles, tail = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))], rng.randrange(3)
        states, want, held = [0] * 5, 0.0, 0.0
        for r in roles + [toxicity.O] * tail:
            got = [m.step(s, r) for m, s in zip(machines, states)]
            want += np.prod([g[3] for g in got]) * held
            held = 2.0 if r == toxicity.I and states[0] == 0 else 0.0
            want += np.prod([g[1] for g in got]) * 2.0 if r == toxicity.I else sum(g[2] for g in got)
            states = [g[0] for g in got]
        assert abs(toxicity.clause_score(roles, [0] * len(roles), [2.0] * len(roles), tail) - want) < 1e-9


def test_toxicity_learns_stems(spark, make_docs, folder):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                t[rng.randrange(60)] = "zuvlak" + rng.choice(("e", "en", "ung"))
        rows.append((i, " ".join(t), "xx", "s"))
        labels.append((i, 1, int(bad)))
    folder.write("documents", make_docs(rows + [(5000, None, "xx", "s"), (5001, "", "xx", "s")]))
    folder.write("labels", spark.createDataFrame(labels + [(7000, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, folder.path).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
    kept = toxicity.pipeline_stage(spark, spark.read.parquet(f"{folder.path}/documents.parquet"), folder.path)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.train(make_docs(AWKWARD), empty, Workspace(spark, "test"))
    assert m.stems == {} and toxicity.score(make_docs(AWKWARD), m).count() == len(AWKWARD)


def test_licences(spark, make_docs):
    rng = random.Random(9)
    texts = {1: "Released under the MIT License.", 2: prose(rng, 80) + "\nLicensed under CC BY-NC 4.0.\n" + prose(rng, 20), 3: prose(rng, 200), 4: "This work is licensed under the GNU General Public License, version 3.", 5: prose(rng, 90) + " licensed under the apache license version 2 0 " + prose(rng, 90), 6: "He lost his driving license under the bridge."}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()] + [(100 + a[0] if a[0] else None, *a[1:]) for a in AWKWARD])
    got = {r.doc_id: r for r in licences.scan(docs, licences.train(docs)).collect()}
    assert [got[i].licences for i in (1, 2, 3, 4, 5, 6)] == [["MIT"], ["CC-BY-NC"], [], ["GPL"], ["Apache"], []]
    assert licences.scan(make_docs([]), licences.train(make_docs([]))).count() == 0
