import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from switchback.llm import alignment
from switchback.llm import textcore as tc

from .conftest import AWKWARD, prose

ODD = ["a", " ", "  a", "a ", "a  b", " a b", "a\nb", "a \n b", "it's don't I'll", "x1 22 3,4", "<|endoftext|> a<|endoftext|>", "<s> a</s>", "▁ a", "a▁ b", "a ▁b", "a  b", "a  b", "  a", "a 　 b", "日本 語 テ", "é è ü", "\x00\x1f a", "a\x1c b", "a\r\n b\t c", "🙂 🙂🙂", "<0x41> b", "<unk> b", "ﬁ ½", "é e", "x" * 400]


@pytest.fixture(scope="module")
def it():
    return alignment.Aligner(alignment.default_tokenizer(), alignment.default_model())


def tokens(it, text):
    """(A ids, B ids) by the libraries over the whole text; none if the bytes differ."""
    a = it.a.encode(" " + text, add_special_tokens=False).ids
    b = it.b.encode(text)
    want = (" " + text).encode()
    ok = text and b"".join(it.bytes_a[i] for i in a) == want == b"".join(it.bytes_b[i] for i in b)
    return (a, b) if ok else ([], [])


def by_definition(it, texts):
    rows, corpus = [], Counter()
    for t in texts:
        a, b = tokens(it, t or "")
        ends_a = dict(zip(np.cumsum([len(it.bytes_a[i]) for i in a]).tolist(), range(len(a)), strict=True)) if a else {}
        ends_b = dict(zip(np.cumsum([len(it.bytes_b[i]) for i in b]).tolist(), range(len(b)), strict=True)) if b else {}
        links, told, x, y = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[e], ends_b[e]
            links.append((a[i], b[j]))
            told.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        corpus.update(links)
        rows.append((len(a), len(b), len(told), links, hashlib.sha256(";".join(told).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, g, len(links), sum(corpus[p] == best[p[1]] for p in links), sum(corpus[p] for p in links), sha) for n_a, n_b, g, links, sha in rows]


def test_units_are_the_whole_text_s_tokens(it):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice([" ", " ", "\n", "a", "é", "1", "'s", "▁", " ", "<", "日", "."]) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    want = [r[:3] + r[6:] for r in by_definition(it, texts)]
    for _ in range(2):  # the second time from the cache
        per, sha, _ = it.align(*tc.column_bytes(pa.array([" " + t for t in texts])))
        assert [(*p, s) for p, s in zip(per.tolist(), sha, strict=True)] == want


def test_a_full_cache_changes_nothing(it, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 5)
    rng = random.Random(6)
    for _ in range(20):
        t = prose(rng, 12)
        per, sha, _ = it.align(*tc.column_bytes(pa.array([" " + t])))
        assert (*per[0].tolist(), sha[0]) == (lambda r: (r[0], r[1], r[2], r[6]))(by_definition(it, [t])[0])
    it.clear()


@pytest.mark.parametrize("postings", [1 << 20, 50])
def test_query_equals_the_definition(spark, make_docs, folder, it, monkeypatch, postings):
    monkeypatch.setattr(alignment, "POSTINGS", postings)  # few: parts are split by salt
    monkeypatch.setattr(alignment, "HOLD", postings)
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(60)] + ODD + ["the the the of"] * 12 + ["a " * 70_000]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + AWKWARD
    folder.write("documents", make_docs(rows).repartition(5))
    got = alignment.op12_alignment(spark, folder.path)
    assert got.columns == ["doc_id", *alignment.STATS]
    want = by_definition(it, [r[1] for r in rows])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_names_and_empty_table(spark):
    docs = spark.createDataFrame([("of the", 1, "s", 2.0)], "text string, n_links int, row string, part double")
    got = alignment.align(docs)
    assert got.columns == ["row", "part", *alignment.STATS]
    assert got.first().n_links == 2
    assert alignment.align(docs.where("false")).count() == 0
