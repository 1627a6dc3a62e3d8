"""Toxicity (operator 8): a weighted finite-state grammar over clauses.

Words are mapped to roles: insult (with a weight), threat, target, negation, report.
Five small transducers read a clause's roles: insult emits once the insult stands with
other words, at once inside a clause and with the next word at its start; target
strengthens an insult near a target; threat fires when it meets a target; negation and
reported speech weaken. They are composed (product of states, weights multiplied) into
one table, and the sum over a clause is its score. A word that is a clause by itself
scores nothing, whatever it is.

The insult lexicon is a seed list plus stems learned from labelled rows: prefixes of
words that occur in toxic texts and hardly in others, chosen by a greedy cover of the
toxic texts, so that the words of one copied text don't enter. The text score is a
logistic function of its clause scores. Learning takes at most TOXIC_SAMPLE toxic and
CLEAN_SAMPLE other labelled rows, by hash, of those whose crc32(doc_id) mod 4 is not 2.

Defined cases: null, empty and word-less texts score like texts without a match;
repeated rows are scored each; without labels of both kinds the defaults hold; a null
doc_id is never held out and never learned from; of several labels of one doc_id the
highest counts; an empty table gives no rows. Texts of any length are scored whole. The
score is a probability under the labels' own share of toxic texts: where that is over
THRESHOLD, a text without a match is over it, too, and the pipeline's stage keeps nothing.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import Workspace

TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 6000
THRESHOLD = 0.3
PREFIXES = range(3, 10)
LEAST_ODDS = 1.8  # log of how much more often a stem is in toxic texts
COVER = 4  # times that each toxic text is to be covered
SEED_WEIGHT = 2.0

INSULTS = "idiot idiots moron morons stupid pathetic worthless trash scum loser losers clown clowns disgusting dumb imbecile filth vermin coward freak dummkopf idioten abschaum wertlos widerlich dumm crétin imbécile ordure minable idiota estúpido estúpida imbécil basura escoria inútil asqueroso".split()
THREATS = "kill hurt destroy beat burn stab shoot crush töten schlagen zerstören verbrennen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself u he him she her they them du dich dir dein ihr euch toi tu te vous votre tú usted ustedes vosotros".split()
NEGATIONS = "not never isn't aren't nicht kein keine niemals jamais nunca jamás".split()
REPORTS = "said says claimed claims quoted wrote reported alleged called sagte behauptete schrieb déclaré affirmé dijo escribió afirmó".split()

O, I, T, G, N, R = range(6)  # noqa: E741  other, insult, threat, target, negation, report


class Machine:
    """A weighted transducer over roles: step(state, role) gives (state, factor of an insult, emission, release).

    release is the factor at which an insult that was held back, at the clause's start, is emitted now.
    """

    def __init__(self, start, step):
        self.start, self.step = start, step


def _insult(s, role):
    """States: 0 at the start, 1 after an insult there, 2 inside the clause."""
    return (1 if role == I and not s else 2), (1.0 if s else 0.0), 0.0, (1.0 if s == 1 else 0.0)


def _negation(s, role):
    weak = 0.4 if role == I and s else 1.0
    return (2 if role == N else max(0, s - 1)), weak, 0.0, 1.0


def _report(s, role):
    return (1 if role == R else s), (0.5 if role == I and s else 1.0), 0.0, 1.0


def _target(s, role):
    return (3 if role == G else max(0, s - 1)), (1.5 if role == I and s else 1.0), 0.0, (1.5 if role == G else 1.0)


def _threat(s, role):
    fires = 1.5 if role == G and s else 0.0
    return (3 if role == T else 0 if fires else max(0, s - 1)), 1.0, fires, 1.0


def compose(*machines: Machine):
    """Product of machines as tables next, factor, emission, release by [state, role]; state 0 is the start."""
    index = {tuple(m.start for m in machines): 0}
    todo, rows = [next(iter(index))], []
    while todo:
        s = todo.pop(0)
        row = []
        for role in range(6):
            got = [m.step(x, role) for m, x in zip(machines, s, strict=True)]
            to = tuple(g[0] for g in got)
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append((index[to], math.prod(g[1] for g in got), sum(g[2] for g in got), math.prod(g[3] for g in got)))
        rows.append(row)
    t = np.array(rows)
    return t[:, :, 0].astype(int).tolist(), t[:, :, 1].tolist(), t[:, :, 2].tolist(), t[:, :, 3].tolist()


NEXT, FACTOR, EMIT, RELEASE = compose(Machine(0, _insult), Machine(0, _negation), Machine(0, _report), Machine(0, _target), Machine(0, _threat))


def clause_score(roles: list[int], gaps: list[int], weights: list[float], tail: int = 0) -> float:
    """Score of a clause's words that have a role; gaps are the other words before each, tail those after the last."""
    state, total, held = 0, 0.0, 0.0
    for role, gap, w in zip([*roles, O], [*gaps, tail], [*weights, 0.0], strict=True):
        for _ in range(min(gap, 4)):
            total += RELEASE[state][O] * held
            held = 0.0
            state = NEXT[state][O]
        if role == O:
            break
        total += RELEASE[state][role] * held
        held = w if role == I and state == 0 else 0.0
        total += FACTOR[state][I] * w if role == I else EMIT[state][role]
        state = NEXT[state][role]
    return total


class Lexicon:
    """Roles of words: exact words, then learned stems (prefix -> weight; '$' ends a whole word)."""

    def __init__(self, stems: dict[str, float]):
        self.exact = {w: (r, 0.0) for r, ws in ((R, REPORTS), (N, NEGATIONS), (G, TARGETS), (T, THREATS)) for w in ws}
        self.exact |= {w: (I, SEED_WEIGHT) for w in INSULTS}
        self.stems = stems
        self.memo = tc.Memo(20)

    def role(self, word: str) -> tuple[int, float]:
        learned = max([self.stems.get(word + "$", 0.0), *(self.stems.get(word[:k], 0.0) for k in PREFIXES if k <= len(word))])
        role, w = self.exact.get(word, (O, 0.0))
        if learned and (role == O or learned > w):
            return I, max(learned, w)
        return role, w

    def roles(self, w: tc.Words) -> tuple[np.ndarray, np.ndarray]:
        val, miss = self.memo.get(w.hash)
        if miss.any():
            at = np.flatnonzero(miss)
            u, rep, inv = np.unique(w.hash[at], return_index=True, return_inverse=True)
            got = np.array([r + 8 * round(x * 1000) for r, x in (self.role(w.text(k)) for k in at[rep].tolist())], np.int64)
            self.memo.put(u, got)
            val[at] = got[inv]
        return val & 7, (val >> 3) / 1000


_BREAKS = [ord(c) for c in ".!?;:\n|"]


def clause_features(lex: Lexicon, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(sum of clause scores, best clause, clauses matched) of each text."""
    w = tc.Words(data, off)
    out = np.zeros((len(off) - 1, 3))
    role, weight = lex.roles(w)
    hot = np.unique(w.doc[(role == I) | (role == T)])
    if not len(hot):
        return out
    at = np.flatnonzero(role)
    at = at[np.isin(w.doc[at], hot)]
    every = np.cumsum(np.isin(w.low, _BREAKS))[w.start]
    begin = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (w.doc[1:] != w.doc[:-1])]))
    own = np.searchsorted(begin, at, "right") - 1  # the clause of each word that has a role
    clause, doc = own, w.doc[at]
    stop = np.append(begin[1:], len(every))[own]
    cut = np.flatnonzero(np.concatenate([[True], (clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])]))
    first = np.zeros(len(at), bool)
    first[cut] = True
    gap = np.where(first, at - begin[own], np.diff(at, prepend=at[:1]) - 1)
    r, g, x, left = role[at].tolist(), gap.tolist(), weight[at].tolist(), (stop - at - 1).tolist()
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        s = clause_score(r[a:b], g[a:b], x[a:b], left[b - 1])
        if s > 0:
            row = out[doc[a]]
            row[0] += s
            row[1] = max(row[1], s)
            row[2] += 1
    return out


def _inputs(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), np.log1p(f[:, 0]), np.log1p(f[:, 1]), np.log1p(f[:, 2])])


def fit(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = _inputs(features)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - toxic)) + 0.05 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


DEFAULT = np.array([-3.0, 3.0, 0.5, 0.5])


def _features_of_words(words: set[str]) -> set[str]:
    out = {w + "$" for w in words}
    for w in words:
        out.update(w[:k] for k in PREFIXES if k <= len(w))
    return out


def _word_sets(col):
    for i, j, data, off in tc.chunks(col):
        w = tc.Words(data, off)
        for k in range(j - i):
            lo, hi = w.first[k], w.first[k + 1]
            _, rep = np.unique(w.hash[lo:hi], return_index=True)
            yield {w.text(x) for x in (lo + rep).tolist()}


def learn_stems(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems and weights from the sample (text, toxic)."""
    least = max(3, math.ceil(0.01 * n_toxic))

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for words in _word_sets(b.column(0)):
                c.update(_features_of_words(words))
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    tox = sample.where("toxic = 1").select("text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    a = {r.f: r.n for r in tox.orderBy(F.desc("n"), "f").toLocalIterator()}  # of TOXIC_SAMPLE texts at most
    names = sample.sparkSession.sparkContext.broadcast(list(a))

    def match(batches):
        at = {f: k for k, f in enumerate(names.value)}
        docs, tox, no = [], [], []
        clean: Counter = Counter()
        for b in batches:
            for t, key, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), _word_sets(b.column(0)), strict=True):
                hit = [at[f] for f in _features_of_words(words) if f in at]
                if t:
                    docs.append(key)
                    no.append(hit)
                else:
                    clean.update(hit)
        docs.append(None)
        no.append([x for k, n in clean.items() for x in (k, n)])
        yield pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.int64()), "hits": pa.array(no, pa.list_(pa.int32()))})

    b = np.zeros(len(a))
    sets: list[list[int]] = []
    n = np.array(list(a.values()), float)
    rows = sample.select("text", "toxic", "doc_id").mapInArrow(match, "doc long, hits array<int>").collect()
    for r in rows:
        if r.doc is None:
            x = np.array(r.hits, np.int64).reshape(-1, 2)
            b[x[:, 0]] += x[:, 1]
        else:
            sets.append(r.hits)
    odds = np.log((n + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    good = (odds >= LEAST_ODDS) & (n / n_toxic > 5 * (b + 1) / (n_clean + 1))
    names_ = list(a)
    where = {f: k for k, f in enumerate(names_)}
    for k, f in enumerate(names_):  # a longer stem that keeps the toxic texts and drops others is better; else the shorter
        if good[k] and not f.endswith("$") and len(f) > PREFIXES[0] and (p := where.get(f[:-1])) is not None and good[p]:
            if n[k] >= 0.9 * n[p] and b[k] < b[p]:
                good[p] = False
            elif b[k] >= b[p]:
                good[k] = False
        if good[k] and f.endswith("$") and (p := where.get(f[:-1])) is not None and good[p] and b[k] >= b[p]:
            good[k] = False
    keep = np.flatnonzero(good)
    members: dict[int, set[int]] = {k: set() for k in keep.tolist()}
    for d, s in enumerate(sets):
        for k in s:
            if k in members:
                members[k].add(d)
    left = np.full(len(sets), COVER)
    out: dict[str, float] = {}
    # gains only fall, so a candidate whose gain is still the highest after a new count is the best
    heap = [(-len(m), -odds[k], names_[k], k) for k, m in members.items()]
    heapq.heapify(heap)
    while heap:
        _, _, name, k = heapq.heappop(heap)
        gain = sum(left[d] > 0 for d in members[k])
        if gain < least:
            continue
        entry = (-gain, -odds[k], name, k)
        if heap and entry > heap[0]:
            heapq.heappush(heap, entry)
            continue
        out[name] = float(min(odds[k], 6.0) / 2)
        for d in members[k]:
            left[d] -= 1
    return out


class Model:
    def __init__(self, stems: dict[str, float], beta: np.ndarray):
        self.stems, self.beta = stems, beta


def _held_out(col):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, ws: Workspace) -> Model:
    """Learn stems and calibration from a bounded sample of labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.where(F.col("toxic").isin(0, 1))
    total = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return Model({}, DEFAULT)
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = lab.where("toxic = 1").orderBy(*order).limit(TOXIC_SAMPLE).unionByName(lab.where("toxic = 0").orderBy(*order).limit(CLEAN_SAMPLE))
    sample = ws.write(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id"), "sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, DEFAULT)
    stems = learn_stems(sample, n[1], n[0])
    rows = _features(sample.select("toxic", "text"), stems).collect()  # as many as the sample at most
    f = np.array([[r.total, r.best, r.clauses] for r in rows])
    y = np.array([r.toxic for r in rows], float)
    weight = np.where(y == 1, total[1] / n[1], total[0] / n[0])
    return Model(stems, fit(f, y, weight * len(y) / weight.sum()))


_lexicons: dict[int, Lexicon] = {}


def _features(df: DataFrame, stems: dict[str, float]) -> DataFrame:
    """Replace `text`, the last column, by the clause features."""
    shared = df.sparkSession.sparkContext.broadcast(stems)
    key = hash(tuple(sorted(stems.items())))

    def run(batches):
        tc.claim(_lexicons)
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(shared.value)
        lex = _lexicons[key]
        for b in batches:
            f = np.zeros((b.num_rows, 3))
            for i, j, data, off in tc.chunks(b.column(b.num_columns - 1)):
                f[i:j] = clause_features(lex, data, off)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(b.num_columns - 1)] + [pa.array(f[:, k]) for k in range(3)], names=[*b.schema.names[:-1], "total", "best", "clauses"])

    return df.mapInArrow(run, df.drop("text").schema.add("total", "double").add("best", "double").add("clauses", "double"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, clauses) of every row."""
    b = [float(x) for x in model.beta]
    z = F.lit(b[0]) + b[1] * F.log1p("total") + b[2] * F.log1p("best") + b[3] * F.log1p("clauses")
    return _features(docs.select("doc_id", "text"), model.stems).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "clauses")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "toxicity"))
    s = score(docs, model)
    return s.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score is under the threshold; columns are untouched."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "pipeline-toxicity"))
    b = [float(x) for x in model.beta]
    shared = spark.sparkContext.broadcast(model.stems)
    key = hash(tuple(sorted(model.stems.items())))
    at = docs.columns.index("text")

    def run(batches):
        tc.claim(_lexicons)
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(shared.value)
        lex = _lexicons[key]
        for x in batches:
            f = np.zeros((x.num_rows, 3))
            for i, j, data, off in tc.chunks(x.column(at)):
                f[i:j] = clause_features(lex, data, off)
            yield x.filter(pa.array(1 / (1 + np.exp(-(_inputs(f) @ b))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
