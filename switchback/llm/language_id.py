"""Language ID (operator 1): interpolated Kneser-Ney character models, one a language.

Text is lower-cased letters with runs of anything else as one space. Per language, the
models of orders 1 to ORDER are kept as sorted hash arrays: n-gram -> discounted
probability, context -> weight of the lower order. A text's score under a language is
its cross-entropy per character; the lowest wins. The score is a softmax whose slope, and
the rejection limit of each language, are calibrated on texts left out of the models.
Scored n-grams are looked up through a bounded worker cache.

Counts come from all labelled texts outside the held-out fold, in every language that has
one, so what is gathered grows with the corpus: tasks count their n-grams of the highest
order as numbers of 64 bits, in bounded memory (see `Counts`), and Spark adds them up; lower
orders follow from the distinct ones. No n-gram is left out. Models of at most KEEP n-grams an order and language are broadcast whole. Larger ones
stay tables: they are dealt over parts by the two symbols before an n-gram's last, which all
its orders from three share (the few of orders one and two go to every part), and the distinct
n-grams of the texts meet them there, with the same arrays and sums as in a broadcast. Of the
probabilities found, the most frequent n-grams' (CACHED numbers) are broadcast; texts get those
of all other n-grams by a join. Only calibration uses a bounded sample, CALIBRATION texts a
language of a sixteenth of the labelled rows.

Defined cases: null texts and texts without a letter are 'und' with score 0; empty tables
and tables without labels predict 'und'; ties go to the first language by name; repeated
rows are predicted each. Whole texts are scored, whatever their length. Other columns of any
name stay, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from . import textcore as tc
from .store import Workspace, small_batches

ORDER = 5
CALIBRATION = 80
KEEP = 150_000  # n-grams of an order and language in a model that is broadcast
PART_GRAMS = 1 << 17  # n-grams of a part of models that are tables
FLUSH = 1 << 20  # distinct n-grams that a task adds up before it sends them
SENT = 1 << 16  # rows of a batch of counts
SYMBOL_BITS = 12  # so that ORDER symbols fit 64 bits
DISCOUNT = 0.75
REJECT_QUANTILE = 0.999
MARGIN = 1.15
CACHED = 1 << 22  # probabilities in a worker's cache or a broadcast: n-grams times languages
_PAD = ORDER - 1
_DOUBLES = ArrayType(DoubleType())
_workers: dict[str, tuple] = {}


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): lower-cased letters, one space a gap, ORDER - 1 spaces before each text."""
    cps, at = tc.decode(data, off)
    alpha = tc.is_alpha(cps)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    keep[at[:-1][at[:-1] < len(cps)]] = alpha[at[:-1][at[:-1] < len(cps)]]
    sym = np.where(alpha, tc.lower(cps), 32)[keep]
    count = np.concatenate([[0], np.cumsum(keep)])[at]
    n = len(off) - 1
    out = np.full(len(sym) + n * _PAD, 32, np.uint32)
    out[np.arange(len(sym)) + np.repeat(_PAD * np.arange(1, n + 1), np.diff(count))] = sym
    return out, count + _PAD * np.arange(n + 1)


def scored_ends(off: np.ndarray) -> np.ndarray:
    """Position after each symbol that is scored: all but the first ORDER - 1 of a text."""
    at = np.arange(off[-1])
    return at[at - np.repeat(off[:-1], np.diff(off)) >= _PAD] + 1


def gram_hashes(sym: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position after each scored symbol, hash of its ORDER-gram, prefix hashes)."""
    end, h = scored_ends(off), tc.prefix_hash(sym)
    return end, tc.span_hash(h, end - ORDER, end), h


def _strings(sym: np.ndarray) -> pa.Array:
    """Rows of code points as strings, without a Python string a row."""
    data = sym.astype("<u4").tobytes().decode("utf-32-le").encode()
    size = (1 + (sym > 0x7F) + (sym > 0x7FF) + (sym > 0xFFFF)).sum(axis=1)
    return pa.StringArray.from_buffers(len(sym), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data))


class Counts:
    """A task's n-grams of order ORDER by language, exact: each is one number, of its symbols' places in an alphabet.

    An n-gram takes 16 bytes here. More than FLUSH distinct ones, or an alphabet of more than
    2 ** SYMBOL_BITS symbols, are sent before the next are taken; Spark adds up what is sent twice.
    """

    def __init__(self):
        self.place = np.zeros(0x110000, np.uint16)  # of a symbol in the alphabet, from 1
        self.symbols, self.used = np.zeros(1 << SYMBOL_BITS, np.uint32), 0
        self.raw: dict[str, list] = {}
        self.held: dict[str, tuple] = {}
        self.waiting = 0

    def learn(self, sym: np.ndarray) -> bool:
        """Add symbols to the alphabet, if it has room for them all."""
        new = np.unique(sym[self.place[sym] == 0])
        upto = self.used + len(new)
        if upto > len(self.symbols):
            return False
        self.symbols[self.used : upto] = new
        self.place[new] = np.arange(self.used + 1, upto + 1)
        self.used = upto
        return True

    def add(self, lang: str, sym: np.ndarray, end: np.ndarray):
        """Count the n-grams before each `end`; yields batches of what had to be sent."""
        todo = [(0, len(end))] if len(end) else []
        while todo:
            a, b = todo.pop()
            part = sym[end[a] - ORDER : end[b - 1]]
            if self.learn(part):
                c = self.place[part].astype(np.uint64) - np.uint64(1)
                code = c[: len(c) - ORDER + 1].copy()
                for k in range(1, ORDER):
                    code <<= np.uint64(SYMBOL_BITS)
                    code |= c[k : len(code) + k]
                self.raw.setdefault(lang, []).append(code[end[a:b] - end[a]])
                self.waiting += b - a
            elif self.used:
                yield from self.flush()
                todo.append((a, b))
            else:  # more symbols than an alphabet has: some n-grams at a time
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        if self.waiting >= FLUSH:
            self.merge()
            if sum(len(code) for code, _ in self.held.values()) >= FLUSH:
                yield from self.flush()

    def merge(self) -> None:
        for lang, parts in self.raw.items():
            code = np.concatenate(parts)
            parts.clear()
            code.sort()
            cut = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            code, n = code[cut], np.diff(np.append(cut, len(code)))
            if lang in self.held:
                old, count = self.held[lang]
                at = np.searchsorted(old, code)
                has = old[np.minimum(at, len(old) - 1)] == code
                count[at[has]] += n[has]
                code, n = np.insert(old, at[~has], code[~has]), np.insert(count, at[~has], n[~has])
            self.held[lang] = code, n
        self.raw, self.waiting = {}, 0

    def flush(self):
        """All counts as batches (lang, gram, n) of SENT rows at most; empties the alphabet."""
        self.merge()
        shift = np.uint64(SYMBOL_BITS) * np.arange(ORDER - 1, -1, -1, dtype=np.uint64)
        for lang in list(self.held):
            code, n = self.held.pop(lang)
            for k in range(0, len(n), SENT):
                grams = _strings(self.symbols[(code[k : k + SENT, None] >> shift) & np.uint64((1 << SYMBOL_BITS) - 1)])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(grams)), grams, pa.array(n[k : k + SENT])], names=["lang", "gram", "n"])
        self.place[self.symbols[: self.used]] = 0
        self.used = 0


def task_counts(batches):
    """Batches (lang, gram, n) of a task's (lang, text)."""
    counts = Counts()
    for b in batches:
        langs = b.column(0).to_pylist()
        for lang in sorted(set(langs)):
            for _, _, data, off in tc.chunks(b.column(1).filter(pa.array([x == lang for x in langs]))):
                sym, so = letters(data, off)
                yield from counts.add(lang, sym, scored_ends(so))
    yield from counts.flush()


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): the n-grams of order ORDER of all rows (lang, text), as strings."""
    counts = rows.select("lang", "text").mapInArrow(task_counts, "lang string, gram string, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame, ws: Workspace, name: str = "order") -> dict[int, DataFrame]:
    """(lang, gram, n) by order, from those of the highest one."""
    tables = {}
    for m in range(ORDER, 0, -1):
        tables[m] = ws.write(counts, f"{name}-{m}")
        counts = tables[m].select("lang", F.expr(f"right(gram, {m - 1})").alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    return tables


def weighed(counts: DataFrame, m: int, keep=None, part=None) -> DataFrame:
    """(part, lang, gram, ctx, prob, back), n-grams and contexts as hashes, from (lang, gram, n) of order m.

    keep, if given, says which n-grams stay; what the others weigh goes to `back`.
    """
    marked = counts.withColumn("ctx", F.expr(f"left(gram, {m - 1})")).withColumn("keep", F.lit(True) if keep is None else keep)
    own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0))
    totals = marked.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("keep"), own).otherwise(0.0)).alias("held"))
    kept = marked.where("keep").join(totals, ["lang", "ctx"])

    def hashed(batches):
        for b in batches:
            sym = np.frombuffer("".join(b.column(2).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            h, start = tc.prefix_hash(sym), m * np.arange(b.num_rows)
            n, total, held = (b.column(k).to_numpy().astype(float) for k in (3, 4, 5))
            context = tc.span_hash(h, start, start + m - 1) if m > 1 else np.zeros(len(n), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tc.span_hash(h, start, start + m).view(np.int64)), pa.array(context.view(np.int64)), pa.array((np.maximum(n - DISCOUNT, 0) / total).astype(np.float32)), pa.array((1 - held / total).astype(np.float32))], names=["part", "lang", "gram", "ctx", "prob", "back"])

    part = F.lit(0) if part is None else part
    return kept.select(part.cast("int").alias("part"), "lang", "gram", "n", "total", "held").mapInArrow(hashed, "part int, lang string, gram long, ctx long, prob float, back float")


def models(counts: DataFrame | dict[int, DataFrame], ws: Workspace | None = None) -> dict[str, Model]:
    """Models by language from (lang, gram, n) of the highest order, or of all; more than KEEP n-grams are cut, so `train` asks for none such."""
    if not isinstance(counts, dict):
        ws = ws or Workspace(counts.sparkSession, "language-models")
        counts = orders(counts, ws)
    tables: dict[str, dict[int, tuple]] = {}
    for m, table in counts.items():
        tied = F.pmod(F.xxhash64("gram"), F.lit(1 << 30)) < F.col("share") * float(1 << 30)
        keep = (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & tied)
        rows = ws.write(weighed(table.join(F.broadcast(least_counts(table)), "lang"), m, keep).drop("part"), f"kept-{m}")
        for lang in [r.lang for r in rows.select("lang").distinct().collect()]:
            t = rows.where(F.col("lang") == lang).drop("lang").toArrow()  # about KEEP rows of 24 bytes at most
            tables.setdefault(lang, {})[m] = tuple(t.column(k).to_numpy() for k in range(4))
    return {lang: Model(orders) for lang, orders in sorted(tables.items())}


def near(m: int, parts: int):
    """Part of an n-gram of order m: by the two symbols before its last."""
    return F.pmod(F.xxhash64(F.expr(f"substring(gram, {m - 2}, 2)")), F.lit(parts)).cast("int")


def whole_models(tables: dict[int, DataFrame], parts: int, ws: Workspace) -> DataFrame:
    """(part, lang, gram, ctx, prob, back, m): every n-gram of all models; those of orders one and two in every part."""
    out = None
    for m, table in tables.items():
        rows = weighed(table, m, part=near(m, parts) if m > 2 else None)
        if m <= 2:
            rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = rows.withColumn("m", F.lit(m))
        out = rows if out is None else out.unionByName(rows)
    return ws.write(out, "whole")


def probabilities(texts: DataFrame, model: Identifier, ws: Workspace) -> DataFrame:
    """(gram, ln, n): for each distinct n-gram of order ORDER of the texts its hash, ln p under every language and number."""
    names, alphabet = model.names, model.alphabet
    asked = gram_counts(texts.select(F.lit("").alias("lang"), "text")).select(near(ORDER, model.parts).alias("part"), "gram", "n")

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        k = asked.num_rows
        ln, hashes = np.zeros((k, len(names)), np.float32), np.zeros(k, np.uint64)
        text = asked.column("gram")
        sets = []
        for lang in names if k else ():
            own = rows.filter(pc.equal(rows.column("lang"), lang))
            by = {m: own.filter(pc.equal(own.column("m"), m)) for m in range(1, ORDER + 1)}
            sets.append(Model({m: tuple(t.column(c).to_numpy() for c in ("gram", "ctx", "prob", "back")) for m, t in by.items()}))
        for a in range(0, k, tc.BITE):
            part = text.slice(a, tc.BITE).to_pylist()
            h = tc.prefix_hash(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32))
            end = ORDER * np.arange(1, len(part) + 1)
            hashes[a : a + len(part)] = tc.span_hash(h, end - ORDER, end)
            for c, one in enumerate(sets):
                ln[a : a + len(part), c] = one.log_prob(h, end, alphabet)
        lists = pa.ListArray.from_arrays(pa.array(len(names) * np.arange(k + 1), pa.int32()), pa.array(ln.ravel()))
        return pa.table({"gram": pa.array(hashes.view(np.int64)), "ln": lists, "n": asked.column("n").combine_chunks()})

    met = asked.groupBy("part").cogroup(model.whole.groupBy("part")).applyInArrow(run, "gram long, ln array<float>, n long")
    return ws.write(met, f"probabilities-{uuid.uuid4().hex}")


def least_counts(counts: DataFrame) -> DataFrame:
    """(lang, least, share): all n-grams above the count `least` and this share of those at it are the KEEP most frequent of a language; from a table of counts of counts."""
    of = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("c"))
    of = of.withColumn("upto", F.sum("c").over(W.partitionBy("lang").orderBy(F.desc("n"))))
    cut = F.max(F.when(F.col("upto") > KEEP, F.struct("n", ((F.lit(KEEP) - (F.col("upto") - F.col("c"))) / F.col("c")).alias("share"))))
    return of.groupBy("lang").agg(cut.alias("x")).select("lang", F.coalesce("x.n", F.lit(0)).alias("least"), F.coalesce("x.share", F.lit(1.0)).alias("share"))


class Model:
    """Kneser-Ney model of one language as sorted hash arrays, from (n-gram, context, probability, back-off weight) by order."""

    def __init__(self, orders: dict[int, tuple]):
        self.gram, self.prob, self.ctx, self.back = {}, {}, {}, {}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
        for m in range(1, ORDER + 1):
            gram, ctx, prob, back = orders.get(m, none)
            gram, ctx = gram.view(np.uint64), ctx.view(np.uint64)
            order = np.argsort(gram)
            self.gram[m], self.prob[m] = gram[order], prob[order]
            self.ctx[m], first = np.unique(ctx, return_index=True)
            self.back[m] = back[first]
        self.symbols = len(self.gram[1])

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return at, (keys[at] == h if len(keys) else np.zeros(len(h), bool))

    def log_prob(self, h: np.ndarray, end: np.ndarray, alphabet: int) -> np.ndarray:
        """ln p of the symbols before each `end`, given what precedes them."""
        p = np.full(len(end), 1.0 / alphabet)
        for m in range(1, ORDER + 1):
            ctx = tc.span_hash(h, end - m, end - 1) if m > 1 else np.zeros(len(end), np.uint64)
            at, seen = self._find(self.ctx[m], ctx)
            g, has = self._find(self.gram[m], tc.span_hash(h, end - m, end))
            new = np.where(has, self.prob[m][g] if len(self.prob[m]) else 0, 0) + (self.back[m][at] if len(self.back[m]) else 1) * p
            p = np.where(seen, new, p)
        return np.log(p)


class Identifier:
    """All languages' models with calibration. Models that are too large to hold are in the table `whole`, of so many parts."""

    def __init__(self, models: dict[str, Model] | list[str], symbols: int | None = None, whole: DataFrame | None = None, parts: int = 0):
        self.names = list(models)
        self.models = list(models.values()) if whole is None else []
        self.alphabet = (max([m.symbols for m in self.models], default=0) if symbols is None else symbols) + 64
        self.slope, self.limit = 10.0, np.full(len(self.names), np.inf)
        self.whole, self.parts = whole, parts

    def bare(self) -> Identifier:
        """What `predict` needs."""
        out = Identifier({})
        out.names, out.slope, out.limit = self.names, self.slope, self.limit
        return out

    def entropies(self, data: np.ndarray, off: np.ndarray, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages cross-entropy per symbol, symbols scored per text)."""
        sym, so = letters(data, off)
        end, g, h = gram_hashes(sym, so)
        n = np.diff(so) - _PAD
        out = np.zeros((len(n), len(self.names)))
        if not len(end) or not self.names:
            return out, n
        rows = cache.rows(self, g, h, end)
        has = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[has]
        out[has] = -np.add.reduceat(cache.table[rows], first, axis=0, dtype=np.float64) / n[has, None]
        return out, n

    def predict(self, ent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = ent.argmin(axis=1)
        z = np.exp(-self.slope * (ent - ent.min(axis=1, keepdims=True)))
        return best, (z / z.sum(axis=1, keepdims=True))[np.arange(len(ent)), best], ent.min(axis=1) > self.limit[best]


class Cache:
    """ln p of n-grams under all languages; emptied when full."""

    def __init__(self, languages: int):
        self.memo = tc.Memo(21)
        self.table = np.zeros((max(1 << 12, CACHED // max(languages, 4)), max(languages, 1)), np.float32)
        self.used = 0

    def rows(self, model: Identifier, g: np.ndarray, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        val, miss = self.memo.get(g)
        if miss.any():
            at = np.flatnonzero(miss)
            u, rep, inv = np.unique(g[at], return_index=True, return_inverse=True)
            if self.used + len(u) > len(self.table):
                self.memo.clear()
                self.used = 0
                if len(at) < len(g):
                    return self.rows(model, g, h, end)
                if len(u) > len(self.table):
                    self.table = np.zeros((2 * len(u), self.table.shape[1]), np.float32)
            new = self.used + np.arange(len(u))
            for k, m in enumerate(model.models):
                self.table[new, k] = m.log_prob(h, end[at[rep]], model.alphabet)
            self.used += len(u)
            self.memo.put(u, new)
            val[at] = new[inv]
        return val


class Known:
    """ln p of frequent n-grams under all languages as a sorted table (gram, ln); all others have the last row, of zeros."""

    def __init__(self, rows: pa.Table, languages: int):
        gram = rows.column("gram").to_numpy().view(np.uint64)
        ln = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in rows.column("ln").chunks)]).reshape(-1, languages)
        order = np.argsort(gram)
        self.gram, self.table = gram[order], np.concatenate([ln[order], np.zeros((1, languages), np.float32)])

    def rows(self, g: np.ndarray, memo: tc.Memo) -> np.ndarray:
        val, miss = memo.get(g)
        if miss.any():
            at = np.flatnonzero(miss)
            u, inv = np.unique(g[at], return_inverse=True)
            new = np.full(len(u), len(self.gram))
            if len(self.gram):
                k = np.minimum(np.searchsorted(self.gram, u), len(self.gram) - 1)
                new = np.where(self.gram[k] == u, k, new)
            memo.put(u, new)
            val[at] = new[inv]
        return val


def frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of (gram, ln, n) to broadcast: all if they are `most` at most, else only those more frequent than at least so many leave out."""
    many = table.count()
    if many <= most:
        return table
    return table.where(F.col("n") > table.agg(F.percentile_approx("n", 1 - most / many, 100_000)).first()[0])


def train(docs: DataFrame, ws: Workspace | None = None) -> Identifier:
    """Fit on all rows with a text and a language whose fold is not 2."""
    ws = ws or Workspace(docs.sparkSession, "language-id")
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))).select("doc_id", "lang", "text")
    spare = F.pmod(F.xxhash64("text"), F.lit(16)) == 0
    tables = orders(gram_counts(rows.where(~spare)), ws)
    learned = {r.lang for r in tables[1].select("lang").distinct().collect()}
    rare = [r.lang for r in rows.select("lang").distinct().toLocalIterator() if r.lang not in learned]
    if rare:  # languages whose few rows are all spare
        more = orders(gram_counts(rows.where(F.col("lang").isin(rare))), ws, "rare")
        tables = {m: t.unionByName(more[m]) for m, t in tables.items()}
    each = [t.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).withColumn("m", F.lit(m)) for m, t in tables.items()]
    sizes = functools.reduce(DataFrame.unionByName, each).collect()  # a row an order and language
    if all(r.c <= KEEP for r in sizes):
        model = Identifier(models(tables, ws))
    else:
        parts = -(-sum(r.c for r in sizes) // PART_GRAMS)
        model = Identifier(sorted({r.lang for r in sizes}), max(r.c for r in sizes if r.m == 1), whole_models(tables, parts, ws), parts)
    # a random number under a bound set by the language's count leaves about four times the sample, whatever the table's size
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pool = rows.where(spare).withColumn("draw", draw)
    share = pool.groupBy("lang").agg((F.lit(4.0 * CALIBRATION) / F.count(F.lit(1))).alias("share"))
    some = pool.join(F.broadcast(share), "lang").where("draw < share").select("lang", "draw", "text")
    sample = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))).where(F.col("k") <= CALIBRATION)
    if model.names:
        calibrate(model, sample.select("lang", "text"), ws)
    return model


def scored(rows: DataFrame, model: Identifier, ws: Workspace) -> DataFrame:
    """(row, ent, n): cross-entropies under all languages, and the number of symbols scored, of rows (row, text)."""
    tag, width = uuid.uuid4().hex, len(model.names)
    made = pa.list_(pa.float64())

    def mine(new):
        """What this worker keeps while it scores these rows."""
        tc.claim(_workers)
        if tag not in _workers:
            _workers.clear()
            _workers[tag] = (new(),)
        return _workers[tag][0]

    if model.whole is None:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            cache = mine(lambda: Cache(width))
            for b in batches:
                for i, j, data, off in tc.chunks(b.column(1)):
                    ent, n = shared.value.entropies(data, off, cache)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(ent.tolist(), made), pa.array(n)], names=["row", "ent", "n"])

        return rows.mapInArrow(run, rows.select("row").schema.add("ent", _DOUBLES).add("n", "long"))

    table = probabilities(rows.select("text"), model, ws)
    head = frequent(table, CACHED // width)
    known = rows.sparkSession.sparkContext.broadcast(Known(head.select("gram", "ln").toArrow(), width))

    def look_up(batches):
        from pyspark import TaskContext

        memo, have = mine(lambda: tc.Memo(21)), known.value
        no = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, data, off in tc.chunks(b.column(1)):
                sym, so = letters(data, off)
                _, g, _ = gram_hashes(sym, so)
                n = np.diff(so) - _PAD
                sums, has = np.zeros((len(n), width)), np.flatnonzero(n)
                at = have.rows(g, memo)
                if len(has):
                    sums[has] = -np.add.reduceat(have.table[at], (np.cumsum(n) - n)[has], axis=0, dtype=np.float64)
                other = at == len(have.gram)
                cut = np.append(0, np.cumsum(other))[np.append(0, np.cumsum(n))]
                rest = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(g[other].view(np.int64)))
                ids = pa.array(no + np.arange(len(n)))
                no += len(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids, pa.array(sums.tolist(), made), pa.array(n), rest], names=["row", "id", "sums", "n", "rest"])

    got = rows.mapInArrow(look_up, rows.select("row").schema.add("id", "long").add("sums", _DOUBLES).add("n", "long").add("rest", ArrayType(LongType())))
    total = F.col("sums")
    if head is not table:  # n-grams that are not broadcast: rare ones, so no key of the join is frequent
        got = ws.write(got, f"sums-{tag}")  # once, as ids are a task's
        asked = got.select("id", F.explode("rest").alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("c"))
        more = asked.join(table, "gram").groupBy("id").agg(F.array(*[F.sum(F.col("ln")[k].cast("double") * F.col("c")) for k in range(width)]).alias("more"))
        got = got.drop("rest").join(more, "id", "left")
        total = F.when(F.col("more").isNull(), total).otherwise(F.zip_with("sums", "more", lambda x, y: x - y))
    return got.select("row", F.transform(total, lambda x: x / F.greatest("n", F.lit(1))).alias("ent"), "n")


def calibrate(model: Identifier, sample: DataFrame, ws: Workspace) -> None:
    """Slope of the softmax by likelihood; each language's limit by a quantile of its own texts. Texts are scored in tasks."""
    ents, y = [], []
    for r in scored(sample.select(F.struct("lang").alias("row"), "text"), model, ws).where("n > 0").toLocalIterator():
        ents.append(r.ent)
        y.append(model.names.index(r.row.lang))
    if not y:
        return
    e, y = np.array(ents), np.array(y)

    def loss(slope):
        z = -slope * (e - e.min(axis=1, keepdims=True))
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean() + 1e-4 * slope

    model.slope = float(min(np.geomspace(0.5, 200, 40), key=loss))
    for k in range(len(model.names)):
        own = e[y == k, k]
        if len(own) >= 5:
            model.limit[k] = MARGIN * np.quantile(own, REJECT_QUANTILE)


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """`docs` without the text, with lang_pred, score, cross_entropy and rejected."""
    small_batches(docs.sparkSession)
    made = ["lang_pred", "score", "cross_entropy", "rejected"]
    rest = [c for c in docs.columns if c != text and c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("__none"))
    src = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    found = scored(src, model, Workspace(docs.sparkSession, "languages"))
    bare = model.bare()

    def run(batches):
        names = np.array([*bare.names, "und"], object)
        for b in batches:
            pred, score, ent, rej = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows), np.full(b.num_rows, np.nan), np.zeros(b.num_rows, bool)
            has = np.flatnonzero(b.column(2).to_numpy() > 0)
            if len(has) and bare.names:
                e = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)[has]
                best, p, r = bare.predict(e)
                pred[has], score[has], ent[has], rej[has] = best, p, e[np.arange(len(has)), best], r
            cols = [pa.array(names[pred].tolist(), pa.string()), pa.array(score), pa.array(ent, from_pandas=True), pa.array(rej)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *made])

    got = found.mapInArrow(run, src.select("row").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean"))
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *made)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs.select("doc_id", "text"), train(docs))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return got.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
