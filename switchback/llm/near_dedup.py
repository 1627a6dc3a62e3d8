"""MinHash near-dedup (operator 5): improved consistent weighted sampling over TF-IDF shingles.

Shingles are five lower-cased words; a shingle's weight is its count in the text times
1 + ln((1 + N) / (1 + df)), where df is the number of rows that hold it, of N with words, HEAVY * N at
least: what a group of copies shares is frequent by the group alone, and its edits are not, so without
this copies would be the less alike the larger their group. Every shingle's df is counted over all
rows: distinct texts are dealt over blocks; a block sends its shingles with their numbers of rows to
parts by hash, a part adds them up and answers each block for those that other blocks hold too.
Nothing of this passes the driver but N.

Every text gets SAMPLES samples (element and level), banded by ROWS; texts that share a
band are compared in blocks (see `linking`), links are verified by the exact
weighted Jaccard similarity (>= SIMILARITY), and components are the classes. Equal texts
meet by the 64-bit hash of the text before anything else.

Defined cases: a null text is a class of its own; empty texts are copies of each other;
texts without words match only equal texts; texts under five words have one shingle of
all their words; repeated rows share a class; a null doc_id gets the class of its text, and
rows that share a doc_id may be in several classes; an empty table gives an empty result;
other columns are ignored or passed on, whatever their names. Memory of a worker is linear
in the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from . import textcore as tc
from .store import Workspace

SIMILARITY = 0.8
WORDS = 5
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
NEED = 17  # of SAMPLES equal for a link; at similarity 0.8 a pair has fewer with probability 0.3 %
HEAVY = 0.005  # share of the rows that a df counts as at least, in weights: copies of a group must not weigh less than their edits
BLOCK_TEXT = 1 << 23  # bytes of text of a block, about
PART_SHINGLES = 1 << 22  # shingles that a part adds up, about
LOW_BITS = 48  # of a shingle's 52 that are sent: a part's number tells the upper ones
_tables: dict[str, np.ndarray] = {}


def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables by 16-bit draws: gamma(2, 1) quantiles, -ln(u), and u."""
    if not _tables:
        u = (np.arange(65536) + 0.5) / 65536
        lo, hi = np.zeros(65536), np.full(65536, 50.0)
        for _ in range(60):  # bisection on 1 - (1 + x) e**-x
            x = (lo + hi) / 2
            less = 1 - (1 + x) * np.exp(-x) < u
            lo, hi = np.where(less, x, lo), np.where(less, hi, x)
        _tables["r"], _tables["nl"], _tables["u"] = lo.astype(np.float32), (-np.log(u)).astype(np.float32), u.astype(np.float32)
    return _tables["r"], _tables["nl"], _tables["u"]


def _seeds() -> np.ndarray:
    return tc.mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def weights(df: np.ndarray, tf: np.ndarray, n_docs: int) -> np.ndarray:
    """TF-IDF weights of shingles that df of n_docs rows hold."""
    return tf * (1 + np.log((1 + n_docs) / (1 + np.maximum(df, HEAVY * n_docs))))


def samples(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their samples as uint32, one row of SAMPLES each)."""
    r_q, nl, u_q = _quantiles()
    seeds = _seeds()
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(doc)))
    seg = np.repeat(np.arange(len(start)), size)
    ln_s = np.log(weight)
    out = np.zeros((len(start), SAMPLES), np.uint32)
    for k in range(SAMPLES if len(start) else 0):
        x = element * seeds[2 * k]
        x ^= x >> np.uint64(29)
        x *= seeds[2 * k + 1]
        x ^= x >> np.uint64(32)
        d = x.view(np.uint16).reshape(-1, 4)
        r = r_q[d[:, 0]]
        beta = u_q[d[:, 1]]
        t = np.floor(ln_s / r + beta)
        a = np.log(nl[d[:, 2]] + nl[d[:, 3]]) - r * (t - beta + 1)
        low = np.minimum.reduceat(a, start)
        at = np.flatnonzero(a == low[seg])
        first = at[np.concatenate([[True], seg[at][1:] != seg[at][:-1]])]
        z = tc.mix(element[first] * np.uint64(2 * k + 3) + t[first].astype(np.int64).astype(np.uint64))
        out[:, k] = (z >> np.uint64(32)).astype(np.uint32)
    return doc[start], out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket a band."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for k in range(ROWS):
        x = tc.mix(x + s[:, :, k] + np.uint64(1))
    return x.view(np.int64)


BLOCKED = "block long, part long, key long, text string, n long, rows binary"  # texts have part -1, no rows and a key
COUNTED = "part long, block long, rows binary"


def _blocked(texts: DataFrame, blocks: int) -> DataFrame:
    """BLOCKED rows of (key, text): a batch's distinct texts and the numbers of their rows."""

    def run(batches):
        for b in batches:
            key, first, n = np.unique(b.column(0).to_numpy(), return_index=True, return_counts=True)
            none = pa.nulls(len(key), pa.binary())
            yield pa.RecordBatch.from_pydict({"block": pa.array((key.view(np.uint64) % np.uint64(blocks)).astype(np.int64)), "part": pa.array(np.full(len(key), -1)), "key": pa.array(key), "text": b.column(1).take(pa.array(first)), "n": pa.array(n.astype(np.int64)), "rows": none})

    return texts.select("key", "text").mapInArrow(run, BLOCKED)


def _whole(rows: DataFrame) -> DataFrame:
    """Blocks as runs, answers before the texts."""
    return rows.repartition("block").withColumn("none", F.lit(0).cast("long")).select("block", "none", "part", "key", "text", "n", "rows").sortWithinPartitions("block", "key", "part")


class _Block:
    """Distinct texts of a block with their rows' numbers and shingles; df of the shingles by the block's own rows."""

    def __init__(self, t: pa.Table):
        t = t.filter(t.column("key").is_valid()).combine_chunks()
        key = t.column("key").to_numpy()
        first = linking._runs(key)[:-1] if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(t.column("n").to_numpy(), first) if len(key) else np.zeros(0, np.int64)
        self.key, self.n, col = key[first], n, t.column("text").take(pa.array(first)).combine_chunks()
        self.text = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
        self.parts = []
        for i, _, data, off in tc.chunks(self.text):
            doc, element, tf = tc.shingles(tc.Words(data, off), WORDS)
            self.parts.append((i + doc, element, tf))
        element = np.concatenate([np.zeros(0, np.uint64), *(e for _, e, _ in self.parts)])
        rows = np.concatenate([np.zeros(0, np.int64), *(n[d] for d, _, _ in self.parts)])
        order = np.argsort(element)
        element = element[order]
        cut = linking._runs(element)[:-1] if len(element) else np.zeros(0, np.int64)
        self.shingle = element[cut]
        self.df = np.add.reduceat(rows[order], cut) if len(cut) else np.zeros(0, np.int64)


def _pack(shingle: np.ndarray, df: np.ndarray) -> bytes:
    low = shingle & np.uint64((1 << LOW_BITS) - 1)
    return low.astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint16).tobytes() + df.astype(np.int64).tobytes()


def _unpack(raw: bytes, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = len(raw) // 14
    low = np.frombuffer(raw, np.uint32, k).astype(np.uint64) | (np.frombuffer(raw, np.uint16, k, 4 * k).astype(np.uint64) << np.uint64(32))
    top = np.uint64((part >> (bits - (52 - LOW_BITS))) << LOW_BITS)
    return low | top, np.frombuffer(raw[6 * k :], np.int64, k)


def frequencies(texts: DataFrame, ws: Workspace) -> tuple[DataFrame, int, int, int]:
    """(answers, rows with words, blocks, bits of a part): answers (part, block, rows) hold the df of shingles that a block doesn't know by itself."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_TEXT))
    bits = max(52 - LOW_BITS, int(np.ceil(np.log2(max(1, size / 6 / PART_SHINGLES)))))  # a word has some six bytes

    def ask(batches):
        tc.claim({})
        for t in linking.whole_blocks(batches):
            cut = linking._runs(t.column(0).to_numpy())
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                v = _Block(t.slice(a, b - a))
                part = (v.shingle >> np.uint64(52 - bits)).astype(np.int64)
                at = linking._runs(part) if len(part) else np.zeros(1, np.int64)
                block = t.column(0)[a].as_py()
                words = sum(int(v.n[np.unique(d)].sum()) for d, _, _ in v.parts)
                out = [(int(part[x]), block, _pack(v.shingle[x:y], v.df[x:y])) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out.append((-1, -1, np.array([words], np.int64).tobytes()))
                yield pa.RecordBatch.from_pydict(dict(zip(("part", "block", "rows"), (pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)), strict=True)))

    def settle(part, held):
        if part < 0:
            return pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int64()), "block": pa.array([-1], pa.int64()), "rows": pa.array([sum(np.frombuffer(r, np.int64)[0] for _, r in held).tobytes()], pa.binary())})
        blocks = [b for b, _ in held]
        shingle, df = (np.concatenate(c) for c in zip(*(_unpack(r, part, bits) for _, r in held), strict=True))
        whose = np.repeat(np.arange(len(held)), [len(r) // 14 for _, r in held])
        order = np.argsort(shingle, kind="stable")
        cut = linking._runs(shingle[order])
        total = np.empty(len(df), np.int64)
        total[order] = np.repeat(np.add.reduceat(df[order], cut[:-1]), np.diff(cut))
        more = np.flatnonzero(total > df)  # still by block, and ascending within one
        at = linking._runs(whose[more]) if len(more) else np.zeros(1, np.int64)
        runs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(runs), pa.int64()), "block": pa.array([blocks[whose[more[x]]] for x, _ in runs], pa.int64()), "rows": pa.array([_pack(shingle[more[x:y]], total[more[x:y]]) for x, y in runs], pa.binary())})

    def add(batches):
        of, held = None, []
        for b in batches:
            for part, block, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != of and held:
                    yield settle(of, held)
                    held = []
                of = part
                held.append((block, raw))
        if held:
            yield settle(of, held)

    asked = _whole(_blocked(texts, blocks)).mapInArrow(ask, COUNTED)
    answers = ws.write(asked.repartition("part").sortWithinPartitions("part").mapInArrow(add, COUNTED), "frequencies")
    words = answers.where("part < 0").select("rows").first()
    return answers, int(np.frombuffer(words[0], np.int64)[0]) if words else 0, blocks, bits


WEIGHED = "key long, size tinyint, sig binary, text binary"  # text: its length, its bytes, the df of its shingles


def signatures(texts: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """`linking.SIGNED` rows, with df beside the text (WEIGHED), of every distinct text of (key, text) that has a word; rows with words."""
    answers, n_docs, blocks, bits = frequencies(texts, ws)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("text", "string"), ("n", "long"))]
    rows = _blocked(texts, blocks).unionByName(answers.where("part >= 0").select("block", "part", *none, "rows"))

    def signed(t):
        v = _Block(t)
        known = t.filter(t.column("rows").is_valid())
        for part, raw in zip(known.column("part").to_pylist(), known.column("rows").to_pylist(), strict=True):
            shingle, df = _unpack(raw, part, bits)
            v.df[np.searchsorted(v.shingle, shingle)] = df
        for docs, element, tf in v.parts:
            if not len(docs):
                continue
            df = v.df[np.searchsorted(v.shingle, element)]
            has, sig = samples(docs, element, weights(df, tf, n_docs).astype(np.float32))
            cut = linking._runs(docs)
            made = []
            for k, text in enumerate(v.text.take(pa.array(has)).to_pylist()):
                raw = text.encode()
                made.append(len(raw).to_bytes(8, "little") + raw + df[cut[k] : cut[k + 1]].astype(np.int64).tobytes())
            size = linking.log_size(np.array([len(x) for x in made]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(v.key[has]), "size": pa.array(size), "sig": linking.binary_rows(sig), "text": pa.array(made, pa.binary())})

    def run(batches):
        tc.claim({})
        for t in linking.whole_blocks(batches):
            cut = linking._runs(t.column(0).to_numpy())
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield from signed(t.slice(a, b - a))

    return ws.write(_whole(rows).mapInArrow(run, WEIGHED), "sigs"), n_docs


def weighted_jaccard(n_docs: int):
    """compare function of `linking.find_classes` over texts of WEIGHED."""

    def compare(col):
        keys, weight, texts, dfs = [], [], [], []
        for raw in col.to_pylist():
            end = 8 + int.from_bytes(raw[:8], "little")
            texts.append(raw[8:end])
            dfs.append(np.frombuffer(raw[end:], np.int64))
        df, at = np.concatenate(dfs), 0
        for i, _, data, off in tc.chunks(pa.array(texts, pa.binary()).cast(pa.string())):
            doc, element, tf = tc.shingles(tc.Words(data, off), WORDS)
            weight.append(weights(df[at : at + len(doc)], tf, n_docs))
            at += len(doc)
            keys.append(((i + doc).astype(np.uint64) << np.uint64(linking.SET_BITS)) | (element >> np.uint64(52 - linking.SET_BITS)))
        keys, weight = np.concatenate(keys), np.concatenate(weight)
        cut = np.searchsorted(keys, np.arange(len(col) + 1, dtype=np.uint64) << np.uint64(linking.SET_BITS))
        sums = np.append(0, np.cumsum(weight))
        total = sums[cut[1:]] - sums[cut[:-1]]

        def same(i, j):
            both = np.zeros(len(i))
            for part, pair, x, y in linking.shared(keys, cut, i, j):
                both[part] = np.bincount(pair, np.minimum(weight[x], weight[y]), minlength=part.stop - part.start)
            either = total[i] + total[j] - both
            return (either > 0) & (both / np.where(either > 0, either, 1) >= SIMILARITY)

        return same

    return compare


def text_classes(docs: DataFrame, ws: Workspace, text: str = "text") -> DataFrame:
    """(key, root) for the keys, xxhash64 of the text, that belong to a class of several texts."""
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    sigs, n_docs = signatures(texts, ws)
    return linking.find_classes(ws, sigs, band_keys, NEED, SAMPLES, np.uint32, lambda col: weighted_jaccard(n_docs)(col))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ws: Workspace | None = None) -> DataFrame:
    """One row a document: (doc_id, class_id, kept).

    class_id is the smallest doc_id of the class, or the class's 64-bit key if none of its rows
    has an id; a null text has its own doc_id. kept marks the rows of the class's first text
    (smallest doc_id, nulls last, then smallest key) under that id: one row, or the repeats of one row.
    """
    ws = ws or Workspace(docs.sparkSession, "near-dedup")
    roots = text_classes(docs, ws, text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("key"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    by_key = slim.where("key is not null").groupBy("key").agg(F.min(place).alias("place"))
    whole = ws.write(by_key.join(roots, "key", "left").select("key", "place", F.coalesce("root", "key").alias("root")), "by-key")
    ids = ws.write(whole.groupBy("root").agg(F.min("place").alias("first")), "firsts")  # a table of its own: a skewed join can be split
    by_text = ws.write(whole.join(ids, "root").select("key", F.coalesce("first.doc_id", "root").alias("class_id"), "first"), "classes")
    return slim.join(by_text, "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("key").isNull(), True).otherwise((F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("kept"),
    )


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class: that of `near_duplicates`, once; rows of null texts all stay."""
    ws = Workspace(spark, "pipeline-near-dedup")
    roots = text_classes(docs, ws)
    return keep_once(docs, roots, ws)


def keep_once(docs: DataFrame, roots: DataFrame, ws: Workspace) -> DataFrame:
    """The rows that stay; of rows equal in doc_id and text any one does, whatever its other columns hold."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of docs can clash
    packed = packed.withColumn("key", F.xxhash64("row.text"))
    place = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "key")
    seen = packed.where("row.text is not null").groupBy("key").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    whole = ws.write(seen.join(roots, "key", "left").select("key", "place", "n", F.coalesce("root", "key").alias("root")), "seen")
    first = ws.write(whole.groupBy("root").agg(F.min(F.struct("place", "n")).alias("first")).select(F.col("first.place.key").alias("key"), F.col("first.place.doc_id").alias("first_id"), F.col("first.n").alias("n")), "kept")
    none = packed.where("row.text is null").select("row.*")
    got = packed.where("row.text is not null").join(first, "key").where(F.col("row.doc_id").eqNullSafe(F.col("first_id")))
    if first.where("n > 1").isEmpty():
        return none.unionByName(got.select("row.*"))
    # only keys with repeats are grouped; a map-side first leaves one row a task and key
    again = got.where("n > 1").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return none.unionByName(got.where("n = 1").select("row.*")).unionByName(again)
