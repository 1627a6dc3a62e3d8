"""Line dedup (operator 7): fuzzy lines by MinHash, one line kept a component.

Lines (cut at line feeds) have SHINGLE-character shingles of their lower-cased text.
Equal lines meet by a 64-bit xxhash. Every distinct line gets SAMPLES minima in BANDS
bands; pairs of lines that share a band are verified by the exact Jaccard similarity of
the shingle sets (>= SIMILARITY), and union by smallest-label rounds gives the components
(see `linking`). The occurrence with the smallest doc_id and line number is kept, all
others are removed; texts are put together again from the rest.

Defined cases: empty lines, and lines of white space only, are always kept and never
compared; lines under SHINGLE characters match equal lines only; a null text stays
null; rows equal in doc_id and text are one text, with the same result for each; null
doc_ids sort last; other columns are passed on, whatever their names. A worker holds one
chunk of texts, or one text if it is longer.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from . import textcore as tc
from .store import Workspace

SHINGLE = 8
SIMILARITY = 0.7
BANDS, ROWS = 14, 3  # at the threshold a pair shares no band with probability 0.3 %
SAMPLES = BANDS * ROWS
NEED = 20  # of SAMPLES; at the threshold a pair has fewer with probability 0.07 %
_A = (tc.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (tc.mix(np.arange(101, SAMPLES + 101, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Lines:
    """Lines of a chunk: text index, number in the text, byte span, 64-bit key, whether blank."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        feed = np.flatnonzero(data == 10)
        start = np.concatenate([off[:-1], feed + 1])
        doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feed, "right") - 1])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True)[: len(self.doc)]
        self.end = np.where(last, off[1:][self.doc], np.append(self.start[1:] - 1, 0)[: len(self.doc)])
        first = np.searchsorted(self.doc, np.arange(len(off) - 1))
        self.no = np.arange(len(self.doc)) - first[self.doc]
        solid = np.concatenate([[0], np.cumsum((data != 32) & (data != 9) & (data != 13) & (data != 10))])
        self.blank = solid[self.end] == solid[self.start]
        self.raw = data.tobytes()

    def keys(self, at: np.ndarray) -> np.ndarray:
        """64-bit XXH3 of the lines' bytes."""
        return np.array([xxhash.xxh3_64_intdigest(self.raw[a:b]) for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)], np.uint64).view(np.int64)

    def texts(self, at: np.ndarray) -> pa.Array:
        size = self.end[at] - self.start[at]
        return pa.array([self.raw[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)], pa.binary()).cast(pa.string()) if len(size) else pa.array([], pa.string())


_MULTIPLIERS = tc.mix(np.arange(201, 201 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def window_hashes(low: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE characters from each position; zeros follow the last."""
    n = len(low)
    narrow = np.zeros(n + 2 * SHINGLE, np.uint8)
    narrow[:n] = low & 0xFF
    x = np.empty(n + SHINGLE, np.uint64)
    for k in range(SHINGLE):  # eight bytes are one number
        part = narrow[k : k + (n + SHINGLE - k + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view(np.uint64)
        x[k::8][: len(part)] = part[: len(x[k::8])]
    x = x[:n]
    if n and low.max() > 0xFF:  # what the bytes leave out of wide characters is mixed in
        wide = np.zeros(n + SHINGLE, np.uint64)
        wide[:n] = low >> 8
        more = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            more += wide[k : k + n] * _MULTIPLIERS[k]
        x = x ^ tc.mix(more) * (more != 0)
    return tc.mix(x)


def line_shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line index, 64-bit hash) of the shingles of ascending byte spans of SHINGLE characters or more; shorter ones have none."""
    cps, cut = tc.decode(data, np.stack([start, end], 1).ravel())
    s, e = cut[::2], cut[1::2]
    n = np.maximum(e - s - SHINGLE + 1, 0)
    line = np.repeat(np.arange(len(s)), n)
    at = np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n)
    return line, window_hashes(tc.lower(cps))[at]


def minima(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit minima a line; lines are numbered without gaps."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    out = np.zeros((len(first), SAMPLES), np.uint16)
    y = np.empty_like(x)
    for k in range(SAMPLES):
        np.multiply(x, _A[k], out=y)
        y += _B[k]
        m = np.minimum.reduceat(y, first)
        out[:, k] = ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for k in range(ROWS):
        x = tc.mix(x + s[:, :, k] + np.uint64(1))
    return x.view(np.int64)


LINES = "key long, size tinyint, sig binary, text string, doc long, doc_id long, line int"


def lines(texts: DataFrame) -> DataFrame:
    """A row (LINES) for every line that isn't blank of texts (doc, doc_id, text).

    sig and text are set at the first occurrence in a chunk of a line of SHINGLE characters or more.
    """

    def run(batches):
        tc.claim({})
        for b in batches:
            for i, _, data, off in tc.chunks(b.column(2)):
                l = Lines(data, off)
                at = np.flatnonzero(~l.blank)
                if not len(at):
                    continue
                key = l.keys(at)
                first = np.zeros(len(at), bool)
                first[np.unique(key, return_index=True)[1]] = True
                lead = at[first]
                line, h = line_shingles(data, l.start[lead], l.end[lead])
                has = np.unique(line)
                where = np.full(len(at), -1)
                where[np.flatnonzero(first)[has]] = np.arange(len(has))
                take = pa.array(where, mask=where < 0)
                doc = pa.array(i + l.doc[at])
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key),
                    "size": pa.array(linking.log_size(l.end[at] - l.start[at])),
                    "sig": linking.binary_rows(minima(line, h) if len(has) else np.zeros((0, SAMPLES), np.uint16)).take(take),
                    "text": l.texts(lead[has]).take(take),
                    "doc": b.column(0).take(doc),
                    "doc_id": b.column(1).take(doc),
                    "line": pa.array(l.no[at].astype(np.int32)),
                })

    return texts.select("doc", "doc_id", "text").mapInArrow(run, LINES)


def jaccard(col):
    """compare function of `linking.find_classes`."""
    keys = []
    for i, _, data, off in tc.chunks(col):
        line, h = line_shingles(data, off[:-1], off[1:])
        x = np.sort(((i + line).astype(np.uint64) << np.uint64(linking.SET_BITS)) | (h >> np.uint64(64 - linking.SET_BITS)))
        keys.append(x[np.append(True, x[1:] != x[:-1])[: len(x)]])
    keys = np.concatenate(keys)
    cut = np.searchsorted(keys, np.arange(len(col) + 1, dtype=np.uint64) << np.uint64(linking.SET_BITS))
    size = np.diff(cut)

    def same(i, j):
        both = np.zeros(len(i), np.int64)
        for part, pair, _, _ in linking.shared(keys, cut, i, j):
            both[part] = np.bincount(pair, minlength=part.stop - part.start)
        return both >= SIMILARITY * (size[i] + size[j] - both)

    return same


def removed_lines(texts: DataFrame, ws: Workspace) -> DataFrame:
    """(doc, lines): the numbers of the lines to remove of each text (doc, doc_id, text)."""
    seen = ws.write(lines(texts), "lines")
    sigs = seen.where("sig is not null").select("key", "size", "sig", "text")
    roots = linking.find_classes(ws, sigs, band_keys, NEED, SAMPLES, np.uint16, jaccard)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "line")
    first = seen.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).join(roots, "key", "left").where("n > 1 or root is not null")
    first = ws.write(first.select("key", "first", F.coalesce("root", "key").alias("root")), "firsts")
    keep = ws.write(first.groupBy("root").agg(F.min("first").alias("keep")), "keep")  # a table of its own: a skewed join can be split
    by_key = ws.write(first.join(keep, "root").select("key", F.col("keep.doc").alias("keep_doc"), F.col("keep.line").alias("keep_line")), "by-key")
    gone = seen.select("doc", "line", "key").join(by_key, "key").where("not (doc = keep_doc and line = keep_line)")
    return ws.write(gone.select("doc", "line").groupBy("doc").agg(F.collect_set("line").alias("lines")), "removed")


def dedup_lines(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """`docs` with the text replaced and columns __lines (before) and __removed (counts).

    Columns of these two names are replaced; no other name of docs has a meaning but doc_id and text.
    """
    ws = ws or Workspace(docs.sparkSession, "line-dedup")
    names = [c for c in docs.columns if c not in ("__lines", "__removed")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), "text", F.xxhash64("doc_id", "text").alias("doc"))
    texts = keyed.where(F.col("text").isNotNull()).select("doc", F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    gone = removed_lines(texts, ws)
    rows = keyed.join(gone, "doc", "left").select("row", "text", "lines")

    def run(batches):
        for b in batches:
            text, n, removed = [], [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n.append(t.count("\n") + 1 if t is not None else 0)
                removed.append(len(g) if g else 0)
                if g:
                    drop = set(g)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
                text.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "__lines", "__removed"])

    out = rows.mapInArrow(run, rows.drop("lines").schema.add("__lines", "long").add("__removed", "long"))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names], "__lines", "__removed")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return got.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.octet_length(text).cast("long").alias("kept_bytes"), F.crc32(text).alias("kept_crc32"))
