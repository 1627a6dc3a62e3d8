"""Token counts (operator 3): two-tier lookup of pre-token lengths on the map side.

A pre-token is a run of spaces with what follows up to the next space, or what
follows a line feed. The library's model has no piece in which a space mark
follows another character, and none with a line feed (both are checked when the
model is loaded), so merges never cross such a boundary and the count of a text
is the sum over its pre-tokens. Tier one is a broadcast hash table of frequent
pre-token lengths (at most FREQUENT entries), which no worker writes to; tier two is a
bounded cache in every Python worker, filled by the library. No pre-token is shuffled:
for tier one every task of one pass counts the pre-tokens at its start (LOOK bytes) and
sends its LOCAL most frequent, with their lengths. That table changes speed only.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import small_batches

FREQUENT = 1 << 16
LOOK, LOCAL = 1 << 17, 1 << 10
OVER = 4096
_FIRST = np.uint64(0xA5A5F00D12345677)
_workers: dict[str, tuple] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str):
    """The library's processor, after a check that pre-tokens are independent."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.vocab_size()):
        p = sp.id_to_piece(i)
        if "\n" in p or any(b == "▁" and a != "▁" for a, b in zip(p, p[1:], strict=False)):
            raise ValueError(f"piece {p!r} spans pre-tokens; this model can't be counted by pre-token")
    return sp


def pre_tokens(data: np.ndarray, off: np.ndarray):
    """(start, end, hash, first) of the pre-tokens; `first` marks those at the start of a text."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    space = data == 32
    cut[:n] = space | (data == 10)
    cut[1:n] &= ~(space[1:] & space[:-1])
    for i in np.flatnonzero(space[3:] & (data[2:-1] == 0x81)) + 3 if n > 3 else ():
        if data[i - 3] == 0xE2 and data[i - 2] == 0x96:  # a literal space mark before a space
            cut[i] = False
    first = np.zeros(n + 1, bool)
    first[off] = True
    cut |= first
    cut[n] = False
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    is_first = first[start]
    h = tc.span_hash(tc.prefix_hash(data), start, end)
    h[is_first] ^= _FIRST
    return start, end, h, is_first


def encode_lengths(sp, units: list[str], first: np.ndarray) -> np.ndarray:
    """Token counts of pre-tokens by the library."""
    give, less = [], np.zeros(len(units), np.int64)
    for k, u in enumerate(units):
        if first[k] or u[0] == "\n":
            give.append(u)
            less[k] = 0 if first[k] else 1  # the space mark that the library puts in front
        elif u == " ":
            give.append(u)
            less[k] = len(sp.encode(" ")) - 1
        else:
            give.append(u[1:])
    return np.array([len(x) for x in sp.encode(give, num_threads=1)], np.int64) - less


def _units(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def count_chunk(sp, tiers: tuple[tc.Memo, tc.Memo], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    if len(data) == 0:
        return np.zeros(n, np.int64)
    start, end, h, first = pre_tokens(data, off)
    val, miss = tiers[0].get(h)
    if miss.any():
        rest = np.flatnonzero(miss)
        val[rest], miss = tiers[1].get(h[rest])
        at = rest[miss]
        if len(at):
            u, rep, inv = np.unique(h[at], return_index=True, return_inverse=True)
            rep = at[rep]
            got = encode_lengths(sp, _units(data, start[rep], end[rep]), first[rep])
            tiers[1].put(u, got)
            val[at] = got[inv]
    total = np.concatenate([[0], np.cumsum(val)])
    edge = np.searchsorted(start, off)
    return total[edge[1:]] - total[edge[:-1]]


def frequent_lengths(texts: DataFrame, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of at most FREQUENT frequent pre-tokens of texts (one column)."""

    def run(batches):
        sp, parts, have = load(model), [], 0
        for b in batches:
            for _, _, data, off in tc.chunks(b.column(0), LOOK):
                if len(data):
                    start, end, h, first = pre_tokens(data, off)
                    u, rep, c = np.unique(h, return_index=True, return_counts=True)
                    top = np.argsort(-c, kind="stable")[:LOCAL]
                    top = top[c[top] > 1]
                    n = encode_lengths(sp, _units(data, start[rep[top]], end[rep[top]]), first[rep[top]]) if len(top) else np.zeros(0, np.int64)
                    parts.append((u[top].view(np.int64), c[top], n))
                    have += len(data)
                if have >= LOOK // 2:
                    break
            if have >= LOOK // 2:
                break
        if parts:
            h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_pydict({"h": pa.array(h), "c": pa.array(c.astype(np.int64)), "n": pa.array(n)})

    found = texts.mapInArrow(run, "h long, c long, n long").groupBy("h").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
    rows = found.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    return np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, out: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """`docs` with the token count of a text column as long column `out`, replaced if there is one; null texts count 0. Without keep_text the text goes."""
    spark = docs.sparkSession
    small_batches(spark)
    model = model or default_model()
    table = spark.sparkContext.broadcast(frequent_lengths(docs.select(F.col(f"`{text}`").alias("text")).where("text is not null"), model))
    tag = uuid.uuid4().hex

    def run(batches):
        tc.claim(_workers)
        if tag not in _workers:
            _workers.clear()
            often = tc.Memo(18)
            often.put(*table.value)
            _workers[tag] = load(model), (often, tc.Memo())
        sp, tiers = _workers[tag]
        for b in batches:
            got = np.zeros(b.num_rows, np.int64)
            for i, j, data, off in tc.chunks(b.column(1)):
                got[i:j] = count_chunk(sp, tiers, data, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["row", "n"])

    rest = [c for c in docs.columns if c != out and (keep_text or c != text)]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text}`").alias("text"))
    got = src.mapInArrow(run, src.select("row").schema.add("n", "long"))
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("n").alias(out))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    got = count_tokens(slim, keep_text=False)
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))
