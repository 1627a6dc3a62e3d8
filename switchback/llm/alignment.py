"""Cross-tokenizer alignment (operator 12): a postings cogroup.

Two tokenizers cut the same bytes; where a token of each ends at one place, the two are linked.
1. One pass over the texts: each text's digest, its pair multiplicities (how often an A id and a B
   id are linked in it) as postings packed by the part of their B id, and, summed in the task
   before anything is shuffled, the pairs' partial counts;
2. partial counts are shuffled by part, merged as a stream, and each B id's highest count is found
   in its part: all A ids of a B id meet there, a few thousand at most;
3. postings are cogrouped with their part's counts. A part with more than POSTINGS rows is split
   by salt, its counts copied to each piece, so a common B id is no hot task; Spark's sorted,
   spilling shuffle forms the groups. A piece emits one row a document, added up by document.

A text is cut before each single space between two characters that aren't white space: there a
pre-token of A begins, by its pattern, and no piece of B has a space mark behind another character
(checked when the model is loaded), so both tokenizers' tokens end and groups end. Each distinct
unit is encoded once a worker by the two libraries, in a cache of bounded size.

Null and empty texts, and texts whose tokens' bytes don't join to a space and the text, have
zeros and an empty hash. Repeated rows are counted each, null doc_ids are kept. Other columns are
kept, but for those named like a result. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import textcore as tc
from .store import Workspace
from .token_counts import default_model, load

PARTS = 64  # of B ids
POSTINGS = 1 << 20  # of a piece of a part
HOLD = 1 << 21  # pairs that a task holds before it sends partial counts
UNITS, UNIT_BYTES = 400_000, 1 << 26  # cached by a worker
_IDS, _DOCS = 20, 16  # bits of an id and of a text's number in a batch: with 6 for the part they make a sort key
_workers: dict[tuple, Aligner] = {}

STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    # Printable bytes stand for themselves, the others are numbered from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both encoders behind a bounded cache of units."""

    def __init__(self, a: str, b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = load(b)
        to_byte = byte_characters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        size = self.b.vocab_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(size))]
        if max(len(self.bytes_a), size) > 1 << _IDS:
            raise ValueError(f"ids of over {_IDS} bits")
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), size)
        self.told = [[b"%d%s" % (i, end) for i in range(most)] for end in (b",", b"|", b",", b";")]
        self.memo = tc.Memo(20)
        self.clear()

    def clear(self) -> None:
        self.memo.clear()
        self.text: list[bytes] = []
        self.held = 0
        self.stats = np.zeros((UNITS, 4), np.int64)  # tokens of A, of B, groups, 1 if it can't be aligned
        self.first = np.zeros(UNITS + 1, np.int64)
        self.links = np.zeros((2, 1 << 16), np.int64)

    @staticmethod
    def cut(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the units of texts that begin with a space each."""
        n = len(data)
        white = (data <= 32) & ((data >= 28) | ((data >= 9) & (data <= 13)))
        wide = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # leads of all other white space, and of the space mark
        plain_next = np.append(~(white | wide)[1:], False)
        open_before = np.zeros(n, bool)  # the character before may be white space or the mark
        open_before[1:] = white[:-1]
        for back in (2, 3):
            open_before[back:] |= wide[:-back] & (data[back - 1 : -1] >= 0x80)
        start = (data == 32) & plain_next & ~open_before
        start[off[:-1][np.diff(off) > 0]] = True
        return np.flatnonzero(start)

    def _add(self, units: list[bytes]) -> np.ndarray:
        """Encode units and cache them; their numbers."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        ids_b = self.b.encode([u[1:].decode() for u in units], num_threads=1)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = np.array([b"".join(map(get_a, x)) == u == b"".join(map(get_b, y)) for u, x, y in zip(units, ids_a, ids_b, strict=True)], bool)
        ids_a = [x if ok else [] for x, ok in zip(ids_a, good, strict=True)]
        ids_b = [x if ok else [] for x, ok in zip(ids_b, good, strict=True)]
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])  # both count the good units' bytes
        at = np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))
        link_a = np.flatnonzero(end_b[at] == end_a) if len(end_b) else np.zeros(0, np.int64)
        link_b = at[link_a]
        unit = np.searchsorted(np.cumsum(n_a), link_a, "right")
        groups = np.bincount(unit, minlength=len(units))
        # A's ids, then B's, group by group; the last of a side ends with another mark
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[link_a] = last_b[link_b] = True
        group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        order = np.argsort(group, kind="stable")
        kind = np.concatenate([last_a, 2 + last_b])[order].tolist()
        told = self.told
        marks = [told[k][i] for k, i in zip(kind, np.concatenate([a, b])[order].tolist(), strict=True)]
        cuts = np.append(0, np.cumsum(n_a + n_b)).tolist()
        text = [b"".join(marks[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        base = len(self.text)
        where = np.arange(base, base + len(units))
        while base + len(units) > len(self.stats):
            self.stats = np.concatenate([self.stats, np.zeros_like(self.stats)])
            self.first = np.append(self.first, np.zeros(len(self.first), np.int64))
        self.stats[where] = np.stack([n_a, n_b, groups, ~good], 1)
        used = int(self.first[base])
        while used + len(link_a) > self.links.shape[1]:
            self.links = np.concatenate([self.links, np.zeros_like(self.links)], axis=1)
        self.links[:, used : used + len(link_a)] = a[link_a], b[link_b]
        self.first[where + 1] = used + np.cumsum(groups)
        self.text += text
        self.held += sum(map(len, text))
        return where

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each unit in the cache, first unit of each text and the end)."""
        start = self.cut(data, off)
        end = np.append(start[1:], len(data))
        edge = np.searchsorted(start, off)
        if not len(start):
            return start, edge
        h = tc.span_hash(tc.prefix_hash(data), start, end)
        val, miss = self.memo.get(h)
        if miss.any():
            at = np.flatnonzero(miss)
            if len(self.text) and (len(self.text) + len(at) > UNITS or self.held > UNIT_BYTES):
                self.clear()
                at = np.arange(len(h))
            u, rep, inv = np.unique(h[at], return_index=True, return_inverse=True)
            rep = at[rep]
            raw = data.tobytes()
            new = self._add([raw[x:y] for x, y in zip(start[rep].tolist(), end[rep].tolist(), strict=True)])
            self.memo.put(u, new)
            val[at] = new[inv]
        return val, edge

    def align(self, data: np.ndarray, off: np.ndarray):
        """((n_a, n_b, n_groups) a text, groups_sha256 a text, postings (A id, B id, text, times)) of texts that begin with a space."""
        val, edge = self.units(data, off)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.stats[val], axis=0)])
        per = sums[edge[1:]] - sums[edge[:-1]]
        ok = (per[:, 3] == 0) & (np.diff(off) > 1)  # a space alone is an empty text
        per[~ok] = 0
        text, numbers, cuts = self.text, val.tolist(), edge.tolist()
        sha = [hashlib.sha256(b";".join([text[k] for k in numbers[x:y]])).hexdigest() if good else "" for x, y, good in zip(cuts[:-1], cuts[1:], ok.tolist(), strict=True)]
        doc = np.repeat(np.arange(len(off) - 1), np.diff(edge))
        key, times = np.unique((doc[ok[doc]] << 32) | val[ok[doc]], return_counts=True)
        unit, doc = key & 0xFFFFFFFF, key >> 32
        n = self.first[unit + 1] - self.first[unit]
        at = np.repeat(self.first[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return per[:, :3], sha, (self.links[0, at], self.links[1, at], np.repeat(doc, n), np.repeat(times, n))


def aligner(a: str, b: str) -> Aligner:
    tc.claim(_workers)
    if (a, b) not in _workers:
        _workers.clear()
        _workers[a, b] = Aligner(a, b)
    return _workers[a, b]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their sums."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[new], np.add.reduceat(times, new) if len(new) else times


_PAIR = np.dtype([("ab", "<u8"), ("n", "<i8")])  # A id below, B id above
_POST = np.dtype([("a", "<u4"), ("b", "<u4"), ("doc", "<u2"), ("n", "<u2")])
_POST_SHORT = np.dtype([("a", "<u2"), ("b", "<u2"), ("doc", "<u2"), ("n", "<u2")])


def _parts(key: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    part = key >> np.uint64(shift)
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(part[x]), slice(x, y)


def aligned(ws: Workspace, docs: DataFrame, text: str, a: str, b: str) -> DataFrame:
    """One written table: a row a text (row, cols, digests), packed postings (part, row of the first text, posts) and packed partial counts (part, pairs)."""
    rest = [c for c in docs.columns if c != text]
    cols = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("__none"))
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.concat(F.lit(" "), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"), cols.alias("cols"))
    schema = StructType([StructField(f.name, f.dataType, True) for f in src.select("row", "cols").schema])
    for name, kind in (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("groups_sha256", "string"), ("part", "integer"), ("n", "long"), ("posts", "binary"), ("pairs", "binary")):
        schema = schema.add(name, kind)

    def batch(like: pa.DataType, size: int, **given):
        kinds = {"row": pa.int64(), "cols": like, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "part": pa.int32(), "n": pa.int64(), "posts": pa.binary(), "pairs": pa.binary()}
        return pa.RecordBatch.from_arrays([(given[k] if isinstance(given[k], pa.Array) else pa.array(given[k], t)) if k in given else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))

    def counts(like, key, times):
        rows = [(p, key[s], times[s]) for p, s in _parts(key, 2 * _IDS)]
        packed = []
        for _, k, t in rows:
            x = np.empty(len(k), _PAIR)
            x["ab"], x["n"] = k & np.uint64((1 << 2 * _IDS) - 1), t
            packed.append(x.tobytes())
        return batch(like, len(rows), part=[p for p, *_ in rows], pairs=packed)

    def run(batches):
        it, like = aligner(a, b), None
        small = max(len(it.bytes_a), len(it.bytes_b)) <= 1 << 16
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for bt in batches:
            like = bt.schema.field("cols").type
            row = bt.column("row").to_numpy()
            if len(row) and (row[-1] - row[0] != len(row) - 1 or len(row) > 1 << _DOCS):
                raise ValueError("rows of a batch aren't numbered one after another")
            keys, times = [], []
            for i, j, data, off in tc.chunks(bt.column("text")):
                per, sha, (ia, ib, doc, n) = it.align(data, off)
                yield batch(like, j - i, row=bt.column("row").slice(i, j - i), cols=bt.column("cols").slice(i, j - i), n_a=per[:, 0], n_b=per[:, 1], n_groups=per[:, 2], groups_sha256=sha)
                part = (tc.mix(ib.astype(np.uint64)) % np.uint64(PARTS)).astype(np.uint64)
                pair = (ib.astype(np.uint64) << np.uint64(_IDS)) | ia.astype(np.uint64)
                keys.append((part << np.uint64(2 * _IDS + _DOCS)) | (pair << np.uint64(_DOCS)) | (doc + i).astype(np.uint64))
                times.append(n)
            if not keys:
                continue
            key, n = _summed(np.concatenate(keys), np.concatenate(times))
            out = []
            for p, s in _parts(key, 2 * _IDS + _DOCS):
                m = n[s]
                again = np.maximum(1, -(-m // 0xFFFF))  # a posting that two bytes can't count comes in several rows
                k = np.repeat(key[s], again)
                x = np.empty(len(k), _POST_SHORT if small else _POST)
                x["doc"], x["a"], x["b"] = k & np.uint64((1 << _DOCS) - 1), (k >> np.uint64(_DOCS)) & np.uint64((1 << _IDS) - 1), (k >> np.uint64(_DOCS + _IDS)) & np.uint64((1 << _IDS) - 1)
                nth = np.arange(len(k)) - np.repeat(np.cumsum(again) - again, again)
                x["n"] = np.minimum(np.repeat(m, again) - nth * 0xFFFF, 0xFFFF)
                out.append((p, len(x), x.tobytes()))
            if out:
                yield batch(like, len(out), row=[int(row[0])] * len(out), part=[o[0] for o in out], n=[o[1] for o in out], posts=[o[2] for o in out])
                held.append(_summed(key >> np.uint64(_DOCS), n))
            if sum(len(k) for k, _ in held) > HOLD:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > HOLD // 2:
                    yield counts(like, *held.pop())
        if held:
            yield counts(like, *_summed(*map(np.concatenate, zip(*held, strict=True))))

    return ws.write(src.select("row", "text", "cols").mapInArrow(run, schema), "aligned")


def pair_counts(done: DataFrame) -> DataFrame:
    """(part, pairs): each part's pairs, sorted, with their counts over all texts; best counts of a B id are negative."""

    def finish(part, held):
        ab, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        first = np.flatnonzero(np.append(True, (ab >> np.uint64(_IDS))[1:] != (ab >> np.uint64(_IDS))[:-1]))
        best = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
        x = np.empty(len(ab), _PAIR)
        x["ab"], x["n"] = ab, np.where(n == best, -n, n)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "pairs": pa.array([x.tobytes()], pa.binary())})

    def run(batches):
        part, held = None, []
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield finish(part, held)
                    held = []
                part = p
                x = np.frombuffer(raw, _PAIR)
                held.append((x["ab"], x["n"]))
                if len(held) > 1 and sum(len(k) for k, _ in held) > HOLD + 2 * len(held[0][0]):
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
        if held:
            yield finish(part, held)

    sent = done.where("pairs is not null").select("part", "pairs")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, pairs binary")


def contributions(done: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """(row, n_best, count_sum): what each text's links add, from postings cogrouped with their part's counts."""
    posts = done.where("posts is not null").select("part", "row", "n", "posts")
    pieces = posts.groupBy("part").agg(F.ceil(F.sum("n") / POSTINGS).cast("long").alias("pieces"))
    left = posts.join(pieces, "part").select("part", F.pmod(F.xxhash64("row"), "pieces").alias("salt"), "row", "posts")
    right = counts.join(pieces, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("salt"), "pairs")
    kind = _POST_SHORT if small else _POST

    def meet(posts: pa.Table, pairs: pa.Table) -> pa.Table:
        rows, best, total = [], [], []
        if posts.num_rows:
            known = np.frombuffer(pairs.column("pairs")[0].as_py(), _PAIR)
            for base, raw in zip(posts.column("row").to_pylist(), posts.column("posts").to_pylist(), strict=True):
                x = np.frombuffer(raw, kind)
                n = known["n"][np.searchsorted(known["ab"], (x["b"].astype(np.uint64) << np.uint64(_IDS)) | x["a"].astype(np.uint64))]
                times = x["n"].astype(np.int64)
                order = np.argsort(x["doc"], kind="stable")
                first = np.flatnonzero(np.append(True, x["doc"][order][1:] != x["doc"][order][:-1]))
                rows.append(base + x["doc"][order][first].astype(np.int64))
                best.append(np.add.reduceat(np.where(n < 0, times, 0)[order], first))
                total.append(np.add.reduceat((times * np.abs(n))[order], first))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"row": cat(rows), "n_best": cat(best), "count_sum": cat(total)})

    both = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt"))
    return both.applyInArrow(meet, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """`docs` without the text, with STATS of its alignment: A is a byte-level tokenizer's file, B a sentencepiece model's."""
    ws = Workspace(docs.sparkSession, "alignment")
    a, b = a or default_tokenizer(), b or default_model()
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in STATS or c == text])
    done = aligned(ws, docs, text, a, b)
    it = Aligner(a, b)
    sums = contributions(done, ws.write(pair_counts(done), "counts"), max(len(it.bytes_a), len(it.bytes_b)) <= 1 << 16)
    rows = done.where("n_groups is not null").select("row", "cols", "n_a", "n_b", "n_groups", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rest = [c for c in docs.columns if c != text]
    return rows.join(sums, "row", "left").select(*[F.col(f"cols.`{c}`").alias(c) for c in rest], "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs.select("doc_id", "text"))
