"""Periodic runs of words (operator 13): longest previous factors, LZ blocks, Main's extensions, bucketed copying.

A run is a longest stretch of words with smallest period q; runs of `least` words and `times`
periods or more are reported. For a chunk of whole texts, all in numpy:
1. suffix array by prefix doubling; the names of each round tell the words of 2**k from a place on;
2. LCP of neighbouring suffixes from these names, then for every place its longest previous factor,
   by the nearest suffixes before and after it that start further left;
3. LZ blocks: a block is its start's longest previous factor, or one word;
4. every run that touches a block's boundary, by Main's argument: it ends in the block after the
   boundary and starts less than a period before the block in front of it, else that block were
   longer. So a boundary between blocks of A and B words has runs of up to A + B + q - 1 words only,
   and only periods with times * q below that are extended, from both sides of the boundary;
5. a run strictly inside a block is a copy of one inside the block's earlier occurrence: runs are
   kept in buckets by their start and copied block by block.
Nothing leaves a task but digests; there is no shuffle. Words are compared by 62-bit hashes.
Memory is some 100 bytes a word of a chunk (CHUNK_BYTES, or one longer text) and 4 for each round.

Null and empty texts, and texts of white space, have no run: nulls, and hashes of the empty
string. Repeated rows are computed each. A null doc_id stays null and plants nothing. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import small_batches

LEAST, TIMES = 24, 3  # words, and periods, of the shortest run
_DOC = np.uint64(0x9E3779B97F4A7C15)

DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Index:
    """Suffix array of a chunk of texts of words, each text by itself.

    order: places by their suffix; levels[k]: equal for places with the same 2**k words;
    lo, hi: bounds of each place's text.
    """

    def __init__(self, word: np.ndarray, doc: np.ndarray, first: np.ndarray):
        n = self.n = len(word)
        self.lo, self.hi = first[:-1][doc], first[1:][doc]
        key = tc.mix(word + tc.mix((doc.astype(np.uint64) + np.uint64(1)) * _DOC))
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        new = np.append(True, key[1:] != key[:-1])[:n]
        slots = np.arange(n)
        name = np.empty(n, np.int64)
        name[self.order] = np.maximum.accumulate(np.where(new, slots, 0))
        self.levels = [name]
        width = 1
        while True:
            slots = slots[~(new & np.append(new[1:], True)[: len(new)])]  # those of groups that aren't told apart yet
            if not len(slots):
                return
            at = self.order[slots]
            after = at + width
            inside = after < self.hi[at]
            key = name[at] * (n + 1) + np.where(inside, name[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            self.order[slots] = at
            new = np.append(True, key[1:] != key[:-1])
            name = name.copy()
            name[at] = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append(name)
            width *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on; a and b are different places of one text."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + out, b + out
            ok = np.flatnonzero(np.maximum(x, y) < self.hi[a])
            out[ok[self.levels[k][x[ok]] == self.levels[k][y[ok]]]] += 1 << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, for a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            ok = np.flatnonzero(x >= self.lo[a])
            out[ok[self.levels[k][x[ok]] == self.levels[k][y[ok]]]] += 1 << k
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Longest previous factor of each place, and where it starts; it may reach into itself."""
        n, order = self.n, self.order
        lcp = np.zeros(n + 1, np.int64)
        same = np.flatnonzero(self.levels[0][order[1:]] == self.levels[0][order[:-1]]) + 1
        lcp[same] = self.ahead(order[same - 1], order[same])
        best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for step in (-1, 1):
            to = np.arange(n) + step
            least = lcp[:n].copy() if step < 0 else lcp[1:].copy()  # of the pairs between a slot and `to`
            act = np.flatnonzero(least > 0)
            act = act[order[to[act]] > order[act]]
            while len(act):  # what lies between a slot and its `to` starts further right, so it can be skipped
                via = to[act]
                least[act], to[act] = np.minimum(least[act], least[via]), to[via]
                act = act[least[act] > 0]
                act = act[order[to[act]] > order[act]]
            more = np.flatnonzero(least > best[order])
            best[order[more]], source[order[more]] = least[more], order[to[more]]
        return best, source


def blocks(longest: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks; no block passes the end of a text, since no factor does."""
    step, out, i, n = np.maximum(longest, 1).tolist(), [], 0, len(longest)
    while i < n:
        out.append(i)
        i += step[i]
    return np.array(out, np.int64)


def boundary_runs(ix: Index, start: np.ndarray, first: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (from, to, period) of the runs that touch a boundary of blocks, periods smallest."""
    edge = np.union1d(start, first)  # starts of blocks and ends of texts
    opens = np.isin(edge, first[:-1][np.diff(first) > 0])
    before = np.diff(edge, prepend=0)
    after = np.diff(edge, append=ix.n)
    inner = edge < ix.n
    # at a text's end there is nothing after; the same place may open the next text, where nothing is before
    rows = [(edge[~opens & inner], before[~opens & inner], after[~opens & inner])]
    ends = np.unique(first[1:][np.diff(first) > 0])
    rows.append((ends, before[np.searchsorted(edge, ends)], np.zeros(len(ends), np.int64)))
    at, a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
    top = (a + b - 1) // (times - 1)  # times * p <= a + b + p - 1
    low = np.maximum(1, least - (a + b) + 1)  # least <= a + b + p - 1
    many = np.maximum(top - low + 1, 0)
    row = np.repeat(np.arange(len(at)), many)
    p = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
    s = at[row]
    lo, hi = ix.lo[s - 1], ix.hi[s - 1]  # of the text in front of the boundary, to which both blocks belong
    word = ix.levels[0]
    left = np.flatnonzero(s - 1 - p >= lo)
    right = np.flatnonzero(s + p < hi)
    both = np.flatnonzero((s - p >= lo) & (s < hi)) if times < 3 else left[:0]  # a square whose middle is the boundary
    x = np.concatenate([s[left] - 1 - p[left], s[right], s[both] - p[both]])
    p = np.concatenate([p[left], p[right], p[both]])
    ok = word[x] == word[x + p]
    x, p = x[ok], p[ok]
    begin = x - ix.behind(x, x + p)
    end = x + ix.ahead(x, x + p) + p
    ok = end - begin >= np.maximum(least, times * p)
    found = np.stack([begin[ok], end[ok], p[ok]], 1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]
    return found[new]  # a multiple of the period gives the same stretch


def copied_runs(found: list[tuple[int, int, int]], start: list[int], length: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """The runs of one text, from those at boundaries: blocks take over what lies strictly inside their earlier occurrence."""
    bucket: dict[int, dict[int, int]] = {}
    for i, j, p in found:
        bucket.setdefault(i, {})[j] = p
    at = sorted(bucket)
    for s, n, src in zip(start, length, source, strict=True):
        k = bisect.bisect_right(at, src)
        while k < len(at) and at[k] < src + n:
            i = at[k]
            for j, p in list(bucket[i].items()):
                if j < src + n:
                    to = i + s - src
                    if to not in bucket:
                        bucket[to] = {}
                        bisect.insort(at, to)
                    bucket[to].setdefault(j + s - src, p)
            k += 1
    return sorted((i, j, p) for i in at for j, p in bucket[i].items())


def runs_of(word: np.ndarray, doc: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (from, to, period) of each text that has some, by the text's number; places count from the text's start.

    word: hashes; doc: text of each word; first: where each text starts, and the end.
    """
    if not len(word):
        return {}
    ix = Index(word, doc, first)
    longest, source = ix.previous_factors()
    start = blocks(longest)
    found = boundary_runs(ix, start, first, least, times)
    out = {}
    of = doc[found[:, 0]]
    for d in np.unique(of).tolist():
        base = int(first[d])
        mine = start[slice(*np.searchsorted(start, first[d : d + 2]))]
        mine = mine[longest[mine] >= least + 2]
        rows = [tuple(r) for r in (found[of == d] - [base, base, 0]).tolist()]
        out[d] = copied_runs(rows, (mine - base).tolist(), longest[mine].tolist(), (source[mine] - base).tolist())
    return out


def planted(doc_id, n: int) -> tuple[int, int] | None:
    """(a, p) of a text of n words whose words from a on repeat with period p, by the contract of the query; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def digest(raw: bytes, runs: list[tuple[int, int, int]], take: np.ndarray | None) -> tuple:
    """DIGEST of one text; take: the original word at each place, where it isn't its own."""
    if not runs and take is None:
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(raw.split())).hexdigest()
    words = raw.split()
    if take is not None:
        words = [words[i] for i in take.tolist()]
    top = (None,) * 4
    if runs:
        i, j, p = min(runs, key=lambda r: (Fraction(r[0] - r[1], r[2]), r[0], r[2]))
        top = i, j - i, p, 1000 * (j - i) // p
        drop = np.zeros(len(words) + 1, np.int64)
        for i, j, p in runs:
            drop[i + p] += 1
            drop[j] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
    told = "".join(f"{i},{j - i},{p}\n" for i, j, p in sorted(runs, key=lambda r: (r[0], r[2])))
    return len(runs), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def digests(data: np.ndarray, off: np.ndarray, plant: list, least: int = LEAST, times: int = TIMES) -> list[tuple]:
    """DIGEST of each text of a chunk; plant: a doc_id for each, or None, for `planted`."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start, end = tc.runs(~space, off)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    word = tc.span_hash(tc.prefix_hash(data), start, end)
    take: dict[int, np.ndarray] = {}
    for d, (i, n) in enumerate(zip(plant, np.diff(first).tolist(), strict=True)):
        if got := planted(i, n):
            a, p = got
            k = np.arange(n)
            take[d] = np.where(k < a, k, a + (k - a) % p)
            word[first[d] : first[d + 1]] = word[first[d] + take[d]]
    runs = runs_of(word, doc, first, least, times)
    raw = data.tobytes()
    return [digest(raw[a:b], runs.get(d, []), take.get(d)) for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))]


def periodic_runs(docs: DataFrame, text: str = "text", plant: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`docs` without the text column, with DIGEST of it; columns of these names are replaced.

    plant: a column of doc_ids that `planted` changes texts by, as the query's contract asks.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in DIGEST.split(", ")]
    rest = [c for c in docs.columns if c not in (*names, text)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("__none"))
    src = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), (plant if plant is not None else F.lit(None)).cast("long").alias("plant"))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            ids = b.column(2).to_pylist()
            for i, j, data, off in tc.chunks(b.column(1)):
                out += digests(data, off, ids[i:j], least, times)
            cols = zip(*out, strict=True) if out else [[] for _ in names]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]], names=["row", *names])

    schema = src.select("row").schema
    for x in DIGEST.split(", "):
        schema = schema.add(*x.split())
    got = src.mapInArrow(run, schema)
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *names)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs.select("doc_id", "text"), plant=F.col("doc_id"))
