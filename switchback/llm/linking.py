"""From signatures to components, without pairs of a whole group.

Steps, all distributed:
1. `bucket_members`: band keys are dealt out in packed arrays, sorted inside tasks, and the
   buckets with two items or more are kept. Buckets that are large within one map task
   leave it as members at once, so a hot bucket's home task gets few of its rows. Buckets
   with the same items get the same number and are looked at once;
2. `_verified`: a bucket of at most BLOCK items and BLOCK_BYTES of text is settled inside a
   task: all pairs whose estimate passes are verified exactly, unless verified ones join the
   two already. Only links that hold leave the task, fewer than its items;
3. larger buckets are dealt over cells of that size by salt; one item of each component of
   a cell goes on, and these meet in further rounds while a round joins a tenth of them;
4. `cross_links` makes up for what step 3 left out: in every large bucket that several
   components share, every two cells meet in a task, and all pairs of different components
   whose estimate passes are verified. A pair in several large buckets is tried in the
   first of its bands;
5. `components`: links are contracted in pieces inside tasks, then large-star and small-star
   rounds join what the pieces left apart.

So every pair that shares a bucket and has enough equal samples is verified or is joined
by pairs that were: nothing is capped, thinned before it is verified, or tried in part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import Workspace, tasks_for

BLOCK = 1024
BLOCK_BYTES = 1 << 23  # text of a bucket that one task settles
PART = 1 << 22  # bytes of text prepared at once for exact checks inside a task
ASK = 64  # pairs of an item verified at once
DEAL = 1 << 20  # band rows sorted and sent at once
LOCAL = 256  # rows of a bucket in DEAL that make it hot
FEWER = 0.9  # items that a round of cells may leave of those before; else cross_links does the rest
CELL_ROWS = 512  # items of cells for a task
EDGES = 1 << 15  # links for a task of a shuffle
PIECE = 1 << 18  # links that one task contracts

SIGNED = "key long, size tinyint, sig binary, text string"  # what an operator gives: size is log2 of the text's bytes; text may be any binary that its compare reads
_LOW = np.uint64(0xFFFFFFFF)


def log_size(n_bytes: np.ndarray) -> np.ndarray:
    """Size of texts as the exponent of the next power of two."""
    return np.ceil(np.log2(np.maximum(n_bytes, 1))).astype(np.int8)


def binary_rows(x: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as a binary column."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _array_rows(col, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of sorted columns begins, and the end."""
    n = len(cols[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for c in cols:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def _deal(band_keys: Callable, width: int, dtype, many: int):
    """mapInArrow: signatures to packed band rows (part, kind, rows) of `many` parts.

    kind 0 rows are (bucket within the part, size, key); kind 1 rows (bucket, size, key) are of
    buckets that are large here; a kind 2 row tells the part of such a bucket that it has an item.
    """

    def pack(part, kind, bucket, size, key, out):
        cut = _runs(part)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            low = bucket[a:b] if kind == 1 else (bucket[a:b] & _LOW).astype(np.uint32)
            out.append((int(part[a]), kind, low.tobytes() + size[a:b].tobytes() + key[a:b].tobytes()))

    def flush(keys, sizes, sigs):
        key, first = np.unique(np.concatenate(keys), return_index=True)
        bands = band_keys(np.concatenate(sigs)[first])
        bucket = fold(bands.ravel(), many)
        key = np.repeat(key, bands.shape[1])
        size = np.repeat(np.concatenate(sizes)[first], bands.shape[1])
        order = np.argsort(bucket, kind="stable")
        bucket, key, size = bucket[order], key[order], size[order]
        cut = _runs(bucket)
        n = np.diff(cut)
        large = np.repeat(n > LOCAL, n)
        out: list[tuple] = []
        pack((bucket[~large] >> np.uint64(32)).astype(np.int64), 0, bucket[~large], size[~large], key[~large], out)
        if large.any():
            head = cut[:-1][n > LOCAL]
            pack((bucket[head] >> np.uint64(32)).astype(np.int64), 2, bucket[head], size[head], key[head], out)
            b, s, k = bucket[large], size[large], key[large]
            part = (tc.mix(k.view(np.uint64)) % np.uint64(many)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            pack(part[order], 1, b[order], s[order], k[order], out)
        part, kind, rows = zip(*out, strict=True)
        return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "rows": pa.array(rows, pa.binary())})

    def run(batches):
        keys, sizes, sigs, have = [], [], [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            keys.append(b.column(0).to_numpy())
            sizes.append(b.column(1).to_numpy())
            sigs.append(_array_rows(b.column(2), width, dtype))
            have += b.num_rows
            if have * width >= DEAL * 3:  # three samples a band
                yield flush(keys, sizes, sigs)
                keys, sizes, sigs, have = [], [], [], 0
        if have:
            yield flush(keys, sizes, sigs)

    return run


def fold(bands: np.ndarray, many: int) -> np.ndarray:
    """Bucket numbers: the part (of `many`) in the upper half, 32 bits of the band key below."""
    x = bands.view(np.uint64)
    return (((x >> np.uint64(32)) % np.uint64(many)) << np.uint64(32)) | (x & _LOW)


def _unpack(rows: list[bytes], bucket_type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.dtype(bucket_type).itemsize
    cols = [], [], []
    for r in rows:
        n = len(r) // (w + 9)
        cols[0].append(np.frombuffer(r, bucket_type, n))
        cols[1].append(np.frombuffer(r, np.int8, n, n * w))
        cols[2].append(np.frombuffer(r, np.int64, n, n * (w + 1)))
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, (bucket_type, np.int8, np.int64), strict=True))


def _gather(block: int, block_bytes: int):
    """mapInArrow over packed rows sorted by part: (bucket, salt, key, size) of buckets with two keys.

    bucket is a number made of the keys in it, or for a bucket that is too large for a block
    (salt 0) its own. Buckets of equal items thus become repeated rows.
    """
    def settle(held, part):
        bucket, size, key = _unpack(held.get(1, []), np.uint64)
        out = [(bucket, np.zeros(len(key), np.int64), key, size)]
        low, size, key = _unpack(held.get(0, []), np.uint32)
        mark_low, mark_size, mark_key = _unpack(held.get(2, []), np.uint32)
        low, size, key = np.append(low, mark_low), np.append(size, mark_size), np.append(key, mark_key)
        mark = np.zeros(len(low), bool)
        mark[len(low) - len(mark_low) :] = True
        order = np.argsort(low)
        cut = _runs(low[order])
        order = order[np.repeat(np.diff(cut) > 1, np.diff(cut))]
        order = order[np.lexsort((mark[order], key[order], low[order]))]
        same = (low[order][1:] == low[order][:-1]) & (key[order][1:] == key[order][:-1])
        hot = np.isin(low[order], mark_low)
        order, hot = order[~np.append(False, same)[: len(order)]], hot[~np.append(False, same)[: len(order)]]
        cut = _runs(low[order])
        n = np.diff(cut)
        keep = np.repeat(n > 1, n)
        order, hot = order[keep], hot[keep]
        cut = _runs(low[order])
        if len(order):
            n = np.diff(cut)
            k = key[order]
            name = np.add.reduceat(tc.mix(k.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), cut[:-1])
            own = low[order].astype(np.uint64) | (np.uint64(part) << np.uint64(32))
            weight = np.add.reduceat(np.exp2(size[order].astype(np.float64)), cut[:-1])
            big = np.repeat((n > block) | (weight > block_bytes), n) | hot
            out.append((np.where(big, own, np.repeat(name, n)), np.where(big, 0, -1), k, size[order]))
        b, s, k, z = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(b.view(np.int64)), "salt": pa.array(s), "key": pa.array(k), "size": pa.array(z)})

    def run(batches):
        held: dict[int, list[bytes]] = {}
        part = None
        for batch in batches:
            for p, kind, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != part and held:
                    yield settle(held, part)
                    held = {}
                part = p
                held.setdefault(kind, []).append(rows)
        if held:
            yield settle(held, part)

    return run


MEMBERS = "bucket long, salt long, key long, size tinyint"


def parts_of(sigs: DataFrame, bands: int) -> tuple[int, int]:
    """(tasks, parts): parts of about DEAL band rows, a whole number a task."""
    tasks = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks, tasks * max(1, -(-sigs.count() * bands // (tasks * DEAL)))


def bucket_members(ws: Workspace, sigs: DataFrame, band_keys: Callable, width: int, dtype, tasks: int, parts: int) -> DataFrame:
    """Distinct (bucket, salt, key, size) of all buckets with two keys; salt is 0 for large buckets, else -1."""
    dealt = sigs.select("key", "size", "sig").mapInArrow(_deal(band_keys, width, dtype, parts), "part int, kind int, rows binary")
    dealt = dealt.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")
    return ws.write(dealt.mapInArrow(_gather(BLOCK, BLOCK_BYTES), MEMBERS).distinct(), "members")


def whole_blocks(batches) -> Iterator[pa.Table]:
    """Tables of rows sorted by their first two columns that hold whole runs of them."""
    held: list[pa.RecordBatch] = []  # of the last, open run
    for b in batches:
        if b.num_rows == 0:
            continue
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = int(_runs(x, y)[-2])
        goes_on = held and held[0].column(0)[0].as_py() == x[0] and held[0].column(1)[0].as_py() == y[0]
        if cut or (held and not goes_on):
            yield pa.Table.from_batches(held + ([b.slice(0, cut)] if cut else []))
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class _Blocks:
    """Columns of a table of blocks (bucket, salt, key, sig, ...), repeated items taken out."""

    def __init__(self, t: pa.Table, width: int, dtype):
        t = t.combine_chunks()
        bucket, salt, key = (t.column(k).to_numpy() for k in range(3))
        first = _runs(bucket, salt, key)[:-1]
        if len(first) < len(key):
            t = t.take(pa.array(first)).combine_chunks()
            bucket, salt, key = bucket[first], salt[first], key[first]
        self.table, self.bucket, self.salt, self.key = t, bucket, salt, key
        self.sig = _array_rows(t.column(3), width, dtype)
        self.cuts = _runs(bucket, salt)


def _pairs(sig: np.ndarray, need: int, comp: np.ndarray | None = None, side: np.ndarray | None = None, bands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(items, earlier items), sorted, of pairs of a block that resemble each other.

    With comp, only those of different components; with side, of different cells; with bands
    (the band keys before the block's own), only those that none of them unites.
    """
    one, two = [], []
    for i in range(1, len(sig)):
        ok = np.count_nonzero(sig[:i] == sig[i], axis=1) >= need
        for label in (comp, side):
            if label is not None:
                ok &= label[:i] != label[i]
        j = np.flatnonzero(ok)
        if bands is not None and len(j):
            j = j[~(bands[j] == bands[i]).any(axis=1)]
        one.append(np.full(len(j), i))
        two.append(j)
    return _cat(one), _cat(two)


def _cat(parts: list) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _block_pairs(sig: np.ndarray, cuts: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of resembling items of all blocks, sorted; blocks of few items are compared at once."""
    size = np.diff(cuts)
    small = (size > 1) & (size <= 32)
    items = np.repeat(small, size)
    start = np.repeat(cuts[:-1], size)
    n = np.where(items, np.arange(len(items)) - start, 0)  # earlier items of the block
    i = np.repeat(np.arange(len(items)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[i]
    one, two = [], []
    for a in range(0, len(i), 1 << 16):
        x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        like = np.count_nonzero(sig[x] == sig[y], axis=1) >= need
        one.append(x[like])
        two.append(y[like])
    for a, b in zip(cuts[:-1][size > 32].tolist(), cuts[1:][size > 32].tolist(), strict=True):
        x, y = _pairs(sig[a:b], need)
        one.append(a + x)
        two.append(a + y)
    i, j = _cat(one), _cat(two)
    order = np.lexsort((j, i))
    return i[order], j[order]


def _merge(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked components one label; labels are indexes."""
    while True:
        x, y = comp[a], comp[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        up = np.arange(len(comp))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
        comp[:] = up[comp]


def _unite(i: np.ndarray, j: np.ndarray, comp: np.ndarray, same: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of pairs sorted by i; comp is kept up to date.

    Each turn verifies the next few pairs of every item, without those that links join already.
    """
    one, two, ask = [], [], 1
    while True:
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return _cat(one), _cat(two)
        cut = _runs(i)
        now = np.arange(len(i)) - np.repeat(cut[:-1], np.diff(cut)) < ask
        a, b = i[now], j[now]
        ok = same(a, b)
        a, b = a[ok], b[ok]
        x, y = comp[a], comp[b]
        first = np.unique(np.minimum(x, y) * len(comp) + np.maximum(x, y), return_index=True)[1]  # one link for two components
        one.append(a[first])
        two.append(b[first])
        _merge(comp, a[first], b[first])
        i, j = i[~now], j[~now]
        ask = min(2 * ask, ASK)


def shared(keys: np.ndarray, cut: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Common elements of pairs of sets: (part of the pairs, pair within it, places of the element in i's and j's set).

    keys are all sets one after another, sorted, the set's number above SET_BITS; cut has their bounds.
    """
    size = np.diff(cut)
    swap = size[i] > size[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    n = size[a]
    ends = np.cumsum(n)
    mask = np.uint64((1 << SET_BITS) - 1)
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + (1 << 20), "right")))
        m = n[lo:hi]
        pair = np.repeat(np.arange(hi - lo), m)
        x = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + cut[a[lo:hi]][pair]
        want = (keys[x] & mask) | (b[lo:hi][pair].astype(np.uint64) << np.uint64(SET_BITS))
        y = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = np.flatnonzero(keys[y] == want)
        pair, x, y = pair[hit], x[hit], y[hit]
        back = swap[lo:hi][pair]
        yield slice(lo, hi), pair, np.where(back, y, x), np.where(back, x, y)
        lo = hi


SET_BITS = 50  # of an element; MAX_SETS sets have numbers above them
MAX_SETS = 1 << (64 - SET_BITS)


def _groups(length: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole blocks with about PART bytes of text and fewer than MAX_SETS items each."""
    total = np.append(0, np.cumsum(length))[cuts]
    k = 0
    while k < len(cuts) - 1:
        m = max(k + 1, int(np.searchsorted(total, total[k] + PART, "right")) - 1)
        m = max(k + 1, min(m, int(np.searchsorted(cuts, cuts[k] + MAX_SETS, "right")) - 1))
        yield int(cuts[k]), int(cuts[m])
        k = m


def _verified(need: int, width: int, dtype, compare: Callable):
    """mapInArrow over (bucket, salt, key, sig, text): links (0, key, other) that hold.

    For blocks of large buckets (salt >= 0) one item of each component follows as a link to itself.
    """

    def settle(v: _Blocks):
        comp = np.arange(len(v.key))
        text = v.table.column(4).chunk(0)
        i, j = _block_pairs(v.sig, v.cuts, need)
        one, two = [], []
        for x, y in _groups(pc.binary_length(text).to_numpy(zero_copy_only=False), v.cuts):
            mine = slice(*np.searchsorted(i, [x, y]))
            if mine.start == mine.stop:
                continue
            ends = np.unique(np.concatenate([i[mine], j[mine]]))
            same = compare(text.take(pa.array(ends)))
            a, b = _unite(i[mine], j[mine], comp, lambda p, q, ends=ends, same=same: same(np.searchsorted(ends, p), np.searchsorted(ends, q)))
            one.append(v.key[a])
            two.append(v.key[b])
        a, b = _cat(one), _cat(two)
        hot = np.flatnonzero(v.salt >= 0)
        size = np.diff(v.cuts)
        block = np.repeat(np.arange(len(size)), size)[hot]
        order = np.lexsort((v.key[hot], comp[hot], block))
        at = hot[order][_runs(block[order], comp[hot][order])[:-1]]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(np.zeros(len(a), np.int64), v.bucket[at])), "key": pa.array(np.append(np.maximum(a, b), v.key[at])), "other": pa.array(np.append(np.minimum(a, b), v.key[at]))})

    def run(batches):
        for t in whole_blocks(batches):
            yield settle(_Blocks(t, width, dtype))

    return run


MADE = "bucket long, key long, other long"


def _settle(ws: Workspace, rows: DataFrame, items: DataFrame, run: Callable, schema: str, name: str, tasks: int | None = None) -> DataFrame:
    """Run over whole blocks of rows (bucket, salt, key, ...) with the items' sig and text."""
    full = rows.join(items, "key")
    more = [c for c in rows.columns if c not in ("bucket", "salt", "key")]
    full = full.select("bucket", "salt", "key", *[c for c in ("sig", "text") if c in items.columns], *more)
    dealt = full.repartition(tasks, "bucket", "salt") if tasks else full.repartition("bucket", "salt")
    return ws.write(dealt.sortWithinPartitions("bucket", "salt", "key").mapInArrow(run, schema), name, tasks)


def find_classes(ws: Workspace, sigs: DataFrame, band_keys: Callable, need: int, width: int, dtype, compare: Callable) -> DataFrame:
    """(key, root) of the texts behind `sigs` (SIGNED) that a verified link joins to others.

    Rows of one key are the same text and may repeat. compare(column of texts) returns a
    function of two arrays of the texts' indexes that says of each pair whether it holds.
    """
    bands = band_keys(np.zeros((1, width), dtype)).shape[1]
    tasks, parts = parts_of(sigs, bands)
    members = bucket_members(ws, sigs, band_keys, width, dtype, tasks, parts)
    items = items_of(ws, sigs, members)
    hot = members.where("salt = 0").select("bucket", "key", "size")
    rows = members.where("salt < 0").select("bucket", "salt", "key")
    is_hot = not hot.isEmpty()
    if is_hot:
        rows = rows.unionByName(_cells(hot, 0))
    run = _verified(need, width, dtype, compare)
    made = _settle(ws, rows, items, run, MADE, "made-0")
    links = made.where("key <> other").select("key", "other")
    if not is_hot:
        return components(ws, links)
    step, last, reps = 0, None, hot
    while True:
        several = reps.groupBy("bucket").agg(cell_count().alias("cells")).where("cells > 1").select("bucket")
        reps = ws.write(made.where("key = other").select("bucket", "key").join(several, "bucket").join(hot, ["bucket", "key"]), f"reps-{step}")
        now, step = reps.count(), step + 1
        if not now or (last is not None and now > FEWER * last):  # those that haven't met do so in cross_links
            break
        last = now
        made = _settle(ws, _cells(reps, step), items, run, MADE, f"made-{step}", tasks_for(ws.spark, now, CELL_ROWS))
        links = links.unionByName(made.where("key <> other").select("key", "other"))
    roots = ws.write(components(ws, links, "hot-cc"), "roots")
    more = cross_links(ws, hot, roots, items, lambda s: fold(band_keys(s), parts), need, width, dtype, compare)
    if more is None:
        return roots
    return components(ws, roots.where("key <> root").select("key", F.col("root").alias("other")).unionByName(more))


def _cells(rows: DataFrame, step: int) -> DataFrame:
    """(bucket, salt, key): rows (bucket, key, size) of large buckets dealt over cells of a block's size."""
    cells = rows.groupBy("bucket").agg(cell_count().alias("cells"))
    return rows.join(cells, "bucket").select("bucket", F.pmod(F.xxhash64("key", F.lit(step)), F.col("cells")).alias("salt"), "key")


def cell_count():
    """Cells of half a block and half its bytes."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / (BLOCK // 2), F.sum(F.exp(F.col("size") * float(np.log(2)))) / (BLOCK_BYTES // 2))).cast("long")


BITS = 27  # of the largest filter of keys: 16 MB


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bits of a long column's low bits, about sixteen a row: a filter that passes all its values."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, df.count()))), 12, BITS))
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    words = df.select(low.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"w": [b.column(0).to_numpy().tobytes()], "m": [b.column(1).to_numpy().tobytes()]}) for b in bs), "w binary, m binary").toLocalIterator():
        out[np.frombuffer(r.w, np.int64)] = np.frombuffer(r.m, np.uint64)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    b = values.astype(np.int64) & (64 * len(bits) - 1)
    return (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) > 0


def items_of(ws: Workspace, sigs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, sig, text), once a key, of the keys of `members`; a filter of bounded size spares most others the shuffle."""
    keys = members.select("key").distinct()
    shared = sigs.sparkSession.sparkContext.broadcast(bitmap(keys, "key"))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(shared.value, b.column(0).to_numpy())))

    rows = sigs.select("key", "sig", "text").mapInArrow(run, sigs.select("key", "sig", "text").schema)
    return ws.write(rows.groupBy("key").agg(F.first(F.struct("sig", "text")).alias("v")).select("key", "v.sig", "v.text"), "items")


def cross_links(ws: Workspace, members: DataFrame, roots: DataFrame, items: DataFrame, buckets: Callable, need: int, width: int, dtype, compare: Callable) -> DataFrame | None:
    """Verified links between items of different roots of large buckets; members has (bucket, key, size).

    The largest root of a bucket has cells of its own, which needn't meet one another: its
    items are copied to few tasks.
    """
    labelled = ws.write(members.join(roots, "key", "left").select("bucket", "key", "size", F.coalesce("root", "key").alias("root")), "labelled")
    shares = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), cell_count().alias("cells"))
    mixed = shares.groupBy("bucket").agg(F.sum("cells").alias("all"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("n"), F.max(F.struct("c", "root", "cells")).alias("top")).where("roots > 1").select("bucket", "all", "n", "top")
    rest = labelled.join(mixed, "bucket").where("root <> top.root").groupBy("bucket").agg(cell_count().alias("rest_cells"))
    mixed = ws.write(mixed.join(rest, "bucket").select("bucket", F.col("top.root").alias("top"), "rest_cells", F.col("top.cells").alias("top_cells")), "mixed")
    if mixed.isEmpty():
        return None
    is_top = F.col("root") == F.col("top")
    side = F.when(is_top, F.col("rest_cells") + F.pmod(F.xxhash64("key"), "top_cells")).otherwise(F.pmod(F.xxhash64("key"), "rest_cells"))
    cells = F.col("rest_cells") + F.col("top_cells")
    meets = F.sequence(F.lit(0).cast("long"), F.when(is_top, F.col("rest_cells")).otherwise(cells) - 1)
    rows = labelled.join(mixed, "bucket").withColumn("side", side.cast("long")).withColumn("cells", cells)
    rows = rows.select("bucket", F.explode(F.transform(meets, lambda c: (F.least(c, "side") * F.col("cells") + F.greatest(c, "side")).cast("long"))).alias("salt"), "key", "root", "side")

    def pairs_of(v, root, side, x, y):
        own = buckets(v.sig[x:y])
        band = int(np.flatnonzero(own[0] == np.int64(v.bucket[x]).view(np.uint64))[0])
        apart = side[x:y] if (side[x:y] != side[x]).any() else None  # items of one cell meet in the task of this cell only
        return _pairs(v.sig[x:y], need, root[x:y], apart, own[:, :band] if band else None)

    def ends(batches):
        for t in whole_blocks(batches):
            v = _Blocks(t, width, dtype)
            root, side = v.table.column(4).to_numpy(), v.table.column(5).to_numpy()
            keep = np.zeros(len(v.key), bool)
            for x, y in zip(v.cuts[:-1].tolist(), v.cuts[1:].tolist(), strict=True):
                for at in pairs_of(v, root, side, x, y):
                    keep[x + at] = True
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(v.bucket[at]), "salt": pa.array(v.salt[at]), "key": pa.array(v.key[at]), "root": pa.array(root[at]), "side": pa.array(side[at])})

    found = _settle(ws, rows, items.select("key", "sig"), ends, "bucket long, salt long, key long, root long, side long", "cross-ends")
    if found.isEmpty():
        return None

    def links(batches):
        for t in whole_blocks(batches):
            v = _Blocks(t, width, dtype)
            text, root, side = v.table.column(4).chunk(0), v.table.column(5).to_numpy(), v.table.column(6).to_numpy()
            length = pc.binary_length(text).to_numpy(zero_copy_only=False)
            one, two = [], []
            for x, y in zip(v.cuts[:-1].tolist(), v.cuts[1:].tolist(), strict=True):
                i, j = pairs_of(v, root, side, x, y)
                comp = np.unique(root[x:y], return_inverse=True)[1]
                part = np.maximum(np.cumsum(length[x:y]) // PART, np.arange(y - x) // (MAX_SETS // 2))
                for p in np.unique(part).tolist():
                    for q in np.unique(part[part <= p]).tolist():
                        own = np.flatnonzero((part == p) | (part == q))
                        same = compare(text.take(pa.array(x + own)))
                        some = (part[i] == p) & (part[j] == q)
                        a, b = _unite(i[some], j[some], comp, lambda s, t, own=own, same=same: same(np.searchsorted(own, s), np.searchsorted(own, t)))
                        one.append(v.key[x + a])
                        two.append(v.key[x + b])
            a, b = _cat(one), _cat(two)
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.maximum(a, b)), "other": pa.array(np.minimum(a, b))})

    more = _settle(ws, found, items, links, "key long, other long", "cross-links")
    return None if more.isEmpty() else more


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """(u, v), u > v: pieces of about PIECE links, each as stars around the smallest keys of its own components."""

    def stars(held):
        key, ends = np.unique(np.concatenate(held), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        comp = np.arange(len(key))
        _merge(comp, a, b)
        out = np.flatnonzero(comp != np.arange(len(key)))
        return pa.RecordBatch.from_pydict({"u": pa.array(key[out]), "v": pa.array(key[comp[out]])})

    def run(batches):
        held, have = [], 0
        for b in batches:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1).ravel())
            have += b.num_rows
            if have >= 2 * PIECE:
                yield stars(held)
                held, have = [], 0
        if have:
            yield stars(held)

    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def _with_roots(stars: DataFrame) -> DataFrame:
    """(key, root) of stars (u, v), roots included."""
    return stars.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def components(ws: Workspace, links: DataFrame, tag: str = "cc") -> DataFrame:
    """(key, root) for every key in a link; root is the smallest key of its component.

    Pieces of the links are contracted inside tasks first, then large-star and small-star
    alternate until nothing changes; each round is written to the shared folder.
    """

    def state(edges):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    raw = ws.write(links.select(F.col("key").alias("u"), F.col("other").alias("v")).where("u <> v"), f"{tag}-links")
    pieces = -(-raw.count() // PIECE) or 1
    edges = contracted(raw, pieces)
    edges = ws.write(edges if pieces == 1 else edges.distinct(), f"{tag}-0")
    ws.drop(f"{tag}-links")
    if pieces == 1:  # one piece holds all links, so its stars are the components
        return _with_roots(edges)
    step, seen = 0, state(edges)
    tasks = tasks_for(ws.spark, seen[0], EDGES)
    while True:
        # lows are tables of their own: the join of an item that many links share can then be split
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-low-{step}", tasks)
        large = ws.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{tag}-large-{step}", tasks)
        low = ws.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-least-{step}", tasks)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        edges = ws.write(small, f"{tag}-{step}", tasks)
        ws.drop(*[f"{tag}-{x}{step - 1}" for x in ("", "low-", "large-", "least-")])
        now = state(edges)
        if now == seen:
            return _with_roots(edges)
        seen = now
