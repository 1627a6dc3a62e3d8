"""Embedding near-dedup (operator 11): product quantisation behind coarse lists, exact cosine at the end.

1. Equal vectors become one with a weight. The index is fitted on a bounded sample: coarse
   centroids (about the square root of the vectors), and codebooks of the residuals' subspaces.
   Every vector is indexed: its list, a code of a byte for each eight dimensions, the code's error.
2. Probes: a vector's code goes to every list whose centroid scores within `margin` of its own.
   The margin is fitted so that all of PAIRS made pairs at exactly the least cosine meet in a list
   of either one; a made pair leans from one sampled vector towards another.
3. In a list, the vectors that live there ask the codes that came: dot products are looked up in
   tables of each asking vector by subspace. If |a - b| <= r, then |a - code of b| <= r + error of
   b, so what is left out by that bound can't be a pair, and few others are left in.
4. Vectors whose code passed for somebody are sent to that list, and cosines are computed in double
   precision. A task adds up links by vector and joins components; no pair leaves it. A pair that
   meets in both vectors' lists is counted for each of the two where that one lives.
5. Links are joined to components by rounds on the shared folder.

A list of over `tile` vectors is split by salt, and its codes go to each piece, so a hot list is
no hot task. A list in which n vectors resemble each other without being equal costs n * n / tile
short rows there: their numbers of links can't be had for less work than comparing them.

Vectors that are null, empty, zero or hold null or non-finite components have no links, and
vectors of different lengths are no pair. Rows of one vec_id are rows of their own, all kept or
none; a null vec_id is never the component's id, and such a row is never kept. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .linking import _merge, components
from .store import Workspace

COSINE = 0.95
SAMPLE = 16  # vectors of the sample for each list
SAMPLE_BYTES = 1 << 26  # of the sample at most
LISTS = 1 << 14
SUB, CODES = 8, 256  # dimensions of a subspace, codewords of its book
PAIRS = 4000
TILE = 1024
ROUNDS = 8
_workers: dict[str, Index] = {}


def unit_rows(vecs: list[bytes], kind: np.dtype, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, filled up with zeros, and the vectors' own lengths."""
    size = np.array([len(v) for v in vecs], np.int64) // kind.itemsize
    out = np.zeros((len(vecs), width))
    flat = np.frombuffer(b"".join(vecs), kind)
    at = np.repeat(np.arange(len(vecs)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out, size


def k_means(x: np.ndarray, k: int, rng) -> np.ndarray:
    """At most k centroids by Lloyd's rounds."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some]) / n[some, None]
    return c


def scores(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Higher for nearer centroids."""
    return x @ c.T - (c * c).sum(axis=1) / 2


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([scores(x[i : i + 4096], c).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids, codebooks of residuals and the probing margin."""

    def __init__(self, x: np.ndarray, lists: int, cosine: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        self.cosine, self.radius = cosine, math.sqrt(2 - 2 * cosine)
        self.coarse = k_means(x, max(1, min(lists, len(x))), rng)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.books = [k_means(rest[:, a : a + SUB], CODES, rng) for a in range(0, x.shape[1], SUB)]
        self.margin = self._margin(x, rng)

    def _margin(self, x: np.ndarray, rng) -> float:
        """The least margin with which all made pairs meet."""
        if len(x) < 2 or len(self.coarse) < 2:
            return 0.0
        i, j = rng.integers(0, len(x), (2, PAIRS))
        a, u = x[i], x[j]
        u = u - (u * a).sum(axis=1, keepdims=True) * a
        size = np.sqrt((u * u).sum(axis=1, keepdims=True))
        ok = size[:, 0] > 1e-3
        a, u = a[ok], u[ok] / size[ok]
        b = self.cosine * a + math.sqrt(1 - self.cosine**2) * u
        worst = 0.0
        for k in range(0, len(a), 500):
            s, t = scores(a[k : k + 500], self.coarse), scores(b[k : k + 500], self.coarse)
            rows = np.arange(len(s))
            gaps = np.minimum(s.max(axis=1) - s[rows, t.argmax(axis=1)], t.max(axis=1) - t[rows, s.argmax(axis=1)])
            worst = max(worst, float(gaps.max()))
        return worst

    def place(self, x: np.ndarray):
        """(list, lists that it probes besides, code, error of the code, squared length of what the code stands for) of each row."""
        s = scores(x, self.coarse)
        own = s.argmax(axis=1)
        near = s >= s[np.arange(len(s)), own][:, None] - self.margin
        near[np.arange(len(s)), own] = False
        rest = x - self.coarse[own]
        code = np.stack([nearest(rest[:, m * SUB : m * SUB + SUB], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)
        made = self.coarse[own] + np.concatenate([book[code[:, m]] for m, book in enumerate(self.books)], 1)
        return own, near, code, np.sqrt(((x - made) ** 2).sum(axis=1)), (made * made).sum(axis=1)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace the products of its codewords with the asking rows: (codewords, rows)."""
        return [book @ x[:, m * SUB : m * SUB + SUB].T for m, book in enumerate(self.books)]

    def passing(self, x: np.ndarray, tables: list[np.ndarray], own: np.ndarray, code: np.ndarray, error: np.ndarray, square: np.ndarray) -> np.ndarray:
        """(codes, asking rows): may be a pair, by the distances looked up."""
        u, inv = np.unique(own, return_inverse=True)
        dot = (self.coarse[u] @ x.T)[inv]
        for m, t in enumerate(tables):
            dot += t[code[:, m]]
        bound = (error + np.float32(self.radius + 1e-3)) ** 2
        return 2 * dot >= (1 + square - bound)[:, None]


def vector_rows(vectors: DataFrame, vec: str, vec_id: str) -> DataFrame:
    """(vec_id, key, vec): the vector's numbers as binary and its hash; both null for one that can't be compared."""
    kind = np.dtype("<f4") if dict(vectors.dtypes)[vec] == "array<float>" else np.dtype("<f8")
    src = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vec}`").cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("v"))

    def run(batches):
        for b in batches:
            col = b.column(1)
            off = col.offsets.to_numpy()
            flat = col.values
            bad = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
            x = np.asarray(flat.fill_null(0)).astype(kind)
            bad = np.append(0, np.cumsum(bad | ~np.isfinite(x)))
            some = np.append(0, np.cumsum(x != 0))
            ok = (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]]) & np.asarray(col.is_valid())
            raw = x.tobytes()
            w = kind.itemsize
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "vec": pa.array([raw[i * w : j * w] if good else None for i, j, good in zip(off[:-1].tolist(), off[1:].tolist(), ok.tolist(), strict=True)], pa.binary())})

    got = src.mapInArrow(run, "vec_id long, vec binary")
    return got.select("vec_id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("key"), "vec")


def fit(ws: Workspace, unique: DataFrame, kind: np.dtype, cosine: float) -> tuple[Index | None, int]:
    """The index, fitted on a sample by hash, and the width of its rows."""
    n, width = unique.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    if not n:
        return None, 0
    width = -(-(width // kind.itemsize) // SUB) * SUB
    most = max(CODES, SAMPLE_BYTES // (4 * width))
    lists = max(1, min(LISTS, math.ceil(math.sqrt(n)), most // SAMPLE))
    want = max(CODES * SAMPLE, SAMPLE * lists)
    share = min(1 << 30, math.ceil((1 << 30) * min(want, most) / n))
    rows = unique.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) < share).orderBy("key").select("vec").limit(2 * most).collect()
    if not rows:
        rows = unique.orderBy("key").select("vec").limit(1).collect()
    return Index(unit_rows([bytes(r.vec) for r in rows], kind, width)[0], lists, cosine), width


def groups(batches):
    """(at, salt, asking rows, batches of the others): runs of rows sorted by at, salt, kind; kind 0 asks."""
    at, asking, done = None, [], True
    for b in batches:
        if not b.num_rows:
            continue
        x, y, z = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]))
        for i, j in zip(cut.tolist(), np.append(cut[1:], b.num_rows).tolist(), strict=True):
            here = int(x[i]), int(y[i])
            if here != at:
                if at is not None and not done:
                    yield at, None, None
                at, asking, done = here, [], True
            if z[i] == 0:
                asking.append(b.slice(i, j - i))
            elif asking:
                yield at, asking if done else None, b.slice(i, j - i)
                done = False
    if at is not None and not done:
        yield at, None, None


def near_vectors(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "vectors")
    kind = np.dtype("<f4") if dict(vectors.dtypes)[vec] == "array<float>" else np.dtype("<f8")
    rows = vector_rows(vectors, vec, vec_id)
    unique = ws.write(rows.where("key is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low")), "unique")
    index, width = fit(ws, unique, kind, cosine)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    shared, tag = spark.sparkContext.broadcast(index), uuid.uuid4().hex

    def mine() -> Index:
        tc.claim(_workers)
        if tag not in _workers:
            _workers.clear()
            _workers[tag] = shared.value
        return _workers[tag]

    def assign(batches):
        ix = mine()
        for b in batches:
            x = unit_rows(b.column(1).to_pylist(), kind, width)[0].astype(np.float32)
            own, near, code, error, square = ix.place(x)
            probes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(near.sum(axis=1))).astype(np.int32)), pa.array(np.nonzero(near)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own.astype(np.int32)), probes, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error.astype(np.float32)), pa.array(square.astype(np.float32))], names=["key", "vec", "w", "list", "probes", "code", "error", "square"])

    placed = ws.write(unique.select("key", "vec", "w").mapInArrow(assign, "key long, vec binary, w long, list int, probes array<int>, code binary, error float, square float"), "placed")
    tile = max(64, min(TILE, (1 << 25) // (4 * CODES * len(index.books))))
    tiles = F.broadcast(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))  # a row a list: LISTS at most
    salt = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    asking = placed.join(tiles, "list").select(F.col("list").alias("at"), salt.alias("salt"), F.lit(0).alias("kind"), "key", "list", "w", "vec", "probes")
    spread = placed.select(F.explode(F.concat(F.array("list"), "probes")).alias("at"), "key", "list", "code", "error", "square")
    codes = spread.join(tiles.withColumnRenamed("list", "at"), "at").select("at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("salt"), F.lit(1).alias("kind"), "key", "list", "code", "error", "square")

    def dealt(left, right, run, schema):
        both = left.unionByName(right, allowMissingColumns=True)
        return both.repartition("at", "salt").sortWithinPartitions("at", "salt", "kind").mapInArrow(run, schema)

    def ask(batches):
        ix = mine()
        for at, first, b in groups(batches):
            if b is None:
                continue
            if first is not None:
                t = pa.Table.from_batches(first).combine_chunks()
                x = unit_rows(t.column("vec").to_pylist(), kind, width)[0].astype(np.float32)
                keys, tables = t.column("key").to_numpy(), ix.tables(x)
            key, own, error, square = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "list", "error", "square"))
            code = np.frombuffer(b"".join(b.column(b.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(len(key), -1)
            wanted = np.zeros(len(key), bool)
            for i in range(0, len(key), 256):
                s = slice(i, i + 256)
                ok = ix.passing(x, tables, own[s], code[s], error[s], square[s])
                j, k = np.nonzero(ok)
                wanted[i + j[key[s][j] != keys[k]]] = True
            found = key[wanted]
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.full(len(found), at[0], np.int32)), "salt": pa.array(np.full(len(found), at[1], np.int32)), "key": pa.array(found)})

    found = ws.write(dealt(asking.select("at", "salt", "kind", "key", "list", "vec"), codes, ask, "at int, salt int, key long"), "found")
    seen = found.join(placed.select("key", "list", "w", "vec"), "key").select("at", "salt", F.lit(1).alias("kind"), "key", "list", "w", "vec")
    wait = asking.join(found.select("at", "salt").distinct(), ["at", "salt"], "left_semi")

    def check(batches):
        def out(key=(), other=None, n=None):
            size = len(key)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.nulls(size, pa.int64()) if other is None else pa.array(other, pa.int64()), pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64())], names=["key", "other", "n"])

        for at, first, b in groups(batches):
            if first is not None:
                t = pa.Table.from_batches(first).combine_chunks()
                x, size = unit_rows(t.column("vec").to_pylist(), kind, width)
                keys, w = t.column("key").to_numpy(), t.column("w").to_numpy()
                col = t.column("probes").combine_chunks()
                probes = np.unique(np.repeat(np.arange(len(keys)), np.diff(col.offsets.to_numpy())) << 32 | col.values.to_numpy()[col.offsets[0].as_py() : col.offsets[-1].as_py()])
                links, comp = np.zeros(len(keys), np.int64), np.arange(len(keys))
            if b is None:
                yield out(keys[links > 0], n=links[links > 0])
                joined = np.flatnonzero(comp != np.arange(len(comp)))
                yield out(keys[joined], other=keys[comp[joined]])
                continue
            y, long = unit_rows(b.column(b.schema.get_field_index("vec")).to_pylist(), kind, width)
            key, own, weight = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "list", "w"))
            for i in range(0, len(key), 256):
                s = slice(i, i + 256)
                j, k = np.nonzero((y[s] @ x.T >= cosine) & (long[s][:, None] == size) & (key[s][:, None] != keys))
                j += i
                np.add.at(links, k, weight[j])
                elsewhere = np.isin(k << 32 | own[j], probes) | (own[j] == at[0])  # there, or as another row here, b asks and a comes
                back = np.zeros(len(key), np.int64)
                np.add.at(back, j[~elsewhere], w[k[~elsewhere]])
                yield out(key[back > 0], n=back[back > 0])
                u, inv = np.unique(j, return_inverse=True)
                both = np.concatenate([comp, len(comp) + np.arange(len(u))])
                _merge(both, k, len(comp) + inv)
                yield out(key[u], other=keys[both[len(comp) :]])
                comp = both[: len(comp)]

    made = ws.write(dealt(wait, seen, check, "key long, other long, n long"), "made")
    sums = made.where("n is not null").groupBy("key").agg(F.sum("n").alias("n"))
    links = made.where("other is not null").select("key", "other")
    roots = unique.select("key", "w", "low") if links.isEmpty() else unique.select("key", "w", "low").join(components(ws, links), "key", "left")
    if "root" not in roots.columns:
        roots = roots.withColumn("root", F.col("key"))
    roots = ws.write(roots.select("key", "w", "low", F.coalesce("root", "key").alias("root")), "roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    told = ws.write(roots.join(lowest, "root").join(sums, "key", "left").select("key", (F.coalesce("n", F.lit(0).cast("long")) + F.col("w") - 1).alias("n_links"), "component_id"), "told")
    got = rows.select("vec_id", "key").join(told, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op11_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
