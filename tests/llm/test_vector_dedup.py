import numpy as np
import pytest

from switchback.llm import vector_dedup


def by_definition(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) with all pairs."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        unit.append(x / np.abs(x).max() if ok else None)
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    comp = list(range(n))
    for i in range(n):
        if comp[i] == i:
            todo = [i]
            while todo:
                for k in links[todo.pop()]:
                    if comp[k] > i:
                        comp[k] = i
                        todo.append(k)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if comp[k] == comp[i] and rows[k][0] is not None]
        out.append((vec_id, len(links[i]), min(ids, default=None), vec_id is not None and vec_id == min(ids)))
    return out


def at_cosine(rng, a, c):
    u = rng.normal(size=a.shape)
    u -= (u @ a) * a / (a @ a)
    return c * a / np.linalg.norm(a) + np.sqrt(1 - c * c) * u / np.linalg.norm(u)


def corpus(rng, dim=64):
    """Unlike vectors, chains, scaled and equal ones, and a group that is large for a tile."""
    out = [rng.normal(size=dim) for _ in range(500)]
    for a in out[:60]:
        b = at_cosine(rng, a, rng.choice([0.93, 0.949, 0.951, 0.97, 0.999]))
        out += [b, at_cosine(rng, b, 0.955)]
    out += [3 * out[5], out[6], out[6], out[7] * 1e-3, -out[8]]
    centre = rng.normal(size=dim)
    out += [at_cosine(rng, centre, rng.uniform(0.96, 0.999)) for _ in range(150)]
    return [x.astype(np.float32) for x in out]


AWKWARD = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] + [1.0] * 63), (9005, [None] + [1.0] * 63), (9006, [float("inf")] * 64), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (None, [1.0, 2.0]), (9009, [1.0, 2.0] + [0.0] * 62), (9010, [1e-30] * 64), (9011, [1e30] * 64), (9012, [-0.0, 1.0]), (9013, [0.0, 1.0])]


@pytest.fixture()
def few_tiles(monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 64)


def test_query_equals_the_definition(spark, folder, few_tiles):
    rng = np.random.default_rng(4)
    x = corpus(rng)
    ids = rng.permutation(5000)[: len(x)].tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + AWKWARD + [(ids[5], x[5].tolist()), (ids[9], x[11].tolist())]
    folder.write("embeddings", spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(6))
    got = vector_dedup.op11_vector_dedup(spark, folder.path)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, by_definition(rows)))


def test_doubles_null_ids_and_small_tables(spark):
    schema = "v array<double>, vec_id string, key int, list int"
    rows = [([1e200, 1e200], None, 1, 1), ([1e-200, 1e-200], None, 1, 1), ([1.0, -1.0], "3", 1, 1), ([1.0, -1.0000000001], "2", 1, 1)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, schema), "v").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, 1, None, False), (None, 1, None, False), (3, 1, 2, False), (2, 1, 2, True)]))
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema), "v").count() == 0
    one = vector_dedup.near_vectors(spark.createDataFrame(rows[2:3], schema), "v").collect()
    assert [tuple(r) for r in one] == [(3, 0, 3, True)]
    none = vector_dedup.near_vectors(spark.createDataFrame([(None, "7", 1, 1)], schema), "v").collect()
    assert [tuple(r) for r in none] == [(7, 0, 7, True)]


@pytest.mark.parametrize("flat", [64, 12])
def test_pairs_at_the_least_cosine_meet_and_pass(flat):
    """Recall of probes and codes, measured on pairs that the index wasn't fitted with."""
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(flat, 64))
    x = rng.normal(size=(8000, flat)) @ basis
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = vector_dedup.Index(x[:4000], 90, 0.95)
    a = x[4000:6000]
    b = np.array([at_cosine(rng, y, 0.9500001) for y in a]) if flat == 64 else None
    if b is None:  # inside the vectors' own subspace
        u = x[6000:] - (x[6000:] * a).sum(1, keepdims=True) * a
        b = 0.9500001 * a + np.sqrt(1 - 0.9500001**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    a, b = a.astype(np.float32), b.astype(np.float32)
    own_a, near_a, *_ = ix.place(a)
    own_b, near_b, code, error, square = ix.place(b)
    rows = np.arange(len(a))
    assert ((own_a == own_b) | near_a[rows, own_b] | near_b[rows, own_a]).mean() >= 0.99
    ok = ix.passing(a[:500], ix.tables(a[:500]), own_b[:500], code[:500], error[:500], square[:500])
    assert np.diag(ok).all() and ok.mean() < 0.1
