import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from switchback.llm import decontam, media, mixing
from switchback.llm import textcore as tc
from switchback.llm.store import Workspace, open_fs
from tests.oracle import differences

from .conftest import AWKWARD, prose


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert decontam.lcs(decontam.Passage._masks(np.array(a)), len(a), b) == plain(a, b)


def test_decontamination(spark, make_docs, folder):
    rng = random.Random(3)
    items = [(i, prose(rng, 30) + ". " + prose(rng, 8) + ".") for i in range(20)] + [(50, None), (51, "")]
    clean = [(i, prose(rng, 200), "en", "s") for i in range(40)]
    put = lambda t, n: (lambda w: " ".join(w[:n] + [t] + w[n:]))(prose(rng, 150).split())
    exact = [(100 + k, put(items[k][1], 10 * k % 140), "en", "s") for k in range(20)]
    para = []
    for k in range(20):
        w = items[k][1].split()
        for _ in range(7):
            w[rng.randrange(28)] = prose(rng, 1)
        para.append((200 + k, put(" ".join(w), 60), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["__items"] for r in decontam.contamination(make_docs(clean + exact + para), bench).collect()}
    assert all(got[i] == [] for i in range(40)) and all(got[100 + k] == [k] for k in range(20))
    assert sum(got[200 + k] == [k] for k in range(20)) >= 18
    folder.write("benchmark", bench)
    kept = decontam.pipeline_stage(spark, make_docs(clean + exact), folder.path)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40)) and "__items" not in kept.columns


def test_decontamination_finds_all_that_the_check_accepts(spark, make_docs):
    """Passages of 23 words that keep 13, and a short one of common words, among rare neighbours."""
    rng = random.Random(6)
    common = "we go to the end of it and then on".split()
    clean = [" ".join(rng.sample(common, 8)) + " " + prose(rng, 120) for _ in range(60)]
    items = [(i, prose(rng, 23)) for i in range(20)] + [(90, " ".join(common))]
    docs = []
    for i in range(20):
        w = items[i][1].split()
        for k in rng.sample(range(15), 10):
            w[k] = prose(rng, 1)
        docs.append(prose(rng, 90) + " " + " ".join(w) + " " + prose(rng, 90))
    docs.append(prose(rng, 95) + " " + items[20][1] + " " + prose(rng, 90))
    bench = spark.createDataFrame(items, "item_id long, text string")
    ws = Workspace(spark, "test")
    idf, passes = decontam.build(make_docs([(i, t, "en", "s") for i, t in enumerate(clean + docs)]), bench, ws)
    index = decontam.load_index(ws.at("blocks"), passes[0], idf)
    got = decontam.search_chunk(index, *tc.column_bytes(pa.array(docs)))
    found = {p.item: p for b in index.blocks for p in b[-1]}
    accepts = {d for d, t in enumerate(docs) if decontam.confirm(found[items[d][0]], tc.Words(*tc.column_bytes(pa.array([t]))).hash[80:125].tolist())}
    assert 20 in accepts and len(accepts) > 5 and all(items[d][0] in got.get(d, ()) for d in accepts)


def test_decontamination_of_awkward_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, prose(random.Random(1), 40))], "item_id long, text string")
    assert all(r["__items"] == [] for r in decontam.contamination(make_docs(AWKWARD), bench).collect())
    assert decontam.contamination(make_docs(AWKWARD), bench.limit(0)).count() == len(AWKWARD)
    assert decontam.contamination(make_docs([]), bench).count() == 0


def test_search_finds_every_window_above_the_limit(monkeypatch):
    """All (text, item) with a window whose true cosine passes, against brute force over all windows; words repeat."""
    rng = random.Random(12)
    few = [prose(rng, 1) for _ in range(60)]
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.randrange(8, 50)))) for k in range(30)]
    docs = [" ".join(rng.choice(few + [prose(rng, 1) for _ in range(40)]) for _ in range(rng.randrange(5, 150))) for _ in range(40)]
    idf = np.random.default_rng(2).uniform(0.5, 4, decontam.FEATURES)
    block = decontam.passages(items, idf, 0.0)
    made = decontam.randomised_svd(block, idf)
    bits = np.zeros(1 << 16, bool)
    bits[(made[0] & np.uint64(0xFFFF)).astype(int)] = True
    index = decontam.Index([(made[0], bits, *made[1:], block)], idf)
    monkeypatch.setattr(decontam, "confirm", lambda p, words: True)
    data, off = tc.column_bytes(pa.array(docs))
    got = {(d, i) for d, x in decontam.search_chunk(index, data, off).items() for i in x}
    w = tc.Words(data, off)

    def vector(h):
        v = Counter()
        for x in h.tolist():
            v[x] += float(np.float32(idf[x & int(decontam._M)]))
        return v

    want, near = set(), set()
    for d, s, e in zip(*decontam.windows(w.first), strict=True):
        x = vector(w.hash[s:e])
        for p in block:
            y = vector(p.words)
            cos = sum(x[k] * y[k] for k in x.keys() & y.keys()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if cos >= decontam.COSINE + 1e-4:
                want.add((int(d), p.item))
            if cos >= decontam.COSINE - 1e-4:
                near.add((int(d), p.item))
    assert want <= got <= near and len(want) > 100


def test_svd_keeps_the_passages(spark):
    idf = np.ones(decontam.FEATURES)
    items = [(k, prose(random.Random(k), 40)) for k in range(12)]
    block = decontam.passages(items, idf, 0.5)
    vocab, v, u = decontam.randomised_svd(block, idf)
    a = np.zeros((len(block), len(vocab)))
    for k, p in enumerate(block):
        np.add.at(a[k], np.searchsorted(vocab, p.words), 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.abs(u @ u.T - a @ a.T).max() < 1e-4  # as many directions as passages: nothing is lost


def test_media_round_trip(spark, make_docs, folder):
    folder.write("documents", make_docs(AWKWARD))
    rows = media.op6_media(spark, folder.path).collect()
    assert len(rows) == len(AWKWARD)
    want = Counter()
    for i, t, *_ in AWKWARD:
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 2)}) == 1 and all(r.feature.startswith("mean=") for r in rows)


def test_ranges_cover_members_once_and_damage_is_found(spark, make_docs):
    ws = Workspace(spark, "test")
    media.write_archives(make_docs([(i, prose(random.Random(i), 50), "en", "s") for i in range(40)]).coalesce(1), ws.at("a"))
    got = media.read_archives(spark, ws.at("a"), rangeBytes=700)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(40)) and got.rdd.getNumPartitions() > 5
    _, root = open_fs(ws.at("a"))
    import glob

    path = glob.glob(f"{root}/*.zip")[0]
    at = zipfile.ZipFile(path).infolist()[3].header_offset + 60
    raw = bytearray(open(path, "rb").read())
    raw[at] ^= 255
    open(path, "wb").write(raw)
    bad = media.read_archives(spark, ws.at("a"), errors="null")
    assert bad.where("media is null").count() == 1
    with pytest.raises(Exception):
        media.read_archives(spark, ws.at("a")).collect()
    with pytest.raises(ValueError):
        media.decode_png(b"no png")


def test_mixing_equals_its_sql(spark, sf, con):
    assert differences(spark, con, sf, mixing.op10_mixing, mixing.oracle()) is None


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "1", 100), ("a", "en", "2", 10_000), ("a", "de", "3", 10_000), ("b", "en", "4", 10_000)], "domain string, lang string, source string, tokens long")
    budget = spark.createDataFrame([(6000,)], "budget long")
    got = {r.source: r.give for r in mixing.allocate(leaves, budget, 1).collect()}
    assert got == {"1": 100, "2": 1900, "3": 1000, "4": 3000}
    short = {r.source: r.give for r in mixing.allocate(leaves.where("source <> '2'"), budget, 1).collect()}
    assert short == {"1": 100, "3": 2900, "4": 3000}


def test_mixing_of_awkward_rows(spark, make_docs):
    docs = make_docs(AWKWARD)
    got = mixing.mix(docs)
    assert got.count() == len(AWKWARD) and got.select(docs.columns).columns == docs.columns
    assert mixing.mix(make_docs([])).count() == 0


def test_pipeline_on_small_tables(spark, make_docs, folder):
    import corpus_pipeline as cp

    rng = random.Random(4)
    rows = [(i, prose(rng, 80), "en" if i % 3 else "de", f"src{i % 4}") for i in range(120)]
    rows += [(500 + i, rows[i][1], "en", "src1") for i in range(20)]
    item = prose(rng, 40)
    rows += [(700, prose(rng, 40) + " " + item + " " + prose(rng, 40), "en", "src2")]
    folder.write("documents", make_docs(rows))
    folder.write("labels", spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    folder.write("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = cp.run(spark, folder.path)
    ids = Counter(r.doc_id for r in out.collect())
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and set(ids) <= set(range(120)) and len(ids) > 80
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    assert re and pa


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from switchback.llm import store

    none = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"))
    with pytest.raises(ValueError):
        store.shared_root(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "/shared/x/"), sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc)
    assert store.shared_root(named) == "file:/shared/x"
