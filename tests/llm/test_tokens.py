import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from switchback.llm import textcore as tc
from switchback.llm import token_counts, token_output
from switchback.llm.store import Workspace

from .conftest import AWKWARD

EDGE = ["", " ", "  ", "\n", "a's it've 12 don't", "café, été. ×a", "<|endoftext|>a <|startoftext|>", "A<|STARTOFTEXT|>", "日本 語\n", "x" * 500, "\r\n a\t b", "a.́b", "İstanbul ΣΑΣ ß", "'s", "▁ a", "a▁ b", "<s> x</s>", "a\n b", "\n\na"]


def noise(alphabet, n=1500):
    rng = random.Random(4)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_encoder_equals_the_library():
    enc = token_output.Encoder(token_output.default_tokenizer())
    texts = EDGE + noise(" \na'st.é,1́ÀX|<>-")
    want = [e.ids + [1] for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        ids, per = enc.encode(*tc.column_bytes(pa.array(texts)))
        cut = np.append(0, np.cumsum(per))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == want


def test_a_full_arena_changes_nothing():
    enc = token_output.Encoder(token_output.default_tokenizer())
    enc.arena = np.zeros(8, np.int32)
    for t in ("one two three four", "five six seven eight nine ten", "one two five"):
        ids, _ = enc.encode(*tc.column_bytes(pa.array([t])))
        assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids + [1]


def test_counts_equal_the_library():
    sp = token_counts.load(token_counts.default_model())
    texts = EDGE + noise(" \na▁b1.é")
    tiers = tc.Memo(10), tc.Memo(10)  # small: entries are evicted
    start, end, h, first = token_counts.pre_tokens(*tc.column_bytes(pa.array(texts[::2])))
    tiers[0].put(h, token_counts.encode_lengths(sp, token_counts._units(tc.column_bytes(pa.array(texts[::2]))[0], start, end), first))
    for _ in range(2):
        got = token_counts.count_chunk(sp, tiers, *tc.column_bytes(pa.array(texts)))
        assert got.tolist() == [len(x) for x in sp.encode(texts)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, make_docs, encoding):
    ws = Workspace(spark, "test")
    token_output.write_tokens(make_docs(AWKWARD), ws.at("ids"), encoding=encoding, row_group_docs=4)
    rows = token_output.read_tokens(spark, ws.at("ids")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([a[0] for a in AWKWARD], key=lambda x: (x is not None, x))
    at, tok = 0, token_output.encoder(token_output.default_tokenizer()).tok
    by_id = {a[0]: a[1] or "" for a in AWKWARD}
    for r in rows:
        assert (r.start, r.n_tokens, r.tokens) == (at, len(r.tokens), tok.encode(by_id[r.doc_id], add_special_tokens=False).ids + [1])
        at += r.n_tokens
    crc = {r.start: r.ids_crc32 for r in token_output.ids_crc32(token_output.read_tokens(spark, ws.at("ids"))).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in rows}


def test_selective_read_and_empty_table(spark, make_docs):
    ws = Workspace(spark, "test")
    token_output.write_tokens(make_docs(AWKWARD), ws.at("ids"))
    plan = token_output.read_tokens(spark, ws.at("ids"), ("doc_id", "n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    token_output.write_tokens(make_docs([]), ws.at("none"))
    assert token_output.read_tokens(spark, ws.at("none")).count() == 0


def test_count_query(spark, make_docs, folder):
    folder.write("documents", make_docs(AWKWARD))
    rows = token_counts.op3_token_counts(spark, folder.path).collect()
    sp = token_counts.load(token_counts.default_model())
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len((a[1] or "").encode()), (n := len(sp.encode(a[1] or ""))), n > 4096) for a in AWKWARD)
    folder.write("../empty/documents", make_docs([]))


def thue_morse(n=4096):
    a = "a"
    while len(a) < n:
        a += a.translate({97: 98, 98: 97})
    return [a, a.translate({97: 98, 98: 97})]


def test_long_unlike_pieces_are_not_mixed_up():
    texts = thue_morse() * 2
    sp, enc = token_counts.load(token_counts.default_model()), token_output.Encoder(token_output.default_tokenizer())
    data, off = tc.column_bytes(pa.array(texts))
    assert token_counts.count_chunk(sp, (tc.Memo(10), tc.Memo(10)), data, off).tolist() == [len(x) for x in sp.encode(texts)]
    ids, per = enc.encode(data, off)
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == [enc.tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_frequent_table_has_the_library_s_lengths(spark):
    texts = ["the cat and the dog and the bird"] * 50
    h, n = token_counts.frequent_lengths(spark.createDataFrame([(t,) for t in texts], "text string"), token_counts.default_model())
    sp, memo = token_counts.load(token_counts.default_model()), tc.Memo(12)
    memo.put(h, n)
    data, off = tc.column_bytes(pa.array(texts[:1]))
    val, miss = memo.get(token_counts.pre_tokens(data, off)[2])
    assert not miss.any() and val.sum() == len(sp.encode(texts[0]))
