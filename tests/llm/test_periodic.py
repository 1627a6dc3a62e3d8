import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from switchback.llm import periodic
from switchback.llm import textcore as tc

from .conftest import AWKWARD, prose


def runs_brute(w, least=24, times=3):
    """By the definition: for every period the longest stretches of equal words a period apart."""
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                out.setdefault((i, j + p), p)  # periods come in order: the smallest stays
            i = j
    return sorted((i, j, p) for (i, j), p in out.items())


def brute(doc_id, text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(w)
    top = (None,) * 4
    if runs:
        i, j, p = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]))
        top = i, j - i, p, 1000 * (j - i) // p
    gone = {k for i, j, p in runs for k in range(i + p, j)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(runs), *top, sha("".join(f"{i},{j - i},{p}\n" for i, j, p in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def words(texts):
    first = np.cumsum([0, *map(len, texts)])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return np.array([hash(x) & ((1 << 63) - 1) for t in texts for x in t], np.uint64), doc, first


def texts_with_runs(rng, many, least):
    out = []
    for _ in range(many):
        t = []
        for _ in range(rng.randrange(5)):
            piece = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 9))]
            t += piece * rng.randrange(1, 3 + least) + piece[: rng.randrange(len(piece) + 1)]
            t += [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]
            if t and rng.random() < 0.5:  # an earlier part again: its runs are copied
                a = rng.randrange(len(t))
                t += t[a : a + rng.randrange(60)]
        out.append(t)
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (2, 2), (10, 4)])
def test_runs_equal_the_definition(least, times):
    texts = texts_with_runs(random.Random(least), 400, least // 4) + [[], ["a"], ["a"] * 40, ["a", "b"] * 30 + ["a"], list("abaababaabaab" * 5)]
    got = periodic.runs_of(*words(texts), least, times)
    for d, t in enumerate(texts):
        assert got.get(d, []) == runs_brute(t, least, times), t


def test_previous_factors_equal_the_definition():
    texts = texts_with_runs(random.Random(9), 30, 2)
    word, doc, first = words(texts)
    longest, source = periodic.Index(word, doc, first).previous_factors()
    for d, t in enumerate(texts):
        for i in range(len(t)):
            reach = lambda j, i=i, t=t: next((k for k in range(len(t) - i) if t[i + k] != t[j + k]), len(t) - i)
            at = int(first[d]) + i
            assert longest[at] == max([0, *map(reach, range(i))])
            assert not longest[at] or (reach(int(source[at] - first[d])) == longest[at] and source[at] < at)


def test_query_equals_brute_force(spark, make_docs, folder):
    rng = random.Random(3)
    line = prose(rng, 9)
    texts = [prose(rng, rng.randrange(90)) for _ in range(150)] + [prose(rng, 5) + " " + " \n".join([line] * k) + " " + prose(rng, 4) for k in range(1, 9)] + [" a b c\x0bd " * 20, "x " * 23, "x " * 24, "  " * 30]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + AWKWARD
    folder.write("documents", make_docs(rows))
    got = periodic.op13_periodic_runs(spark, folder.path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in got.collect() if r.length != 30_000]  # brute force takes long on the longest text, which has a test of its own
    assert sorted(repr(tuple(r)) for r in short) == sorted(repr((i, *brute(i, t))) for i, t, *_ in rows if t is None or len(t) < 20_000)


def test_long_text_and_many_texts_in_a_chunk():
    data, off = tc.column_bytes(pa.array(["word " * 30_000, "a b " * 12, "", "one two"] * 3))
    got = periodic.digests(data, off, [None] * 12)
    assert [r[:5] for r in got] == [(1, 0, 30_000, 1, 30_000_000), (1, 0, 24, 2, 12_000), (0, None, None, None, None), (0, None, None, None, None)] * 3


def test_names_and_empty_table(spark):
    docs = spark.createDataFrame([("a b " * 20, 1, "s", 2, 3)], "text string, n_runs long, row string, plant int, word int")
    got = periodic.periodic_runs(docs)
    assert got.columns == ["row", "plant", "word", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.first()[:7] == ("s", 2, 3, 1, 0, 40, 2)
    assert periodic.periodic_runs(docs.where("false")).count() == 0
    assert periodic.periodic_runs(docs.select("text")).first().period == 2
