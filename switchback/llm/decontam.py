"""Benchmark decontamination (operator 4): latent semantic retrieval, then exact checks.

Benchmark texts are cut into passages of at most PASSAGE words. Document frequencies of
hashed words come from all documents. The passages are dealt over tasks in blocks of
BLOCK_ITEMS, and each task makes a randomised SVD of its blocks' TF-IDF rows (all
directions of a block), which gives a word projection; words that no passage of the block
holds project to nothing, so only few words of a document are touched. The blocks are
written to the shared folder; workers read them from there, PASS_BLOCKS at once, so no
passage goes through the driver. Windows of several widths over whole documents are pruned
by a bound that no window above the cosine limit can miss, projected, and compared by
cosine with all passages of the block. Passages of common words would drown in their
neighbours' weight, so these are sought by the number of their words in a region instead,
which misses none that the check accepts. A candidate is confirmed on the window with its
surroundings: longest common subsequence of all words and of content words, and the words
of the passage's answer (its last sentence) must be there.

The benchmark is the query set. A benchmark of more than PASS_BLOCKS blocks takes further
passes over the documents, each written before the next.

Defined cases: null, empty and word-less documents are clean; benchmark rows without
words are ignored; a null item_id is kept as null; an empty benchmark leaves all clean;
repeated rows get a result each. Other columns are passed on or ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import Workspace, open_fs

FEATURES = 1 << 18
DF_BLOCK = 1 << 10
PASSAGE = 64
BLOCK_ITEMS = 256
PASS_BLOCKS = 4
WIDTHS = (16, 32, 64)
STRIDE = 8
COSINE = 0.35  # estimated for half of a passage's words at equal weights; light words may give less
AROUND = 32
LCS_ALL, LCS_CONTENT, LCS_FEW = 0.5, 0.5, 0.8
FEW = 3  # passages with fewer content words are plain: LCS_FEW of all their words must match
ANSWER = 0.5
CONTENT_SHARE = 0.05  # words in more documents than this are not content
COMMON = 0.15  # factor of their weight
_M = np.uint64(FEATURES - 1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each hashed word, documents with words), over all rows of column text.

    Tasks send one array of counts a block of features; they are summed as streams in two steps.
    """

    def count(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for _, _, data, off in tc.chunks(b.column(0)):
                w = tc.Words(data, off)
                key = (w.doc.astype(np.uint64) << np.uint64(18)) | (w.hash & _M)
                key = np.sort(key)
                if len(key):
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                    df += np.bincount((key & _M).astype(np.int64), minlength=FEATURES)
                n += int(np.count_nonzero(np.diff(w.first)))
        k = [k for k in range(FEATURES // DF_BLOCK) if df[k * DF_BLOCK : (k + 1) * DF_BLOCK].any()]
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 16
        yield _blocks({-1: np.array([n], np.int64)} | {x: df[x * DF_BLOCK : (x + 1) * DF_BLOCK] for x in k}, salt)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64)
                total[block] = total[block] + x if block in total else x
        yield _blocks(total, 0)

    schema = "block int, salt int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("block", "salt").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)
    df, n = np.zeros(FEATURES, np.int64), 0
    for r in rows.collect():  # FEATURES counts at most
        x = np.frombuffer(r.counts, np.int64)
        if r.block < 0:
            n += int(x[0])
        else:
            df[r.block * DF_BLOCK : (r.block + 1) * DF_BLOCK] += x
    return df, n


def _blocks(total: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "salt": pa.array([salt] * len(total), pa.int32()), "counts": pa.array([np.ascontiguousarray(x).tobytes() for x in total.values()], pa.binary())})


class Passage:
    """A benchmark passage: word hashes, content mask and the hashes of its answer's content words."""

    def __init__(self, item, words: np.ndarray, content: np.ndarray, answer: np.ndarray):
        self.item, self.words, self.content, self.answer = item, words, content, answer
        self.masks = self._masks(words)
        self.content_masks = self._masks(words[content])

    @staticmethod
    def _masks(words: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            out[w] = out.get(w, 0) | (1 << k)
        return out


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence by bit-parallel rows."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def passages(items: list[tuple], idf: np.ndarray, content_idf: float) -> list[Passage]:
    """Passages of benchmark rows (item_id, text)."""
    result = []
    for item, text in items:
        w = tc.Words(*tc.column_bytes(pa.array([text], pa.string())))
        n = len(w.hash)
        if not n:
            continue
        content = idf[(w.hash & _M).astype(np.int64)] >= content_idf
        ends = np.isin(w.low, [ord(c) for c in ".?!\n"])
        clause = np.cumsum(ends)[w.start]
        for a in range(0, n, PASSAGE):
            b = min(a + PASSAGE, n)
            if b - a < PASSAGE // 4 and a:
                a = max(0, b - PASSAGE)
            last = np.arange(a, b)[clause[a:b] == clause[b - 1]]
            answer = w.hash[last][content[last]]
            result.append(Passage(item, w.hash[a:b], content[a:b], np.unique(answer)))
    return result


def randomised_svd(block: list[Passage], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted word hashes, word directions V by weight, unit passage vectors in V) of a block's TF-IDF rows.

    The range of A^T is found by Gaussian test vectors, as many as passages, and one power
    step; the small matrix left is then decomposed. Memory: words of the block x passages.
    """
    vocab = np.unique(np.concatenate([p.words for p in block]))
    weight = idf[(vocab & _M).astype(np.int64)].astype(np.float64)
    a = np.zeros((len(block), len(vocab)))
    for k, p in enumerate(block):
        r = np.searchsorted(vocab, p.words)
        np.add.at(a[k], r, weight[r])
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a /= np.where(norm > 0, norm, 1)
    q, _ = np.linalg.qr(a.T @ np.random.default_rng(11).standard_normal((len(block), min(len(block), len(vocab)))))
    q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, turn = np.linalg.svd(a @ q, full_matrices=False)
    v = (q @ turn.T).astype(np.float32)
    u = (a @ v).astype(np.float32)
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return vocab, (v * weight[:, None]).astype(np.float32), u / np.where(norm > 0, norm, 1)


class Index:
    """What a pass over the documents needs: blocks of (words, their bits, V, u, passages)."""

    def __init__(self, blocks, idf: np.ndarray):
        self.blocks, self.idf = blocks, idf.astype(np.float32)


def confirm(p: Passage, words: list[int]) -> bool:
    """Longest common subsequences and answer words of a passage within a region's words."""
    n = len(p.words)
    have = set(words)
    if len(p.answer) and sum(a in have for a in p.answer.tolist()) < ANSWER * len(p.answer):
        return False
    got = lcs(p.masks, n, words) / n
    c = int(p.content.sum())
    if c < FEW:
        return got >= LCS_FEW
    return got >= LCS_ALL and lcs(p.content_masks, c, words) >= LCS_CONTENT * c


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all windows, in words of the chunk."""
    docs, starts, ends = [], [], []
    n = np.diff(first)
    for width in WIDTHS:
        has = np.flatnonzero(n > (0 if width == WIDTHS[0] else WIDTHS[WIDTHS.index(width) - 1]))
        many = np.maximum(-(-(n[has] - width) // STRIDE), 0) + 1
        doc = np.repeat(has, many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        s = first[doc] + STRIDE * k
        docs.append(doc)
        starts.append(s)
        ends.append(np.minimum(s + width, first[doc + 1]))
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)


def repeats(word: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each word occurred in the WIDTHS[-1] words before it in its text; `at` are the words' places."""
    order = np.lexsort((at, word, doc))
    w, d, p = word[order], doc[order], at[order]
    group = np.append(0, np.cumsum((w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, np.int64)
    big = int(at.max()) + 2 * WIDTHS[-1] if len(at) else 1
    line = group * big + p
    out = np.empty(len(w), np.int64)
    out[order] = np.arange(len(w)) - np.searchsorted(line, np.maximum(group * big, line - WIDTHS[-1] + 1))
    return out


def window_norms(hashes: np.ndarray, sq: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Norms of the windows' TF-IDF vectors; sq is the squared weight of each word."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    order = np.lexsort((hashes[at], which))
    h, x = hashes[at][order], which[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]))
    tf = np.diff(np.append(first, len(h)))
    return np.sqrt(np.bincount(x[first], sq[at[order][first]] * tf.astype(float) ** 2, minlength=len(n)))


def search_chunk(index: Index, data: np.ndarray, off: np.ndarray) -> dict[int, set]:
    """Items found in each text of a chunk."""
    w = tc.Words(data, off)
    found: dict[int, set] = {}
    if not len(w.hash):
        return found
    sq = index.idf[(w.hash & _M).astype(np.int64)].astype(np.float64) ** 2
    doc, start, end = windows(w.first)
    total = np.concatenate([[0], np.cumsum(sq)])
    for vocab, bits, v, u, block in index.blocks:
        maybe = np.flatnonzero(bits[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        col = np.minimum(np.searchsorted(vocab, w.hash[maybe]), len(vocab) - 1)
        hit = vocab[col] == w.hash[maybe]
        at, col = maybe[hit], col[hit]
        # cos^2 <= known / (known + other): a word's tf^2 is the sum of 2 * rank - 1 over its occurrences,
        # whose ranks in a window are at most 1 + repeats; other words count at least once each
        most = np.concatenate([[0], np.cumsum(sq[at] * (2 * repeats(col, w.doc[at], at) + 1))])
        mass = np.concatenate([[0], np.cumsum(sq[at])])
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
        known = most[hi] - most[lo]
        other = np.maximum(total[end] - total[start] - (mass[hi] - mass[lo]), 0)
        keep = np.flatnonzero((known >= COSINE**2 * (known + other) * 0.999) & (hi - lo >= 2) & (known > 0))
        if not len(keep):
            continue
        for part in np.array_split(keep, -(-len(keep) // 256)):
            n = hi[part] - lo[part]
            rows = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            z = np.add.reduceat(v[col[rows]], np.cumsum(n) - n, axis=0)
            norm = window_norms(w.hash, sq, start[part], end[part])
            cos = z @ u.T / np.where(norm > 0, norm, 1)[:, None].astype(np.float32)
            x, y = np.nonzero(cos >= COSINE)
            for k in np.argsort(-cos[x, y], kind="stable").tolist():
                d, p = int(doc[part[x[k]]]), block[y[k]]
                if p.item in found.get(d, ()):
                    continue
                s, e = start[part[x[k]]], end[part[x[k]]]
                region = w.hash[max(w.first[d], s - AROUND) : min(w.first[d + 1], e + AROUND)].tolist()
                if confirm(p, region):
                    found.setdefault(d, set()).add(p.item)
    narrow = np.flatnonzero(end - start <= WIDTHS[0])
    left = np.maximum(w.first[doc[narrow]], start[narrow] - AROUND)
    right = np.minimum(w.first[doc[narrow] + 1], end[narrow] + AROUND)
    for p in (p for block in index.blocks for p in block[-1] if int(p.content.sum()) < FEW):
        held = np.concatenate([[0], np.cumsum(np.isin(w.hash, p.words))])
        for k in np.flatnonzero(held[right] - held[left] >= LCS_FEW * len(p.words)).tolist():
            d = int(doc[narrow[k]])
            if p.item not in found.get(d, ()) and confirm(p, w.hash[left[k] : right[k]].tolist()):
                found.setdefault(d, set()).add(p.item)
    return found


def content_weight(n: int) -> float:
    """Least weight of a content word."""
    return float(np.log((1 + n) / (1 + CONTENT_SHARE * n)))


def word_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency by hashed word, much less for words that are not content."""
    idf = np.log((1 + n) / (1 + df)).clip(0)
    return np.where(idf >= content_weight(n), idf, COMMON * idf)


def build(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> tuple[np.ndarray | None, list[list[int]]]:
    """(word weights, numbers of the blocks of each pass); the blocks are in the table `blocks`."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    n_items = items.count()
    if not n_items:
        return None, []
    df, n = document_frequencies(docs)
    idf, least = word_weights(df, n), content_weight(n)
    shared = spark.sparkContext.broadcast(idf)

    def run(batches):
        from pyspark import TaskContext

        idf, no = shared.value, TaskContext.get().partitionId() << 16
        todo: list[Passage] = []

        def made(least):
            nonlocal todo, no
            while len(todo) > least:
                part, todo = todo[:BLOCK_ITEMS], todo[BLOCK_ITEMS:]
                yield pa.RecordBatch.from_pydict({"block": pa.array([no], pa.int64()), "made": pa.array([pickle.dumps((part, *randomised_svd(part, idf)))], pa.binary())})
                no += 1

        of = None
        for b in batches:
            for g, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != of:
                    yield from made(0)
                of = g
                todo += passages([(item, text)], idf, least)
            yield from made(BLOCK_ITEMS - 1)
        yield from made(0)

    groups = -(-n_items // BLOCK_ITEMS)
    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).alias("g"), "item_id", "text").repartition(groups, "g").sortWithinPartitions("g", "item_id", "text")
    blocks = ws.write(dealt.mapInArrow(run, "block long, made binary"), "blocks")
    numbers = [r.block for r in blocks.select("block").orderBy("block").toLocalIterator()]  # one a BLOCK_ITEMS passages
    return idf, [numbers[k : k + PASS_BLOCKS] for k in range(0, len(numbers), PASS_BLOCKS)]


def load_index(uri: str, numbers: list[int], idf: np.ndarray) -> Index:
    """An index from the table of blocks in the shared folder, for use inside a task."""
    import pyarrow.parquet as pq

    fs, root = open_fs(uri)
    blocks = []
    for raw in pq.read_table(root, columns=["block", "made"], filesystem=fs, filters=[("block", "in", numbers)]).sort_by("block").column("made").to_pylist():
        part, vocab, v, u = pickle.loads(raw)
        bits = np.zeros(1 << 16, bool)
        bits[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
        blocks.append((vocab, bits, v, u, part))
    return Index(blocks, idf)


_workers: dict[str, Index] = {}


def contamination(docs: DataFrame, benchmark: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """`docs` with array<long> column `__items`, replaced if there is one: the benchmark items found in each text, ascending."""
    ws = ws or Workspace(docs.sparkSession, "decontamination")
    names = [c for c in docs.columns if c != "__items"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.array().cast("array<long>").alias("items"))
    place = names.index("text")
    idf, passes = build(docs, benchmark, ws)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    for no, numbers in enumerate(passes):
        if no:
            out = ws.write(out, f"pass-{no}")
            ws.drop(f"pass-{no - 1}")

        def run(batches, uri=ws.at("blocks"), numbers=numbers):
            tc.claim(_workers)
            tag = f"{uri}:{numbers[0]}"
            for b in batches:
                if tag not in _workers:
                    _workers.clear()
                    _workers[tag] = load_index(uri, numbers, shared.value)
                items = b.column(1).to_pylist()
                for i, _, data, off in tc.chunks(b.column(0).field(place)):
                    for d, found in search_chunk(_workers[tag], data, off).items():
                        items[i + d] = sorted({*items[i + d], *found}, key=lambda x: (x is not None, x))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.int64()))], schema=b.schema)

        out = out.mapInArrow(run, out.schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("items").alias("__items"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("item_ids"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark passage."""
    got = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.where(F.size("__items") == 0).select(*docs.columns)
