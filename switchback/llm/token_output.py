"""Token-ID output (operator 2): Parquet list columns, read back selectively.

Texts are range-partitioned and sorted by doc_id; each task encodes its texts and
writes one Parquet file (doc_id, start_in_file, n_tokens, tokens) with dictionary
or delta encoding, row groups of a set number of rows and page indexes. A file is
written under an attempt's name and moved into place, so a lost executor leaves no
half file. The file table (file, docs, tokens) gives every file its first token.

Encoding is by the library, once per distinct piece of text and worker: texts are
cut at white space, and between a letter and plain punctuation, where neither the
normaliser nor the pre-tokeniser nor a merge can cross. Pieces outside that rule
(apostrophes, digits, brackets of special tokens, other scripts) stay whole.

Null and empty texts have only the end id; null doc_ids sort first; rows of one doc_id
are in the order of their texts, nulls first, so a retry writes the same files; repeated
rows are written each; other columns are ignored. An empty table gives no files' rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import Workspace, open_fs

END_ID = 1
ROW_GROUP_DOCS = 1024
ROW_GROUP_TOKENS = 1 << 22  # a row group ends there, too
FILE_BYTES = 1 << 27  # of text in a file
ARENA = 1 << 23  # cached ids of a worker; a full arena is emptied
_workers: dict[str, Encoder] = {}

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in '.,!%&*$#"()@=+-;:?/']] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The library's encoder behind a bounded cache of pieces of text."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        ids = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(ids.values(), default=0) + 1, bool)
        for piece, i in ids.items():
            self.ends[i] = piece.endswith("</w>")
        self.memo = tc.Memo()
        self.arena = np.zeros(ARENA, np.int32)
        self.used = 0

    @staticmethod
    def cut(data: np.ndarray, off: np.ndarray):
        """(start, end, simple) of the pieces; a simple piece is one pre-token of letters or of punctuation."""
        n = len(data)
        prev = np.concatenate([[0], data[:-1]])
        nxt = np.concatenate([data[1:], [0]])
        latin2 = (prev == 0xC3) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
        latin1 = (data == 0xC3) & (nxt >= 0x80) & (nxt < 0xC0) & (nxt != 0x97) & (nxt != 0xB7)
        letter = _LETTER[data] | latin1 | latin2
        punct = _PUNCT[data]
        space = (data == 32) | (data == 10)
        start_mask = ~space
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        join = ~space[:-1] & ~cut[1:n]
        join &= ~((letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:]))
        start_mask[1:] &= ~join
        start = np.flatnonzero(start_mask)
        stop = ~space
        stop[:-1] &= ~(join & ~space[1:])
        end = np.flatnonzero(stop) + 1
        kind = np.zeros(n + 1, np.int64)
        np.cumsum(letter, out=kind[1:])
        letters = kind[end] - kind[start]
        np.cumsum(punct, out=kind[1:])
        puncts = kind[end] - kind[start]
        return start, end, (letters == end - start) | (puncts == end - start)

    def _library(self, pieces: list[str], simple: np.ndarray) -> list:
        out: list = [None] * len(pieces)
        one = np.flatnonzero(simple)
        for a in range(0, len(one), 256):
            part = one[a : a + 256].tolist()
            ids = np.array(self.tok.encode_batch_fast([" ".join(pieces[k] for k in part)], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(part) or at[-1] != len(ids):
                raise ValueError("a simple piece is not one pre-token of this tokenizer")
            for k, x in zip(part, np.split(ids, at[:-1]), strict=True):
                out[k] = x
        rest = np.flatnonzero(~simple).tolist()
        for k, e in zip(rest, self.tok.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.int32)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, ids per text)."""
        docs = len(off) - 1
        if len(data) == 0:
            return np.full(docs, END_ID, np.int32), np.ones(docs, np.int64)
        if not ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
            data = _LOWER[data]  # the normaliser lowers; special tokens are case-sensitive
        start, end, simple = self.cut(data, off)
        h = tc.span_hash(tc.prefix_hash(data), start, end)
        val, miss = self.memo.get(h)
        if miss.any():
            at = np.flatnonzero(miss)
            u, rep, inv = np.unique(h[at], return_index=True, return_inverse=True)
            rep = at[rep]
            raw = data.tobytes()
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[rep].tolist(), end[rep].tolist(), strict=True)]
            got = self._library(pieces, simple[rep])
            n = np.array([len(x) for x in got], np.int64)
            flat = np.concatenate(got)
            if self.used + len(flat) > len(self.arena):
                self.memo.clear()
                self.used = 0
                if len(at) < len(h):  # what was cached is gone: encode the chunk anew
                    return self.encode(data, off)
                if len(flat) > len(self.arena):
                    self.arena = np.zeros(2 * len(flat), np.int32)
            where = self.used + np.cumsum(n) - n
            self.arena[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            new = (where << 32) | n
            self.memo.put(u, new)
            val[at] = new[inv]
        n = val & 0xFFFFFFFF
        where = val >> 32
        before = np.cumsum(n) - n
        total = int(n.sum())
        flat = self.arena[np.repeat(where - before, n) + np.arange(total)]
        sums = np.append(before, total)
        edge = sums[np.searchsorted(start, off)]
        per = np.diff(edge)
        out = np.full(total + docs, END_ID, np.int32)
        out[np.arange(total) + np.repeat(np.arange(docs), per)] = flat
        return out, per + 1


def encoder(path: str) -> Encoder:
    tc.claim(_workers)
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("file_no", pa.int32()), ("tokens", pa.list_(pa.field("element", pa.int32())))])


def write_tokens(docs: DataFrame, uri: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, encoding: str = "dictionary", row_group_docs: int = ROW_GROUP_DOCS) -> DataFrame:
    """Write token files under `uri`; returns the file table (file_no, path, docs, tokens, start).

    encoding: 'dictionary' or 'delta' for the ids. The files hold ascending doc_ids, file after file.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bytes = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
    src = src.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        fs, root = open_fs(uri)
        fs.create_dir(root, recursive=True)
        enc = encoder(tokenizer)
        name, tmp = f"{root}/tokens-{no:06d}.parquet", f"{root}/_tmp-{no:06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        writer = None
        options = {"use_dictionary": ["tokens.list.element"]} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"tokens.list.element": "DELTA_BINARY_PACKED"}}
        held: list[pa.RecordBatch] = []

        def flush():
            nonlocal writer
            if not held:
                return
            if writer is None:
                writer = pq.ParquetWriter(tmp, FILE_SCHEMA, filesystem=fs, compression="zstd", compression_level=1, write_page_index=True, write_statistics=True, data_page_size=1 << 18, **options)
            writer.write_table(pa.Table.from_batches(held, FILE_SCHEMA), row_group_size=row_group_docs)
            held.clear()

        for b in batches:
            for i, j, data, off in tc.chunks(b.column(1)):
                ids, per = enc.encode(data, off)
                start = n_tokens + np.cumsum(per) - per
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(ids))
                held.append(pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(start), pa.array(per), pa.array(np.full(j - i, no, np.int32)), lists.cast(FILE_SCHEMA.field("tokens").type)], schema=FILE_SCHEMA))
                n_docs += j - i
                n_tokens += len(ids)
                if sum(x.num_rows for x in held) >= row_group_docs or sum(len(x.column(4).values) for x in held) >= ROW_GROUP_TOKENS:
                    flush()
        flush()
        if writer is not None:
            writer.close()
            fs.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "path": [name.rpartition("/")[2]], "docs": pa.array([n_docs], pa.int64()), "tokens": pa.array([n_tokens], pa.int64())})

    files = src.mapInArrow(run, "file_no int, path string, docs long, tokens long")
    rows = sorted(files.collect())  # one row a file: a file for FILE_BYTES of text, or as many as shuffle partitions
    out, start = [], 0
    for r in rows:
        out.append((r.file_no, r.path, r.docs, r.tokens, start))
        start += r.tokens
    table = spark.createDataFrame(out, "file_no int, path string, docs long, tokens long, start long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{uri}_files")
    return spark.read.parquet(f"{uri}_files")


def read_tokens(spark, uri: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens")) -> DataFrame:
    """Read token files; only the asked-for columns are scanned. `start` counts from the first file."""
    files = spark.read.parquet(f"{uri}_files")
    need = [c for c in columns if c != "start"]
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, tokens array<int>").select(*columns)
    got = spark.read.schema("doc_id long, start_in_file long, n_tokens long, file_no int, tokens array<int>").parquet(f"{uri}/tokens-*.parquet")
    if "start" not in columns:
        return got.select(*columns)
    got = got.select("file_no", "start_in_file", *need)
    return got.join(F.broadcast(files.select("file_no", F.col("start").alias("__file_start"))), "file_no").withColumn("start", F.col("start_in_file") + F.col("__file_start")).select(*columns)


def ids_crc32(df: DataFrame) -> DataFrame:
    """Replace `tokens` by the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("tokens")
            col = b.column(k)
            off = col.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            keep = [i for i in range(b.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(crc, pa.int64())], names=[b.schema.names[i] for i in keep] + ["ids_crc32"])

    return df.mapInArrow(run, df.drop("tokens").schema.add("ids_crc32", "long"))


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws.at("ids"))
    return ids_crc32(read_tokens(spark, ws.at("ids")))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: write the ids of all that is kept; one row a document, read back from the files."""
    ws = Workspace(spark, "pipeline-tokens")
    write_tokens(docs, ws.at("ids"))
    return ids_crc32(read_tokens(spark, ws.at("ids")))
