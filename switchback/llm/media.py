"""Media columns (operator 6): archives of PNG members behind a Spark data source.

Payloads are stored without loss as 8-bit grey samples, 64 a row, in PNG members of ZIP
archives (members are stored, not deflated again) of about ARCHIVE_BYTES. The data
source `archive` plans partitions as byte ranges over the archives of a folder, from the
files' sizes alone; a task reads its archive's central directory, takes the members whose
header starts in its range, and streams them as Arrow batches. Each member is read by
its own offset, checked against its CRC, and tried up to RETRIES times from a fresh
handle before the task fails (or, with option errors=null, its media is null).

Defined cases: a null text is an empty one, stored as 64 zero bytes; equal texts have
equal stored bytes; a null doc_id stays null; repeated rows are members of their own;
an empty table has no archives and reads as no rows. A worker holds one archive being
built and one member; a member is as long as its text.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import textcore as tc
from .store import Workspace, open_fs

WIDTH = 64
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
_SIGN = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raw: bytes) -> bytes:
    """PNG of the bytes, padded by zeros to a positive multiple of WIDTH; their number is kept as text."""
    rows = max(1, -(-len(raw) // WIDTH))
    grid = np.zeros((rows, WIDTH + 1), np.uint8)  # a row starts with filter type 0
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    grid[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(grid.data, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by row, bytes before padding) of what encode_png made; checks every chunk's CRC."""
    if media[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, body, n, shape = 8, [], None, None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    grid = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if grid[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return grid[:, 1:], n


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of the samples, share of adjacent equal ones, and their coarse histogram."""
    flat = samples.ravel()
    hist = np.bincount(flat, minlength=256)
    p = hist[hist > 0] / len(flat)
    values = np.arange(256)
    mean = (hist * values).sum() / len(flat)
    dev = np.sqrt(max((hist * (values - mean) ** 2).sum() / len(flat), 0))
    coarse = hist.reshape(16, 16).sum(axis=1) / len(flat)
    same = np.count_nonzero(flat[1:] == flat[:-1]) / max(1, len(flat) - 1)
    return f"mean={mean:.4f};dev={dev:.4f};bits={-(p * np.log2(p)).sum() + 0:.4f};same={same:.4f};hist=" + ",".join(f"{x:.4f}" for x in coarse)


def write_archives(docs: DataFrame, uri: str) -> None:
    """Write one PNG member a row (doc_id, text) into archives under `uri`."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = open_fs(uri)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        buf, z, no, members = None, None, 0, 0

        def close():
            nonlocal buf, z, no
            z.close()
            tmp, name = f"{root}/_tmp-{uuid.uuid4().hex}", f"{root}/media-{part:06d}-{no:06d}.zip"
            with fs.open_output_stream(tmp) as out:
                out.write(buf.getbuffer())
            fs.move(tmp, name)
            buf, z, no = None, None, no + 1

        for b in batches:
            ids = b.column(0).to_pylist()
            data, off = tc.column_bytes(b.column(1))
            for k, i in enumerate(ids):
                if z is None:
                    buf = io.BytesIO()
                    z = zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED, allowZip64=True)
                info = zipfile.ZipInfo(f"{members:09d}_{'null' if i is None else i}.png", (1980, 1, 1, 0, 0, 0))
                z.writestr(info, encode_png(data[off[k] : off[k + 1]].tobytes()))
                members += 1
                if buf.tell() >= ARCHIVE_BYTES:
                    close()
        if z is not None:
            close()
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], pa.int64())})

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "members long").agg(F.sum("members")).collect()


class ByteRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


SCHEMA = "archive string, member string, offset long, doc_id long, media binary"


class ArchiveSource(DataSource):
    """spark.read.format('archive').load(folder): the members of the folder's ZIP archives."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.null_errors = options.get("errors", "fail") == "null"

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector

        fs, root = open_fs(self.uri)
        files = fs.get_file_info(FileSelector(root, allow_not_found=True))
        out = [ByteRange(f.path, a, min(a + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".zip") for a in range(0, f.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_fs(self.uri)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = sorted((m.header_offset, m.filename, m.compress_size, m.CRC) for m in z.infolist() if partition.low <= m.header_offset < partition.high)
        held, size = [], 0
        for offset, name, length, crc in members:
            media = self.member(fs, partition.path, offset, length, crc)
            held.append((name, offset, media))
            size += length
            if size >= BATCH_BYTES:
                yield self.batch(partition.path, held)
                held, size = [], 0
        if held:
            yield self.batch(partition.path, held)

    def member(self, fs, path: str, offset: int, length: int, crc: int) -> bytes | None:
        """A stored member by its offset; each try opens the archive anew."""
        for attempt in range(RETRIES):
            try:
                with fs.open_input_file(path) as f:
                    head = f.read_at(30, offset)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError(f"{path}: no member at {offset}")
                    names, extra = struct.unpack_from("<HH", head, 26)
                    media = f.read_at(length, offset + 30 + names + extra)
                if len(media) != length or zlib.crc32(media) != crc:
                    raise ValueError(f"{path}: damaged member at {offset}")
                return media
            except (OSError, ValueError):
                if attempt == RETRIES - 1:
                    if self.null_errors:
                        return None
                    raise
        return None

    @staticmethod
    def batch(path: str, held) -> pa.RecordBatch:
        ids = [None if (m := re.search(r"_(-?\d+)\.png$", n)) is None else int(m[1]) for n, _, _ in held]
        return pa.RecordBatch.from_pydict({"archive": pa.array([path] * len(held)), "member": pa.array([n for n, _, _ in held]), "offset": pa.array([o for _, o, _ in held], pa.int64()), "doc_id": pa.array(ids, pa.int64()), "media": pa.array([m for _, _, m in held], pa.binary())})


def read_archives(spark, uri: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**options).load(uri)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of (doc_id, media), computed on what was read back."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for raw in b.column(1):
                raw = raw.as_buffer().to_pybytes()
                samples, n = decode_png(raw)
                payload = samples.tobytes()
                for c, v in zip(cols, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k in (2, 5, 6) else pa.int64()) for k, c in enumerate(cols))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "media")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws.at("archives"))
    return features(read_archives(spark, ws.at("archives")))
