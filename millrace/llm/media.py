"""Operator 6: media columns kept in archives and read through a Spark data source.

Each text's payload is its UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576, stored losslessly as an
8-bit grey PNG of width 576.  A task writes its rows as members of one zip archive (rolled at ``roll`` bytes), under a
name of its attempt, renamed when whole.  :class:`MediaArchive` reads a folder of archives: partitions are byte ranges of
archives, planned from file sizes alone; a range reads the members whose headers begin in it, found in the archive's
own directory, and streams them as Arrow batches.  A member that can't be read or whose checksum fails is tried again
by its offset, with the archive opened anew; the others aren't read again.

Null and empty texts are one row of 255.  Equal texts give equal values.  Rows with equal doc_id stay separate
members; a null doc_id stays null.  Empty tables give no archives and no rows.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import byte_list, open_fs, with_text

WIDTH = 576
FILL = 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILL]) * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples, a row a line; checks every chunk's checksum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey PNG without interlace is read")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, sum, and counts of the samples in 16 equal steps."""
    counts = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"{samples.shape[1]}x{samples.shape[0]};{int(samples.sum(dtype=np.int64))};" + ",".join(map(str, counts.tolist()))


def write_archives(docs: DataFrame, path: str, roll: int = 256 << 20) -> int:
    """Write one member a row; returns how many archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        n, size, members, archive, sink, done = 0, 0, 0, None, None, []

        def close() -> None:
            archive.close()
            sink.close()
            done.append(f"part-{task.partitionId():06d}-{n:04d}.zip")

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_list(batch.column("text"))):
                if archive is None:
                    sink = fs.open_output_stream(f"{root}/.{task.taskAttemptId()}-{n}")
                    archive = zipfile.ZipFile(_Sink(sink), "w", zipfile.ZIP_STORED)
                media = encode_png(payload_of(text))
                archive.writestr(zipfile.ZipInfo(f"{members:09d}_{'null' if doc is None else doc}.png"), media)
                members, size = members + 1, size + len(media)
                if size >= roll:
                    close()
                    n, size, archive = n + 1, 0, None
        if archive is not None:
            close()
        for k, name in enumerate(done):
            fs.move(f"{root}/.{task.taskAttemptId()}-{k}", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"archives": [len(done)]}, pa.schema([("archives", pa.int64())]))

    return sum(r[0] for r in with_text(docs).mapInArrow(run, "archives long").collect())  # one row a task


class _Sink(io.RawIOBase):
    """A stream that can only be written: zipfile then keeps no sizes in headers it has passed."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``: archive, member, at (offset of the member), media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, at long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", 8 << 20)), int(self.options.get("tries", 3)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, tries: int):
        self.path, self.range_bytes, self.tries = path, range_bytes, tries

    def partitions(self) -> list[ArchiveRange]:
        fs, root = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        sizes = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".zip"))
        return [ArchiveRange(name, at, min(at + self.range_bytes, size)) for name, size in sizes for at in range(0, size, self.range_bytes)] or [ArchiveRange("", 0, 0)]

    def _open(self, name: str) -> zipfile.ZipFile:
        fs, root = open_fs(self.path)
        return zipfile.ZipFile(pa.PythonFile(fs.open_input_file(f"{root}/{name}"), "r"))

    def read_member(self, archive: zipfile.ZipFile, name: str, info: zipfile.ZipInfo) -> tuple[zipfile.ZipFile, bytes]:
        for left in reversed(range(self.tries)):
            try:
                return archive, archive.read(info)
            except (OSError, zipfile.BadZipFile, zlib.error):
                if not left:
                    raise
                time.sleep(0.05 * (self.tries - left))
                archive = self._open(name)
        raise AssertionError

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("media", pa.binary())])
        archive = self._open(partition.path)
        rows: list[tuple] = []
        size = 0
        for info in archive.infolist():
            if partition.start <= info.header_offset < partition.end:
                archive, media = self.read_member(archive, partition.path, info)
                rows.append((partition.path, info.filename, info.header_offset, media))
                size += len(media)
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str, range_bytes: int = 8 << 20) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangebytes", range_bytes).load(path)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_features(media: DataFrame) -> DataFrame:
    """Of stored members: doc_id, sizes, digests and the feature, computed from the samples read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, stored in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
                samples = decode_png(stored)
                payload = samples.tobytes()
                doc = name[10:-4]
                rows.append((None if doc == "null" else int(doc), len(payload.rstrip(bytes([FILL]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)

    return media.select("member", "media").mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _DIGEST))
