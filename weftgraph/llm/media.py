"""Media columns: payloads stored as images in archives, and a data source that reads them back by byte ranges.

Each task writes its payloads as members of ZIP archives in the shared folder and returns a row for each finished
archive; these rows are the manifest, so what a lost attempt left behind is never read. The data source plans byte
ranges over the archives of a manifest. A reader takes the archive's directory (the central directory at its end),
picks the members that begin in its range, and streams their payloads in Arrow batches of bounded size. A member that
can't be read or fails its checksum is read again by its offset, apart from the others; one that stays unreadable gives
a row with the error instead of failing the scan.

A payload is stored as the samples of an 8-bit grey PNG, 64 wide, without loss.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, pick, small_batches, text_column, written

UNIT = 64
#: Bytes of an archive from which a task begins another, of a range that one task reads, and of a batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 4 << 20
TRIES = 3
_MAGIC, _NOTE = b"\x89PNG\r\n\x1a\n", b"bytes\0"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def padded(text: str) -> tuple[int, bytes]:
    """The UTF-8 length, and the bytes with zeros up to a positive multiple of ``UNIT``."""
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", _NOTE + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(rows.data, 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the noted length of an image that ``to_png`` made."""
    if media[:8] != _MAGIC:
        raise ValueError("no PNG")
    at, data, size, n_bytes = 8, [], None, None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(_NOTE):
            n_bytes = int(body[len(_NOTE) :])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are stored")
    return rows[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Mean and entropy of the samples, and which cells of an 8 x 8 grid are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    share = np.bincount(x.ravel(), minlength=256) / x.size
    share = share[share > 0]
    edge = np.linspace(0, len(x), 9).astype(int)
    grid = np.array([x[a : max(b, a + 1)].reshape(-1, 8, UNIT // 8).mean((0, 2)) if a < len(x) else np.zeros(8) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    bits = np.packbits(grid.ravel() > x.mean()).tobytes().hex()
    return f"{x.mean():.4f},{-(share * np.log2(share)).sum() + 0.0:.4f},{bits}"


class _Out(io.RawIOBase):
    """A stream that can't seek, as archives in any store are written front to back."""

    def __init__(self, stream):
        self.stream, self.size = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.size += len(data)
        return len(data)


def store(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each row of ``docs`` (doc_id, text) as a member and returns the manifest (archive, size, members) lazily."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = opened(folder)
        files.create_dir(at, recursive=True)
        task, done, number = TaskContext.get(), [], 0
        stem, out, zipped = f"{task.partitionId():06d}-{task.taskAttemptId()}", None, None

        def close() -> None:
            zipped.close()
            out.stream.close()
            done.append((f"{stem}-{len(done):04d}.zip", out.size, number))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch).to_pylist(), strict=True):
                if zipped is not None and out.size >= archive_bytes:
                    close()
                    zipped = None
                if zipped is None:
                    out, number = _Out(files.open_output_stream(f"{at}/{stem}-{len(done):04d}.zip")), 0
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                n_bytes, payload = padded(text)
                zipped.writestr(zipfile.ZipInfo(f"{number:08d}_{'' if doc_id is None else doc_id}.png"), to_png(payload, n_bytes))
                number += 1
        if zipped is not None:
            close()
        names, sizes, members = zip(*done, strict=True) if done else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.int64())], ["archive", "size", "members"])

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, "archive string, size long, members long")


class ByteRange(InputPartition):
    """The members of an archive that begin in a range of its bytes; members: how many the whole archive has."""

    def __init__(self, archive: str, start: int, end: int, members: int):
        self.archive, self.start, self.end, self.members = archive, start, end, members


class ArchiveReader(DataSourceReader):
    """Options: folder, manifest (a Parquet table of archive, size and members), range_bytes, batch_bytes, tries."""

    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.folder, self.manifest = low["folder"], low["manifest"]
        self.range_bytes, self.batch_bytes, self.tries = int(low.get("range_bytes", RANGE_BYTES)), int(low.get("batch_bytes", BATCH_BYTES)), int(low.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        files, at = opened(self.manifest)
        table = pyarrow.dataset.dataset(at, filesystem=files, format="parquet", schema=pa.schema([("archive", pa.string()), ("size", pa.int64()), ("members", pa.int64())])).to_table()
        found = sorted(zip(*(table.column(c).to_pylist() for c in ("archive", "size", "members")), strict=True))
        ranges = [ByteRange(a, i, min(i + self.range_bytes, n), m) for a, n, m in found for i in range(0, n, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        files, at = opened(self.folder)
        path, rows, held = f"{at}/{partition.archive}", [], 0
        names, kinds = ("archive", "member", "offset", "tries", "error", "payload"), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary())
        batch = lambda: pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], list(names))
        if partition.archive:
            with files.open_input_file(path) as f:
                listed = zipfile.ZipFile(f).infolist()
            if len(listed) != partition.members:
                raise ValueError(f"{partition.archive} has {len(listed)} members, its manifest says {partition.members}")
            members = [m for m in listed if partition.start <= m.header_offset < partition.end]
            stream = None
            for m in members:
                payload, error, tries = None, None, 0
                while payload is None and tries < self.tries:
                    tries += 1
                    try:
                        stream = stream or files.open_input_file(path)
                        payload, error = member(stream, m), None
                    except (OSError, ValueError, struct.error) as e:
                        stream, error = None, str(e)[:200]
                rows.append((partition.archive, m.filename, m.header_offset, tries, error, payload))
                held += len(payload or b"")
                if held >= self.batch_bytes:
                    yield batch()
                    rows, held = [], 0
        yield batch()


def member(stream, info: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes by its offset, checked against the directory's checksum."""
    head = stream.read_at(30, info.header_offset)
    if head[:4] != b"PK\3\4":
        raise ValueError("no member begins at this offset")
    names, extra = struct.unpack("<HH", head[26:30])
    data = stream.read_at(info.compress_size, info.header_offset + 30 + names + extra)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise ValueError("the member's checksum is wrong")
    return data


class ArchiveSource(DataSource):
    """``spark.read.format("weft_archive").option("folder", ...).option("manifest", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "weft_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, tries int, error string, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def load(spark: SparkSession, folder: str, manifest: str, **options) -> DataFrame:
    """The members of the archives that a manifest names."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("weft_archive").options(folder=folder, manifest=manifest, **options).load()


def described(members: DataFrame, strict: bool = False) -> DataFrame:
    """Lengths, digests and the feature of each member, from its stored bytes; nulls and the error where it has none, or,
    if ``strict``, a failed task, which Spark tries again before the query fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        for batch in batches:
            rows = []
            for name, error, media in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                own = name.split("_")[1].removesuffix(".png")
                doc_id, media = int(own) if own else None, media.as_py()
                if media is None and strict:
                    raise ValueError(f"{name}: {error}")
                if media is None:
                    rows.append((doc_id, *[None] * 7, error))
                    continue
                payload, n_bytes = from_png(media)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), None))
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)

    small_batches(members.sparkSession)
    return members.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media(docs: DataFrame) -> DataFrame:
    """Stores the texts of ``docs`` (doc_id, text), reads them back and describes them, a row for each row.

    A null text is empty and has one unit of zeros. Repeated and null ids are fine, as members are told apart by
    number. Equal texts have equal values. Other columns are not looked at; an empty table stays empty. A member that
    can't be read, or an archive with another number of members than were stored, fails the query.
    """
    folder = new_path(docs.sparkSession, "archives")
    _, manifest = written(store(docs, folder), "manifest")
    return described(load(docs.sparkSession, folder, manifest), strict=True)
