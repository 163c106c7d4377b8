"""Media columns: payloads stored as images in archives, and a data source that reads them back.

A payload is a text's UTF-8 bytes and zeros up to a positive multiple of 64. Its media form is an 8-bit greyscale PNG
of 64 samples a row, whose text chunk has the unpadded length. Members are stored in ZIP archives, each the work of
one write task; a manifest lists the archives of the attempts that count.

The ``media_archive`` data source plans byte ranges over the archives in a folder. A task reads the directory at the
end of its archive, takes the members that start in its range, and streams them as Arrow batches of bounded size. A
member that can't be read is tried again from its offset in a newly opened archive, alone; one that still fails comes
as a row with ``error`` and no media, and the others are not read again.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.llm import files
from lodestone.llm.shared import fresh_path

UNIT = 64
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"
MEMBER = "doc_id long, media binary, error string"
RANGE_BYTES, BATCH_BYTES, TRIES = 16 << 20, 4 << 20, 3


def padded(raw: bytes) -> bytes:
    """``raw`` and zeros up to a positive multiple of 64 bytes."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The payload and the unpadded length."""
    if media[:8] != PNG:
        raise ValueError("no PNG")
    at, data, n, rows = 8, b"", 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            rows = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n = int(body[7:])
        elif kind == b"IDAT":
            data += body
        at += size + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, UNIT + 1)
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), n


def feature(payload: bytes) -> str:
    """A 64-bit mark of the image, a bit for each column that is brighter than the mean, and its mean brightness."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    sums = rows.sum(axis=0, dtype=np.int64)
    bits = np.packbits(sums * UNIT > sums.sum())
    return f"{bits.tobytes().hex()}:{int(sums.sum()) * 1000 // rows.size}"


class _Sink(io.RawIOBase):
    """What zipfile writes to: a stream without places to go back to."""

    def __init__(self, out):
        super().__init__()
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, archive, sink, k = f"{uuid.uuid4().hex}.zip", None, None, 0
        for batch in iterator:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    sink = files.create(f"{self.uri}/{name}")
                    archive = zipfile.ZipFile(_Sink(sink), "w", zipfile.ZIP_STORED)
                raw = (text.as_py() or "").encode()
                key = doc_id.as_py()
                archive.writestr(zipfile.ZipInfo(f"{k:09d}_{'null' if key is None else key}.png"), to_png(padded(raw), len(raw)))
                k += 1
        if archive is None:
            return Written([])
        archive.close()
        sink.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        with files.create(f"{self.uri}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = files.opened(self.uri)
        for m in messages:
            for a in m.archives if m else ():
                system.delete_file(f"{path}/{a}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int = RANGE_BYTES, tries: int = TRIES):
        self.uri, self.range_bytes, self.tries = uri, range_bytes, tries

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives in the manifest, or of all in the folder where it has none. No archive is opened."""
        system, path = files.opened(self.uri)
        try:
            with system.open_input_file(f"{path}/{MANIFEST}") as f:
                listed = set(json.loads(f.read()))
        except FileNotFoundError:
            listed = None
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        sizes = sorted((i.base_name, i.size) for i in found if i.base_name.endswith(".zip") and (listed is None or i.base_name in listed))
        if listed and (lost := listed - {name for name, _ in sizes}):
            raise FileNotFoundError(f"{len(lost)} archives of the manifest are gone, {min(lost)} among them")
        ranges = [ByteRange(f"{self.uri}/{name}", at, at + self.range_bytes) for name, size in sizes for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def _opened(self, archive: str) -> zipfile.ZipFile:
        """The archive with its directory read, in ``tries`` tries; what fails then fails the task, which Spark tries again."""
        for left in range(self.tries - 1, -1, -1):
            try:
                return zipfile.ZipFile(files.read(archive))
            except (OSError, zipfile.BadZipFile):
                if not left:
                    raise
        raise ValueError("no tries")

    def _member(self, archive: str, held: list[zipfile.ZipFile | None], info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """The member's bytes, or why none of the tries read it. To open the archive anew is part of a try."""
        why = ""
        for _ in range(self.tries):
            try:
                if held[0] is None:
                    held[0] = zipfile.ZipFile(files.read(archive))
                return held[0].read(info), None  # by info.header_offset; checks the member's crc
            except (OSError, ValueError, zipfile.BadZipFile, zlib.error) as e:
                why = f"{type(e).__name__}: {e}"
                self._close(held)
        return None, why

    @staticmethod
    def _close(held: list[zipfile.ZipFile | None]) -> None:
        if held[0] is not None:
            source, held[0] = held[0].fp, None
            if source is not None:
                source.close()

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        held, rows, size = [self._opened(partition.archive)], [], 0
        for info in held[0].infolist():
            if partition.start <= info.header_offset < partition.stop:
                media, error = self._member(partition.archive, held, info)
                key = info.filename.rpartition("_")[2].removesuffix(".png")
                rows.append((None if key == "null" else int(key), media, error))
                size += len(media or b"")
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)
        self._close(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, media, errors = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "media", "error"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options range_bytes and tries. Writing takes doc_id and text."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_media(docs: DataFrame, uri: str) -> None:
    """Store each text of ``docs(doc_id, text)`` as a member of an archive under ``uri``. A null text is empty."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.format("media_archive").mode("append").save(uri)


def read_media(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(uri)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode each member and describe it; a member that could not be read or decoded has its error alone."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, stored, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    payload, n = from_png(stored) if stored is not None else (None, None)
                except (ValueError, struct.error, zlib.error) as e:
                    payload, error = None, f"{type(e).__name__}: {e}"
                if payload is None:
                    rows.append((doc_id, *[None] * 7, error))
                    continue
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload), error))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in FEATURES.split(", ")])

    return media.mapInArrow(describe, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store ``docs(doc_id, text)`` in archives in the shared folder and describe each row as read back.

    Null ids and repeated rows are members of their own; an empty text is 64 zeros; an empty table gives no rows;
    other columns are ignored. ``error`` is null where a member was read.
    """
    uri = fresh_path(docs.sparkSession, "media")
    write_media(docs, uri)
    return media_features(read_media(docs.sparkSession, uri))
