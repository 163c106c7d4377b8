"""Token-ID output: fixed-width bit packing with block offsets.

A file holds the ids of whole documents in ascending ``doc_id`` order. Each id takes the fewest bits that hold every
id of the vocabulary. Ids are packed in blocks of ``BLOCK`` ids, so that a block is unpacked by numpy on its own::

    header   magic, width of an id in bits, ids in a block
    blocks   packed big-endian bits, each padded to a whole byte
    index    block offsets (u8 each), then doc_id (i8), null flag (u1) and first id (u8) of each document
    footer   counts of blocks, documents and ids, place of the index, magic

Tasks write files under names of their own; the manifest, a table Spark commits, lists those of the attempts that
count. What a lost attempt wrote is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import files
from lodestone.llm.shared import fresh_path, materialize
from lodestone.llm.tokens import ID, encoder

MAGIC = b"LDSPACK1"
HEADER, FOOTER = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
BLOCK = 65_536
END_ID = 1


def width_of(vocab_size: int) -> int:
    """The fewest bits that hold the ids 0 to ``vocab_size - 1``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(np.ascontiguousarray(ids, dtype=">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :].reshape(-1)).tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * width).reshape(n, width)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(ID)


class PackedWriter:
    """Streams documents to one file; holds less than a block besides the index."""

    def __init__(self, uri: str, width: int, block: int = BLOCK):
        self.out, self.width, self.block = files.create(uri), width, block
        self.out.write(HEADER.pack(MAGIC, width, block))
        self.at, self.n_ids, self.held, self.offsets = HEADER.size, 0, [], []
        self.n_held, self.doc_ids, self.nulls, self.starts = 0, [], [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """``raw``: the document's ids as little-endian unsigned 32-bit integers."""
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        ids = np.frombuffer(raw, dtype=ID)
        self.n_ids += len(ids)
        self.n_held += len(ids)
        self.held.append(ids)
        if self.n_held >= self.block:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype=ID)
        upto = len(ids) // self.block * self.block if whole else len(ids)
        for at in range(0, upto, self.block):
            raw = pack(ids[at : min(at + self.block, upto)], self.width)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(whole=False)
        index = np.array(self.offsets, "<u8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index)
        self.out.write(FOOTER.pack(len(self.offsets), len(self.doc_ids), self.n_ids, self.at, MAGIC))
        self.out.close()


class PackedReader:
    """Random access to a file's blocks and documents."""

    def __init__(self, uri: str):
        self.file = files.read(uri)
        self.file.seek(self.file.size() - FOOTER.size)
        blocks, docs, self.n_ids, at, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        self.file.seek(0)
        head, self.width, self.block = HEADER.unpack(self.file.read(HEADER.size))
        if (magic, head) != (MAGIC, MAGIC):
            raise ValueError(f"{uri} is no packed id file")
        self.file.seek(at)
        raw = self.file.read(8 * blocks + 17 * docs)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(raw, "u1", docs, 8 * blocks + 8 * docs)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs), np.uint64(self.n_ids)).astype(np.int64)
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0, ID))

    def read_block(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            n = min(self.block, self.n_ids - k * self.block)
            self.file.seek(int(self.offsets[k]))
            self._kept = (k, unpack(self.file.read((n * self.width + 7) // 8), n, self.width))
        return self._kept[1]

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``stop``, a block's share at a time."""
        while start < stop:
            k = start // self.block
            end = min(stop, (k + 1) * self.block)
            yield self.read_block(k)[start - k * self.block : end - k * self.block]
            start = end

    def document(self, k: int) -> np.ndarray:
        return np.concatenate([np.empty(0, ID), *self.ids(int(self.starts[k]), int(self.starts[k + 1]))])


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_packed(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write packed files under ``uri``; return the manifest, one row per file.

    Documents are dealt to tasks by ranges of ``doc_id`` and written in ascending order, nulls first; equal ids are
    ordered by the text's hash. A null text is empty: it holds the end id alone. Other columns are ignored. No file is written
    for a range without documents.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, path = encoder(tokenizer), None, f"{uri}/{uuid.uuid4().hex}.pack"
        end = np.array([end_id], dtype=ID).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or PackedWriter(path, width_of(max(enc.vocab_size, end_id + 1)))
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 200):
                raws = enc.encode(texts.slice(at, 200).to_pylist())
                for doc_id, raw in zip(doc_ids.slice(at, 200).to_pylist(), raws, strict=True):
                    out.add(doc_id, raw + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": [len(out.doc_ids)], "n_ids": [out.n_ids]})

    # The text's hash cuts ranges where many rows share an id, or have none.
    order = ("doc_id", "text_hash")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(write, MANIFEST), "packed-manifest")


def read_packed(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver adds up one count per file; a file is the work of one write task.
    """
    spark = manifest.sparkSession
    rows, base = [], 0
    for part, path, n_ids in sorted(tuple(r) for r in manifest.select("part", "path", "n_ids").collect()):
        rows.append((part, path, base))
        base += n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                file = PackedReader(path)
                for at in range(0, len(file.doc_ids), 10_000):
                    upto = min(at + 10_000, len(file.doc_ids))
                    crcs = []
                    for k in range(at, upto):
                        crc = 0
                        for ids in file.ids(int(file.starts[k]), int(file.starts[k + 1])):
                            crc = zlib.crc32(np.ascontiguousarray(ids), crc)
                        crcs.append(crc)
                    starts = file.starts[at : upto + 1]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.doc_ids[at:upto], pa.int64(), mask=file.nulls[at:upto].astype(bool)),
                        "start": pa.array(starts[:-1] + first, pa.int64()), "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                    })

    listed = spark.createDataFrame(rows, "part int, path string, first long")
    if rows:
        listed = listed.repartitionByRange(len(rows), "part")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the packed files to the shared folder and describe each document as read back from them."""
    manifest = write_packed(docs, fresh_path(docs.sparkSession, "packed-ids"), tokenizer, end_id)
    return read_packed(manifest)
