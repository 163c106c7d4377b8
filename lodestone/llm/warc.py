"""WARC archives by a deterministic sharded writer, and their reader.

Records are sorted by ``page_id`` in ranges of near-equal bytes, whose boundaries come from exact counts, so that the
same pages give the same files however they are split. Each record is a gzip member of its own, with headers and digests
made anew. A file that reaches a compressed size is closed and the next one begun. Files get temporary names; only
those that the manifest of a finished job lists are renamed, so a lost or repeated task leaves nothing that counts.

Of equal payloads of some length, the one with the largest page_id is stored; the others are revisits, which name it and
keep the HTTP headers alone, as WARC 1.1 has it for identical payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import files
from lodestone.llm.copies import join_groups
from lodestone.llm.histogram import LOW, bucket_of, count_below, splitters
from lodestone.llm.shared import discard, fresh_path, materialize

#: Payload bytes from which copies are revisits; bytes of a range and compressed bytes of a file, about; what a record has besides its payload, about.
MIN_REVISIT, RANGE_BYTES, ROLL_BYTES, OVERHEAD = 1000, 256 << 20, 128 << 20, 600
#: Ranges are one expression; of more bytes than these take at ``range_bytes``, ranges grow.
MAX_RANGES = 2048
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, BATCH = 1 << 20, 10_000
MANIFEST = "shard int, part int, written string, path string, records long, bytes long, sha256 string"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, file string, offset long"


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """A name that the same record always gets; ``copy`` tells equal rows apart."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{url}|{digest}|{copy}'.encode()).hexdigest()[:32])}>"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _line(value: str) -> str:
    """Without what would end a header line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, original: tuple | None, date: str = DATE) -> bytes:
    """A record, uncompressed. ``original``: page_id and url of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if original:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*original, digest, 0)}"]
        head += [f"WARC-Refers-To-Target-URI: {_line(original[1])}"] if original[1] is not None else []
        head += [f"X-Refers-To-Page-ID: {original[0]}"] if original[0] is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(digest)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(raw: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


class RollingWriter:
    """Writes records to one file after the other; holds one record."""

    def __init__(self, uri: str, shard: int, roll_bytes: int):
        self.uri, self.shard, self.roll_bytes = uri, shard, roll_bytes
        self.part, self.out, self.rows = 0, None, []  # rows: the manifest's

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.written = f"{self.uri}/_temporary/{uuid.uuid4().hex}.warc.gz"
            system, path = files.opened(self.written)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None)  # members are compressed here, whatever the name ends in
            self.size, self.n, self.digest = 0, 0, hashlib.sha256()
        member = zipped(raw)
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.n += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.written, f"{self.uri}/pages-{self.shard:05d}-{self.part:05d}.warc.gz", self.n, self.size, self.digest.hexdigest()))
            self.part, self.out = self.part + 1, None


SAME = ("page_id", "url", "payload_sha256")


def _indexed(pages: DataFrame) -> DataFrame:
    """The pages with the payload's bytes, length and digest; rows that are equal in ``SAME`` are equal in all."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return typed.select("page_id", "url", F.sha2("payload", 256).alias("payload_sha256"), F.octet_length("payload").cast("long").alias("size"), "payload")


def _copies(index: DataFrame, min_revisit: int) -> DataFrame:
    """For each payload that more rows than one have: ``original``, page_id and url of the response, and the count of different rows."""
    each = index.where(F.col("size") >= min_revisit).groupBy(*SAME).agg(F.count("*").alias("n"))
    groups = each.groupBy("payload_sha256").agg(F.max(F.struct("page_id", "url")).alias("original"), F.sum("n").alias("copies"), F.count("*").alias("rows"))
    return groups.where("copies > 1")


def _originals(index: DataFrame, copies: DataFrame) -> DataFrame:
    """``SAME`` of the rows whose payload another row has, too: ``original``, page_id and url of the response, and ``first`` where it is this one."""
    total = copies.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    named = join_groups(index.select(*SAME).distinct(), copies, "payload_sha256", "rows", total)
    return named.select(*SAME, "original", F.struct("page_id", "url").eqNullSafe(F.col("original")).alias("first"))


def _cuts(index: DataFrame, range_bytes: int) -> tuple[Column, int]:
    """The shard of a row, and how many shards there are.

    Boundaries between page ids are exact counts of bytes, within a tenth of a range. A range of more than two, as of a
    page id that many rows have, is parted by payload and url.
    """
    key = F.coalesce(F.col("page_id"), F.lit(LOW))
    rows = index.select(key.alias("key"), (F.col("size") + OVERHEAD).alias("weight"))
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    ranges = min(max(1, math.ceil(total / range_bytes)), MAX_RANGES)
    share = max(1, total // ranges)
    bounds = sorted(set(splitters(rows, [share * k for k in range(1, ranges)], share // 10))) if ranges > 1 else []
    below = [0, *(count_below(rows, bounds).weight if bounds else []), total]
    parts = [math.ceil((b - a) / share) if b - a > 2 * share else 1 for a, b in zip(below, below[1:], strict=False)]
    at, part = bucket_of(key, bounds), F.lit(0)
    for k, n in enumerate(parts):
        if n > 1:  # at most half as many as there are ranges
            part = F.when(at == k, F.pmod(F.xxhash64("payload_sha256", "url"), F.lit(n)).cast("int")).otherwise(part)
    first = [sum(parts[:k]) for k in range(len(parts))]
    return F.element_at(F.array(*map(F.lit, first)), at + 1) + part, sum(parts)


def write_warc(pages: DataFrame, uri: str, range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, date: str = DATE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files under ``uri`` and return the manifest, a row for each file.

    A null html is empty, and a null url or page_id has no header. Null page ids come first; rows of equal page_id are
    sorted by url and payload. Of equal payloads the response is the row with the largest page_id, then the largest
    url, nulls least; of rows that are equal in all, the first written. Each row is a record, repeated rows too. No
    file is written for an empty table; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = _indexed(pages)
    index = materialize(rows.drop("payload"), "warc-index")
    shard, shards = _cuts(index, range_bytes)
    copies = materialize(_copies(index, min_revisit), "warc-copies")
    originals = materialize(_originals(index, copies), "warc-originals")
    types = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("written", pa.string()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, same, original, first, copy = None, None, None, False, 0
        made: list[tuple] = []
        for batch in batches:
            shards_of, ids, urls, keys = (batch.column(c).to_pylist() for c in range(4))
            payloads, (firsts, original_ids, original_urls) = batch.column(4), (batch.column(c) for c in (5, 6, 7))
            for k, here in enumerate(zip(shards_of, ids, urls, keys, strict=True)):
                if out is None or out.shard != here[0]:
                    if out:
                        out.close()
                        made += out.rows
                    out = RollingWriter(uri, here[0], roll_bytes)
                if here != same:
                    same, original, first, copy = here, None, False, 0
                payload = payloads[k].as_py()
                if payload is None:  # comes before the rows that it tells about
                    original, first = (original_ids[k].as_py(), original_urls[k].as_py()), firsts[k].as_py()
                    continue
                refers = None if original is None or (first and copy == 0) else original
                out.add(record(here[1], here[2], payload, hashlib.sha1(payload).hexdigest(), copy, refers, date))
                copy += 1
        if out:
            out.close()
            made += out.rows
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), types, strict=True)], schema=types)

    none = F.lit(None)
    told = originals.select(*SAME, none.cast("binary").alias("payload"), "first", F.col("original.page_id").alias("original_id"), F.col("original.url").alias("original_url"))
    laid = rows.select(*SAME, "payload", none.cast("boolean").alias("first"), none.cast("long").alias("original_id"), none.cast("string").alias("original_url")).unionByName(told)
    dealt = laid.select(shard.alias("shard"), *SAME, "payload", "first", "original_id", "original_url").repartitionById(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", *SAME, F.col("payload").isNotNull())
    manifest = materialize(dealt.mapInArrow(write, MANIFEST), "warc-manifest")
    discard(index, copies, originals)
    return commit(manifest, uri)


def commit(manifest: DataFrame, uri: str) -> DataFrame:
    """Give the files of ``manifest`` their names, and write it beside them: from then on the archive is there.

    To do it again, after a loss at any point, changes nothing: a file that has its name already is left.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for written, path, size in zip(*(batch.column(c).to_pylist() for c in (2, 3, 5)), strict=True):
                system, source = files.opened(written)
                _, target = files.opened(path)
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
                elif system.get_file_info(target).size != size:
                    raise FileNotFoundError(f"{written} is gone, and {path} is not it")
            yield batch

    manifest.mapInArrow(rename, MANIFEST).write.mode("overwrite").parquet(f"{uri}/_manifest")
    discard(manifest)
    return manifest.sparkSession.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def members(path: str, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file; a member is held whole."""
    source = files.read(path)
    try:
        held, at, start, end, press, parts = b"", 0, 0, False, zlib.decompressobj(31), []
        while held or not end:
            if not held:
                held = source.read(chunk)
                end = not held
                if end:
                    break
            parts.append(press.decompress(held))
            at += len(held) - len(press.unused_data)
            held = press.unused_data
            if press.eof:
                yield start, b"".join(parts)
                start, press, parts = at, zlib.decompressobj(31), []
        if parts:
            raise ValueError(f"{path} ends within the record at {start}")
    finally:
        source.close()


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}, rest


def parsed(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id of a record; its digests are checked."""
    head, rest = _headers(raw)
    block = rest[: int(head["content-length"])]
    if len(rest) != len(block) + 4 or f"sha1:{base32(hashlib.sha1(block).hexdigest())}" != head["warc-block-digest"]:
        raise ValueError(f"record {head['warc-record-id']} has another block than its digest says")
    http, payload = _headers(block)
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), str(len(payload))) != (digest, http["content-length"]):
        raise ValueError(f"record {head['warc-record-id']} has another payload than its digest says")
    number = lambda name: int(head[name]) if name in head else None
    return number("x-page-id"), int(http["content-length"]), digest, head["warc-type"], number("x-refers-to-page-id"), head.get("warc-target-uri"), head["warc-record-id"].strip("<>")


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row for each record of the files in ``manifest``, a file a task: ``ROWS``. A digest that is wrong fails the read."""
    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("file", pa.string()), ("offset", pa.int64())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, name = [], path.rpartition("/")[2]
                for offset, raw in members(path):
                    rows.append((*parsed(raw), name, offset))
                    if len(rows) == BATCH:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return manifest.select("shard", "part", "path").repartitionByRange(max(1, manifest.count()), "shard", "part").select("path").mapInArrow(read, ROWS)


def warc_archive(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and describe each record as read back from them."""
    return read_warc(write_warc(pages, fresh_path(pages.sparkSession, "warc")))


ORACLE = """WITH stored AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
told AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS original FROM stored)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN n < 1000 OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to FROM told"""
