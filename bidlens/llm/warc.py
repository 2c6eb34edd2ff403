"""WARC archives written and read as a chunked record table: payloads go through tasks in chunks with running digests."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from bidlens.llm.common import small_batches, stored, table
from bidlens.session import broadcast_if_small, fresh_path

# Payload bytes of a chunk, bytes of an archive from which the next record opens another one, and level of compression.
CHUNK, ARCHIVE, LEVEL = 1 << 16, 1 << 28, 1
# Contract of the query: payloads of fewer bytes are always stored.
LEAST = 0
# Bytes read from an archive at once.
READ = 1 << 18
# The format's version line and the profile of a revisit record.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE, _UNSAFE_ID = re.compile(r"[\x00-\x20\x7f<>]"), re.compile(r"[\x00-\x20\x7f<>%]")


def file_at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    if re.match(r"^[A-Za-z][\w+.-]*://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _safe(text: str, unsafe: re.Pattern = _UNSAFE) -> str:
    """Without characters that would end a header line."""
    return unsafe.sub(lambda m: quote(m.group()), text)


def _id(name: str) -> str:
    """An id as a header has it, from which it is read back as it was."""
    return f"<{_safe(name, _UNSAFE_ID)}>"


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields if v is not None]
    return b"\r\n".join([VERSION, *lines, b"", b""])


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


class Archive:
    """One compressed archive, a gzip member per record; a record is opened, fed with chunks and ended."""

    def __init__(self, folder: str, level: int):
        system, at = file_at(folder)
        system.create_dir(at, recursive=True)
        # A new name for every attempt: only archives named by a task that ended count.
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.level = f"{folder}/{name}", level
        self.out, self.size, self.records = system.open_output_stream(f"{at}/{name}", compression=None), 0, 0
        info = b"software: chunked record table\r\nformat: WARC File Format 1.1\r\n"
        self.open([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))])
        self.feed(info)
        self.end()
        self.records = 0

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def open(self, fields) -> None:
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._put(self.member.compress(_headers(fields)))

    def feed(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def chunked(records: DataFrame, payload: str = "payload", chunk: int = CHUNK) -> DataFrame:
    """``records`` with ``chunk`` (from 0), ``last`` and ``data`` instead of the payload: a row per chunk, one at least, in order."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / chunk).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(payload), i * chunk + 1, F.lit(chunk)))
    kept = [c for c in records.columns if c != payload]
    parts = records.select(*kept, (n - 1).alias("chunks"), F.posexplode(pieces).alias("chunk", "data"))
    return parts.select(*kept, F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") == F.col("chunks")).alias("last"), "data")


def write_warc(records: DataFrame, folder: str, chunk: int = CHUNK, archive_bytes: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """Write ``records`` (record_id, uri, refers_to, payload binary) as archives below ``folder``; returns their list (path, records, size).

    A record with ``refers_to`` is a revisit: it holds the reply's header, the length included, and the digest, but no payload. Tasks
    write their own archives as chunks come in, and check the digest they carry along against that of the header. The list is stored
    by Spark, so archives of lost or repeated attempts are in none. A null payload is empty, a null uri has no header;
    spaces and control characters of ids and uris are percent-encoded. Repeated rows are repeated records.
    """
    small_batches(records.sparkSession)
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    held = records.select("record_id", "uri", "refers_to", F.coalesce("payload", F.lit(b"")).alias("payload"))
    held = held.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    whole = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    rows = chunked(held.withColumn("payload", whole), chunk=chunk)
    names = ["path", "records", "size"]

    def run(batches):
        archive, done, running = None, [], None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("record_id", "uri", "refers_to", "digest", "n", "chunk", "last", "data"))):
                record_id, uri, refers, digest, n, number, last, data = r
                if number == 0:
                    if archive is None or archive.size >= archive_bytes:
                        done += [archive.close()] if archive else []
                        archive = Archive(folder, level)
                    http, running = _http(n), hashlib.sha1()
                    archive.open([
                        ("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", _id(record_id)), ("WARC-Date", now),
                        ("WARC-Target-URI", None if uri is None else _safe(uri)), ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(digest))),
                        ("WARC-Refers-To", None if refers is None else _id(refers)), ("WARC-Profile", None if refers is None else PROFILE),
                        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (n if refers is None else 0))),
                    ])
                    archive.feed(http)
                running.update(data)
                archive.feed(data)
                if last:
                    if refers is None and running.hexdigest() != digest:
                        raise ValueError(f"payload of {record_id} changed while it was written")
                    archive.end()
        done += [archive.close()] if archive else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)

    schema = StructType([StructField("path", StringType()), StructField("records", LongType()), StructField("size", LongType())])
    return stored(rows.mapInArrow(run, schema), "warc-list")


def _blocks(stream, size: int) -> Iterator[bytes]:
    """Plain bytes of a file, inflated if it is made of gzip members, at most ``size`` at once."""
    data = stream.read(size)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(size)
        return
    member = zlib.decompressobj(47)
    while data:
        out = member.decompress(data, size)
        if out:
            yield out
        if member.eof:
            data = member.unused_data or stream.read(size)
            member = zlib.decompressobj(47)
        else:
            data = member.unconsumed_tail or stream.read(size)


class Feed:
    """Bytes of an archive in order: whole lines, or up to a number of bytes; holds a block at most."""

    def __init__(self, stream, name: str, size: int = READ):
        self.blocks, self.held, self.at, self.name = _blocks(stream, size), b"", 0, name

    def _more(self) -> bool:
        block = next(self.blocks, b"")
        self.held, self.at = self.held[self.at :] + block, 0
        return bool(block)

    def line(self) -> bytes | None:
        """The next line with its end; None at the end of the archive."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError(f"{self.name}: the archive ends in a line")
                return None
        line, self.at = self.held[self.at : end + 1], end + 1
        return line

    def some(self, n: int) -> bytes:
        """Between 1 and ``n`` bytes."""
        if self.at >= len(self.held) and not self._more():
            raise ValueError(f"{self.name}: the archive ends in a record")
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def _fields(feed: Feed) -> dict[str, str] | None:
    line = feed.line()
    while line is not None and not line.strip():
        line = feed.line()
    if line is None:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{feed.name}: no record starts here")
    fields: dict[str, str] = {}
    while (line := feed.line()) is not None and line.strip():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _named(value: str | None) -> str | None:
    return None if value is None else unquote(value.strip("<>"))


def record_chunks(stream, name: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of an archive: (record_id, record_type, uri, refers_to, declared bytes, declared digest, chunk, end, last, running digest, data).

    ``end`` is the number of payload bytes up to the end of the chunk, and the running digest covers these. Of replies the payload is
    the body; other kinds of records have their whole block as payload.
    """
    feed = Feed(stream, name)
    while (fields := _fields(feed)) is not None:
        left, kind = int(fields["content-length"]), fields.get("warc-type", "")
        declared = None
        if fields.get("content-type", "").startswith("application/http"):
            while left:
                line = feed.line() or b""
                left -= len(line)
                if not line.strip():
                    break
                key, _, value = line.partition(b":")
                if key.strip().lower() == b"content-length":
                    declared = int(value)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        head = (_named(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), _named(fields.get("warc-refers-to")), declared, digest)
        running, end, number = hashlib.sha1(), 0, 0
        while True:
            data = b""
            while left and len(data) < chunk:
                piece = feed.some(min(left, chunk - len(data)))
                data, left = data + piece, left - len(piece)
            running.update(data)
            end += len(data)
            yield *head, number, end, left == 0, base32(running.digest()), data
            number += 1
            if not left:
                break


def read_warc(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives ``files`` (path), one archive at a time in a task; a damaged archive is an error.

    Columns: path, record_id, record_type, uri, refers_to, declared_bytes, declared_digest, chunk, end, last, digest, data. A
    record without payload has one empty chunk. Descriptions of archives (``warcinfo``) are left out; archives that are not
    compressed are read too. A task holds a block of the archive and some chunks, never a record.
    """
    names = ["path", "record_id", "record_type", "uri", "refers_to", "declared_bytes", "declared_digest", "chunk", "end", "last", "digest", "data"]
    kinds = [StringType()] * 5 + [LongType(), StringType(), LongType(), LongType(), BooleanType(), StringType(), BinaryType()]
    arrow = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=names)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = file_at(path)
                with system.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for row in record_chunks(stream, path, chunk):
                        if row[1] == "warcinfo":
                            continue
                        rows.append((path, *row))
                        size += len(row[-1]) + 500
                        if size >= 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                    if rows:
                        yield made(rows)

    dealt = files.select("path").repartition(max(1, files.count()), "path")
    return dealt.mapInArrow(run, StructType([StructField(n, k) for n, k in zip(names, kinds)]))


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: (path, record_id, record_type, uri, refers_to, payload_bytes, payload_digest, verified).

    Bytes and digest of a reply are those counted over its chunks, ``verified`` says whether they are the declared ones. A
    revisit has no payload here, so it has the declared ones and ``verified`` null.
    """
    own = F.col("record_type") != "revisit"
    same = (F.col("digest") == F.col("declared_digest")) & (F.coalesce("declared_bytes", "end") == F.col("end"))
    return chunks.where("last").select(
        "path", "record_id", "record_type", "uri", "refers_to",
        F.when(own, F.col("end")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        F.when(own, same).alias("verified"),
    )


def with_revisits(records: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """``records`` (``key``, payload) with ``first``: of those with the same payload the smallest key, null where the record is stored itself.

    Payloads of fewer than ``least`` bytes are all stored, and so are all rows under the smallest key and rows without a smallest key
    (only null ones). Payloads are told apart by SHA-1 and length. Counts are combined map-side, and only keys that several rows
    share are joined back.
    """
    marked = records.withColumn("mark", F.struct(F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")))
    shared = marked.groupBy("mark").agg(F.min(key).alias("first"), F.count("*").alias("times")).where("times > 1").where(F.col("mark.n") >= least)
    shared = stored(shared.select("mark", "first"), "warc-shared")
    joined = marked.join(broadcast_if_small(shared), "mark", "left").drop("mark")
    return joined.withColumn("first", F.when(~F.col(key).eqNullSafe(F.col("first")), F.col("first")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))

    def name(c: str) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))

    marked = with_revisits(pages, "page_id")
    records = marked.select(name("page_id").alias("record_id"), F.col("url").alias("uri"), F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"), "payload")
    back = records_of(read_warc(write_warc(records, fresh_path(spark, "warc"))))
    kind = pages.schema["page_id"].dataType
    number = {c: F.nullif(F.substring_index(c, "urn:page:", -1), F.lit("")).cast(kind) for c in ("record_id", "refers_to")}
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")).cast("string")
    digest = F.when(F.coalesce("verified", F.lit(True)), F.col("payload_digest")).otherwise(bad)
    return back.select(number["record_id"].alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number["refers_to"].alias("refers_to"))


OP12_SQL = """
with hashed as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
digests as (
  select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as payload_digest
  from hashed),
firsts as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from digests)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from firsts
"""
