"""WARC records in ZIP-packaged archives: written, located and range-read without extraction.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, where every record
is a gzip member of its own, and ``indexes/index.cdxj``, sorted lines of a record's key, time and a JSON object with its
offset and length. The reader finds the end record, follows the ZIP64 locator where there is one, parses the
central directory, derives where a stored member's bytes begin from its local header, and then reads records by their
ranges alone. Files are opened through Arrow's file systems, so a shared folder can be local or in a store.

Records are WARC/1.1: a response's block is an HTTP response whose entity is the payload, a revisit's block is the
HTTP head alone. The page's id stands in a field of its own, ``X-Page-ID``.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table
from tessera.session import scratch_path, stash

# Fixed values of the ZIP format.
END_SIGNATURE = b"PK\x05\x06"
END64_SIGNATURE = b"PK\x06\x06"
LOCATOR64_SIGNATURE = b"PK\x06\x07"
ENTRY_SIGNATURE = b"PK\x01\x02"
LOCAL_SIGNATURE = b"PK\x03\x04"
STORED = 0

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 1000
#: An archive is closed once its records have so many bytes; a reader's range has about as many as the second.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
#: Repeated digests are broadcast up to this number, 40 bytes each.
FEW = 500_000


@dataclass
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    size: int
    stored_size: int
    header: int


def directory(f) -> list[Member]:
    """The entries of an open ZIP file (anything with ``size`` and ``read_at``)."""
    total = f.size()
    tail = f.read_at(min(total, 65_557), max(0, total - 65_557))
    at = tail.rfind(END_SIGNATURE)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, size, offset = struct.unpack_from("<H", tail, at + 10)[0], *struct.unpack_from("<II", tail, at + 12)
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
        if tail[at - 20 : at - 16] != LOCATOR64_SIGNATURE:
            raise ValueError("the end record points to ZIP64, but there is no locator")
        end64 = f.read_at(56, struct.unpack_from("<Q", tail, at - 12)[0])
        if end64[:4] != END64_SIGNATURE:
            raise ValueError("the ZIP64 locator points elsewhere")
        count, size, offset = *struct.unpack_from("<Q", end64, 32), *struct.unpack_from("<QQ", end64, 40)
    data, at, found = f.read_at(size, offset), 0, []
    for _ in range(count):
        if data[at : at + 4] != ENTRY_SIGNATURE:
            raise ValueError("an entry of the central directory is damaged")
        method = struct.unpack_from("<H", data, at + 10)[0]
        stored, full = struct.unpack_from("<II", data, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            kind, length = struct.unpack_from("<HH", data, extra)
            if kind == 1:  # the 64-bit values, each there only if its 32-bit field is full
                place = extra + 4
                if full == 0xFFFFFFFF:
                    full, place = struct.unpack_from("<Q", data, place)[0], place + 8
                if stored == 0xFFFFFFFF:
                    stored, place = struct.unpack_from("<Q", data, place)[0], place + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", data, place)[0]
            extra += 4 + length
        found.append(Member(name, method, full, stored, header))
        at = end + n_comment
    return found


def begin(f, member: Member) -> int:
    """Where a stored member's bytes are."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = f.read_at(30, member.header)
    if local[:4] != LOCAL_SIGNATURE:
        raise ValueError(f"{member.name}: no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def record_id(*parts: object) -> str:
    """The id that parts stand for, always the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(kind: str, own: str, page: int | None, uri: str, date: str, payload: bytes, digest: str, refers_to: tuple[str, int] | None = None) -> bytes:
    """A WARC/1.1 record, gzipped on its own. refers_to: the id and the page of the record that has the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if page is not None:
        fields["X-Page-ID"] = str(page)
    if refers_to:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"], fields["X-Refers-To-Page-ID"] = refers_to[0], str(refers_to[1])
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's fields, its HTTP fields (names in lower case) and its payload."""
    head, _, rest = zlib.decompress(data, wbits=31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    status, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in status.decode().split("\r\n")[1:])}
    return fields, http, payload


def sort_key(uri: str) -> str:
    """The host's labels from the last to the first, then the path; what has no host stands as it is."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return quote(uri.lower()) or "-"
    host, slash, path = rest.partition("/")
    name, colon, port = host.lower().partition(":")
    return quote(",".join(reversed(name.split("."))) + colon + port + ")" + (slash or "/") + path.lower(), safe=",:()/?&=%;+@!$*'~")


class Archive:
    """One archive on its way to the shared folder; it gets its name once it is whole."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.store, root = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path, self.temporary, self.uri = f"{root}/{name}.wacz", f"{root}/{name}.{attempt}.tmp", f"{folder}/{name}.wacz"
        self.out = self.store.open_output_stream(self.temporary)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, uri: str, date: str, digest: str, data: bytes) -> None:
        self.data.write(data)
        time = "".join(c for c in date if c.isdigit())
        entry = {"url": uri, "digest": f"sha1:{digest}", "filename": DATA, "offset": str(self.size), "length": str(len(data))}
        self.lines.append(f"{sort_key(uri)} {time} {json.dumps(entry)}")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)))
        self.zip.close()
        self.out.close()
        self.store.move(self.temporary, self.path)
        return self.uri, len(self.lines), self.size


def write(pages: DataFrame, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, few: int = FEW) -> DataFrame:
    """Archives of a record per row of (page_id, url, html) -> (archive, records, bytes), a row an archive.

    Payloads are grouped by digest through a pre-aggregated maximum; only digests that occur more than once meet the
    pages again. They are broadcast if there are at most ``few`` (40 bytes each), so that no payload is shuffled;
    beyond that they are joined by a shuffle, which adaptive execution splits where one digest is hot.
    """
    spark = pages.sparkSession
    small_batches(spark, 8 << 20)
    folder = scratch_path(spark, "warc")
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    digested = slim.withColumn("digest", F.sha1("payload"))
    groups = digested.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = stash(groups.where("n > 1").select(F.unhex("digest").alias("g_digest"), "first"), "digests")
    if groups.count() <= few:
        groups = F.broadcast(groups)
    typed = digested.join(groups, F.unhex("digest") == F.col("g_digest"), "left").select("page_id", "url", "payload", "digest", "first")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, open_, number = TaskContext.get(), None, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, url, body, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None:
                    open_, number = Archive(folder, f"{task.partitionId():06d}-{number:04d}", task.taskAttemptId()), number + 1
                again, shared = first is not None and first != page, record_id("payload of", first, digest)
                # a record that others refer to has the id that they know; any other one that of its place
                own = shared if first is not None and not again else record_id(folder, open_.path, len(open_.lines))
                uri, kind = " ".join(url.split()) or "urn:page:-", "revisit" if again else "response"
                open_.add(uri, date, digest, record(kind, own, page, uri, date, body, digest, (shared, first) if again else None))
                if open_.size >= archive_bytes:
                    done.append(open_.close())
                    open_ = None
        if open_ is not None:
            done.append(open_.close())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=["archive", "records", "bytes"])

    return stash(typed.mapInArrow(put, "archive string, records long, bytes long"), "archives")


def locate(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, begin, length, sizes): ranges of neighbouring records, from each archive's directory and index."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    members = {m.name: m for m in directory(f)}
                    base = begin(f, members[DATA])
                    index = members[INDEX]
                    lines = f.read_at(index.size, begin(f, index)).decode().splitlines()
                rows, sizes, start = [], [], 0
                entries = (json.loads(x.split(" ", 2)[2]) for x in lines)
                total = 0
                for offset, length in sorted((int(e["offset"]), int(e["length"])) for e in entries):
                    if sizes and total + length > range_bytes:
                        rows.append((uri, base + start, sizes))
                        start, sizes, total = offset, [], 0
                    sizes.append(length)
                    total += length
                rows += [(uri, base + start, sizes)] if sizes else []
                yield pa.RecordBatch.from_pydict(dict(zip(("archive", "begin", "sizes"), zip(*rows))), pa.schema([("archive", pa.string()), ("begin", pa.int64()), ("sizes", pa.list_(pa.int64()))]))

    spread = archives.select("archive").repartition(_tasks(archives.sparkSession), "archive")
    return spread.mapInArrow(look, "archive string, begin long, sizes array<long>")


def _tasks(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload_bytes, payload) of every record, read by its range.

    A response's length and digest come from the payload itself; a revisit has its field's digest and a null length.
    """
    spread = locate(archives)
    spread = spread.repartition(_tasks(archives.sparkSession), "archive", "begin")

    def page(text: str | None) -> int | None:
        return int(text) if text else None

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    data = f.read_at(sum(sizes), at)
                rows, place = [], 0
                for size in sizes:
                    fields, _, body = parse(data[place : place + size])
                    place += size
                    response = fields["warc-type"] == "response"
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if response and digest != hashlib.sha1(body).hexdigest():
                        raise ValueError(f"{uri} at {at}: the payload's digest differs")
                    rows.append((page(fields.get("x-page-id")), fields["warc-type"], page(fields.get("x-refers-to-page-id")), digest, len(body) if response else None, body if with_payload else None))
                schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema)

    return spread.mapInArrow(fetch, "page_id long, record_type string, refers_to long, digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): every page written to archives and read back.

    Null html is an empty payload; a null page_id stays null and refers like any other page, but is never referred
    to; rows that repeat a page_id with equal html are all responses if that page has the largest id; an empty table
    gives an empty result; other columns are ignored.
    """
    records = stash(read(write(pages), with_payload=False).drop("payload"), "records")
    lengths = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest")).agg(F.max("payload_bytes").alias("r_bytes"))
    whole = records.where("record_type = 'response'").withColumn("r_bytes", F.col("payload_bytes"))
    again = records.where("record_type = 'revisit'").join(lengths, (F.col("refers_to") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_page", "r_digest")
    columns = ["page_id", F.col("r_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return whole.select(*columns).unionByName(again.select(*columns))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archives. Null html is an empty payload, which like all short ones is a response; a null
    page_id stays null; pages that repeat an id with equal html are all responses if it is the largest; an empty table
    gives no rows."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {LEAST_REVISIT} AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND page_id <> m THEN m END AS refers_to
FROM q
"""
