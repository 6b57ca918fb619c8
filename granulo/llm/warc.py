"""WARC records in ZIP packages: written by tasks, read back by byte ranges without extraction.

A package holds the member archive/data.warc.gz (a gzip member for each record) and the member indexes/index.cdx (a line
for each record: offset, length), both stored, as ZIP64. The reader finds the end of the central directory (and its ZIP64
form), parses the directory, follows a stored member's local header to its bytes, and reads index and records by ranges.
Ranges of consecutive records are dealt out to all workers, so one large package occupies many.

Records of equal payloads, from min_bytes on: the one with the largest page_id is the response, the others revisit it.

Defined results: a null html is an empty payload; a null url leaves the record without a target; equal rows are records
of their own, and equal page_ids with equal payloads both stay responses; other columns are ignored; an empty table gives
no rows. A member that is not stored, or a damaged directory, raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files, side

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
MIN_BYTES = 0
#: Bytes of records that a worker reads at once.
RANGE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

# ---- writing ----------------------------------------------------------------------------------


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record. A revisit keeps the HTTP head of the page and leaves out the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def originals(keyed: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(row, refers_to) of the records that revisit another; keyed: page_id, html, row, at rest."""
    html = F.coalesce("html", F.lit(""))
    d = common.cut(keyed.select("page_id", "row", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n")).filter(F.col("n") >= min_bytes).drop("n"))
    first = common.cut(d.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1"))
    return common.join_hot(d, first, ["sha"], "k").filter("page_id <> refers_to").select("row", "refers_to")


def write_packages(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes a package for each task; (package, records) tells what. Pages stay where they are: their tasks look up which of
    them revisit another."""
    spark = pages.sparkSession
    common.prepare(spark)
    files.make(folder)
    keyed = common.cut(pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row")))
    dealt = side.deal(originals(keyed, min_bytes), "row")

    def run(batches):
        name, n, at, index = f"pages-{TaskContext.get().partitionId():06d}.wacz", 0, 0, []
        those = side.Side(dealt, "row")
        with files.writer(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(DATA, "w", force_zip64=True) as data:
                for b in batches:
                    t = those.rows(b.column(3).to_numpy())
                    to = dict(zip(t.column("row").to_pylist(), t.column("refers_to").to_pylist(), strict=True)) if t is not None else {}
                    for page_id, url, html, row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        x = _gzip(record(page_id, url, (html or "").encode(), to.get(row)))
                        data.write(x)
                        index.append(f"{at} {len(x)}\n")
                        at += len(x)
                        n += 1
            z.writestr(INDEX, "".join(index))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["package", "records"])

    out = common.cut(keyed.mapInArrow(run, "package string, records long"))
    common.free(keyed)
    return out


# ---- reading ----------------------------------------------------------------------------------


def central_directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file by name: method, size, and offset of the local header. read(offset, size) gives bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, at = struct.unpack("<H", tail[end + 10 : end + 12])[0], *struct.unpack("<II", tail[end + 12 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at64,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        x = read(at64, 56)
        if x[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, at = struct.unpack("<QQQ", x[32:56])
    directory, out, p = read(at, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain, names, extras, comments, local = *struct.unpack("<H", directory[p + 10 : p + 12]), *struct.unpack("<II", directory[p + 20 : p + 28]), *struct.unpack("<HHH", directory[p + 28 : p + 34]), *struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + names].decode()
        extra, q = directory[p + 46 + names : p + 46 + names + extras], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + n
        out[name] = method, packed, local
        p += 46 + names + extras + comments
    return out


def stored_member(read, directory: dict, name: str) -> tuple[int, int]:
    """Offset and size of a stored member's bytes in the file."""
    method, size, local = directory[name]
    if method != 0:
        raise ValueError(f"{name} is not stored")
    head = read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    names, extras = struct.unpack("<HH", head[26:30])
    return local + 30 + names + extras, size


def record_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, part, offset, size, sizes) of runs of consecutive records, from directories and indexes alone."""

    def run(batches):
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                read = lambda at, n, path=path: files.read(path, at, n)
                directory = central_directory(read, size)
                data, _ = stored_member(read, directory, DATA)
                lines = read(*stored_member(read, directory, INDEX)).split()
                runs, offs, sizes = [], [int(x) for x in lines[::2]], [int(x) for x in lines[1::2]]
                for o, n in zip(offs, sizes, strict=True):
                    if not runs or o + n - runs[-1][0] > range_bytes:
                        runs.append((o, []))
                    runs[-1][1].append(n)
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs)), pa.array(range(len(runs)), pa.int32()), pa.array([data + o for o, _ in runs], pa.int64()), pa.array([sum(n) for _, n in runs], pa.int64()), pa.array([n for _, n in runs], pa.list_(pa.int64()))], ["path", "part", "offset", "size", "sizes"])

    return files.listing(spark, folder, "*.wacz").mapInArrow(run, "path string, part int, offset long, size long, sizes array<long>")


def parse(data: bytes) -> tuple[int, int, str, str, int | None]:
    """A row of PAGES from a record; a response's payload is measured and hashed, and must have the digest it states."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x.strip("<>").rpartition(":")[2])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page = number(fields["warc-record-id"])
    if fields["warc-type"] == "revisit":
        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
        return page, size, digest, "revisit", number(fields["warc-refers-to"])
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of record {page} doesn't have its digest")
    return page, len(payload), digest, "response", None


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """PAGES of all records of a folder's packages."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for path, _, offset, size, sizes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data, at, out = files.read(path, offset, size), 0, []
                for n in sizes:
                    out.append(parse(zlib.decompress(data[at : at + n], 31)))
                    at += n
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return record_ranges(spark, folder).repartition(tasks, "path", "part").mapInArrow(run, PAGES)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "packages")
    write_packages(common.table(spark, sf_dir, "pages"), folder)
    return read_packages(spark, folder)


#: Each five digits of the hexadecimal hash are four of the base32 form.
SQL = {"op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM p
), t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t
"""}
