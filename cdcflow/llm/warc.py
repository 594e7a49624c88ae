"""WARC archives through a chunked record table: payloads travel as rows of record identifier and chunk number, never as whole records.

Writing: each page's payload is cut into chunks, one row each, in order, within the task that holds the page; the writer streams them into one archive a partition,
every record a gzip member of its own, and keeps one chunk at a time. What a header must say beforehand (length, digest, kind) comes with the first chunk.
Reading: archives are inflated piece by piece into the same kind of rows, each with the length and SHA-1 digest of the payload up to its end, so the last chunk of a
record has those of the whole; it must agree with the header, or the read fails. Tasks that are repeated write files of new names, and only those of the manifest count.

Records of equal payloads become one response and revisits of it. Payloads are told apart by length and SHA-1. The rows that one digest takes may be
a large share of all: digests beyond a fraction of the rows (at most HOT of them, so their table is bounded) are joined by broadcast, the others by shuffle.

Defined cases: a null payload counts as empty, a null url as an empty target; an empty payload is one chunk of no bytes; a page without an id is the last in the order of ids;
rows that share the smallest page_id of a payload are all responses, and revisits name the one with the smallest url; equal rows give a record each;
an empty table gives no archive and no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table, written
from .seekable import opened

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNK = 65_536
HOT = 200
SMALL = 20_000  # rows of some 200 bytes
BLOCK = 1 << 18  # bytes read at once


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in base 32: 32 characters."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(groups, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_kinds(records: DataFrame, least_bytes: int) -> DataFrame:
    """Add record_type, refers_to and refers_id to records (page_id, url, record_id, payload_bytes, payload_digest, ...)."""
    identity = ["payload_digest", "payload_bytes"]
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url", "record_id")).alias("first")
    groups = records.where(F.col("payload_bytes") >= least_bytes).groupBy(*identity).agg(F.count("*").alias("copies"), first)
    repeated = written(groups.where("copies > 1"), "repeated", keep=True)
    total, n = repeated.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    hot = F.col("copies") * HOT > total  # fewer than HOT of them
    many = F.broadcast(repeated.where(hot).select(*identity, F.col("first").alias("many")))
    few = repeated.where(~hot).select(F.col("payload_digest").alias("k"), "payload_bytes", F.col("first").alias("few"))
    few = few.hint("shuffle_hash") if n > SMALL else few  # so payloads aren't sorted; below, Spark may broadcast it
    # what the first join has met needs no partner in the second and is dealt anywhere
    anywhere = F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    met = records.join(many, identity, "left").withColumn("k", F.when(F.col("many").isNull(), F.col("payload_digest")).otherwise(anywhere))
    met = met.join(few, ["k", "payload_bytes"], "left").withColumn("first", F.coalesce("many", "few"))
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return met.select(
        *records.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.record_id")).alias("refers_id"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def record_table(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row for each of pages (page_id, url, payload: binary): page_id, url, record_id, payload, payload_bytes, payload_digest, record_type, refers_to, refers_id, refers_url."""
    filled = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    told = filled.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    key = F.md5(F.to_json(F.struct("page_id", "url", "payload_digest"), {"ignoreNullFields": "false"}))
    return with_kinds(told.withColumn("record_id", F.regexp_replace(key, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")), least_bytes)


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records with chunk_no and data, the chunk's bytes, for payload: a row a chunk, in order; a revisit is one chunk without bytes."""
    size = F.when(F.col("record_type") == "revisit", 0).otherwise(F.octet_length("payload"))
    numbered = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / chunk).cast("int") - 1, F.lit(0)))))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return numbered.select(*[c for c in records.columns if c != "payload"], F.col("chunk_no").cast("long").alias("chunk_no"), data.alias("data"))


def _target(url: str) -> str:
    return quote(url, safe="!#$&'()*+,/:;=?@[]~%")


def _headers(fields: list[tuple[str, object]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


class ArchiveWriter:
    """Writes one archive; holds one chunk at a time."""

    def __init__(self, uri: str, date: str):
        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.date, self.member, self.records = fs.open_output_stream(path, compression=None), date, None, 0

    def begin(self, r: dict) -> None:
        """Start the record of a row of the chunk table, after the end of the one before."""
        self.end()
        revisit = r["record_type"] == "revisit"
        http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", r["payload_bytes"])], "HTTP/1.1 200 OK")
        fields = [
            ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", self.date), ("WARC-Target-URI", _target(r["url"])),
            ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", r["refers_id"]),
            ("WARC-Refers-To-Target-URI", _target(r["refers_url"]) if revisit else None), ("WARC-Refers-To-Date", self.date if revisit else None),
            ("Page-Id", r["page_id"]), ("Refers-To-Page-Id", r["refers_to"]),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if revisit else r["payload_bytes"])),
        ]
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.records += 1
        self.add(_headers(fields, VERSION) + http)

    def add(self, data: bytes) -> None:
        self.file.write(self.member.compress(data))

    def end(self) -> None:
        if self.member is not None:
            self.add(b"\r\n\r\n")
            self.file.write(self.member.flush())
            self.member = None

    def close(self) -> None:
        self.end()
        self.file.close()


def _write_partition(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            writer = writer or (ArchiveWriter(uri, date) if batch.num_rows else None)
            heads = batch.select([c for c in batch.schema.names if c != "data"])
            for i, data in enumerate(batch.column("data")):
                if not batch.column("chunk_no")[i].as_py():
                    writer.begin(heads.slice(i, 1).to_pylist()[0])
                writer.add(data.as_py())
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "records": [writer.records]})

    return write


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, chunk: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, payload) to archives; returns the manifest: part, path, records. Payloads of least_bytes or more are written once."""
    chunks = chunk_table(record_table(pages, least_bytes), chunk)
    made = chunks.mapInArrow(_write_partition(folder or shared_dir(pages.sparkSession, "warc"), date), "part long, path string, records long")
    return written(made, "manifest", keep=True)  # a row an archive


class _Member:
    """Bytes of an archive's gzip members, one record after another, inflated as they are asked for."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file, self.raw, self.inflate, self.have = fs.open_input_stream(path, compression=None), b"", None, bytearray()

    def next(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        self.raw = self.raw or self.file.read(BLOCK)
        self.inflate = zlib.decompressobj(31) if self.raw else None
        return self.inflate is not None

    def _more(self) -> bool:
        if self.inflate is None or self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.raw or self.file.read(BLOCK)
        if not raw:
            raise ValueError("archive ends within a record")
        self.have += self.inflate.decompress(raw, BLOCK)
        self.raw = self.inflate.unused_data if self.inflate.eof else b""
        return True

    def head(self) -> tuple[str, dict[str, str]]:
        """First line and fields up to an empty line."""
        while b"\r\n\r\n" not in self.have:
            if not self._more():
                raise ValueError("record without the end of its head")
        raw, _, rest = bytes(self.have).partition(b"\r\n\r\n")
        self.have = bytearray(rest)
        first, *lines = raw.decode().split("\r\n")
        return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise ValueError("record shorter than its length")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def finish(self) -> None:
        while self._more():
            pass
        if bytes(self.have) != b"\r\n\r\n":
            raise ValueError("record longer than its length")
        self.have.clear()


def _read(path: str, chunk: int) -> Iterator[dict]:
    """Rows of one archive's records, chunk by chunk."""
    member = _Member(path)
    while member.next():
        first, head = member.head()
        if first != VERSION:
            raise ValueError(f"{path}: {first} instead of {VERSION}")
        _, http = member.head()
        size, declared = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
        number = lambda name: int(head[name]) if name in head else None
        row = {
            "record_id": head["warc-record-id"], "page_id": number("page-id"), "url": head["warc-target-uri"], "record_type": head["warc-type"],
            "refers_id": head.get("warc-refers-to"), "refers_to": number("refers-to-page-id"),
        }
        left, sha, at = 0 if row["record_type"] == "revisit" else size, hashlib.sha1(), 0
        while True:
            data = member.take(min(left, chunk))
            left -= len(data)
            sha.update(data)
            last = not left
            so_far = base64.b32encode(sha.copy().digest()).decode()
            if row["record_type"] == "revisit":
                so_far = declared  # of the payload that it stands for
            elif last and so_far != declared:
                raise ValueError(f"{path}: the payload of {row['record_id']} fails its digest")
            done = size if row["record_type"] == "revisit" else size - left
            yield row | {"chunk_no": at, "is_last": last, "bytes_so_far": done, "digest_so_far": so_far, "data": data}
            at += 1
            if last:
                break
        member.finish()
    member.file.close()


CHUNKS = "record_id string, page_id long, url string, record_type string, refers_id string, refers_to long, chunk_no long, is_last boolean, bytes_so_far long, digest_so_far string, data binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _read_archives(chunk: int, with_data: bool, batch_bytes: int = 1 << 23):
    schema = pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in CHUNKS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for row in _read(path, chunk):
                    if not with_data:
                        row["data"] = None
                        if not row["is_last"]:
                            continue
                    rows.append(row)
                    size += 500 + len(row["data"] or b"")
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that a manifest names; without data, the last chunk of each record only, with the figures of the whole."""
    n = max(1, manifest.count())
    return manifest.select("part", "path").repartition(n, "part").mapInArrow(_read_archives(chunk, with_data), CHUNKS)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    read = read_archives(write_archives(pages, least_bytes=0), with_data=False)
    return read.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP13_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h,
    list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || h[5 * (i // 4) + 1:5 * (i // 4) + 5] AS BIGINT) >> (15 - 5 * (i % 4))) & 31)]), lambda a, b: a || b) AS payload_digest
  FROM p
), f AS (
  SELECT *, first_value(page_id) OVER (PARTITION BY h, payload_bytes ORDER BY page_id NULLS LAST) AS least FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM f
"""
