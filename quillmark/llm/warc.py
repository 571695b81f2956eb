"""Content-addressed WARC archive.

Method
------
* Every page gives a WARC record.  Its payload is identified by SHA-256 (with SHA-1 in
  base32 for ``WARC-Payload-Digest``).  Of equal payloads the record with the largest id
  is the response that stores the bytes; the others are revisits that refer to it.
* The archive is a folder of WARC segments of bounded bytes, one gzip member a record, so
  any record can be read alone.  A task writes each segment under a name of its own and
  leaves the name in the table ``index``; a lost or repeated task's files are in no index.
  Beside it ``headers`` keeps each record's exact header and the digest of its payload.
* Reading decompresses a segment record by record, recomputes both digests of each stored
  payload and fails on a mismatch.  Original records come back by joining headers to
  payloads on the digest.

Only ids and digests are grouped; payload bytes are shuffled once, on the record's own id,
so a payload that a third of the pages share gathers in no task.  Joins on the digest deal
the rows of such a payload by broadcast or over as many copies as it needs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Folder, discard, scratch, table, weighted_join, written
from .textkernel import small_batches

#: Payloads below this many bytes are never made revisits.
LEAST_REVISIT = 0
#: Date of all records of an archive, unless given.
DATE = "2026-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Bytes of records, before compression, that a segment holds (or one larger record).
SEGMENT = 64 << 20
#: Records of one payload that a task of ``original_records`` joins.
SHARE = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests(payload: bytes) -> tuple[str, str]:
    return hashlib.sha256(payload).hexdigest(), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_marks(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, sha256, payload_digest, payload_bytes) of every page, written once."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8 << 20, "html"):
            payloads = [(x or "").encode() for x in batch.column(2).to_pylist()]
            found = [_digests(p) for p in payloads]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in found]), pa.array([b for _, b in found]), pa.array([len(p) for p in payloads], pa.int64())],
                names=["id", "url", "sha256", "payload_digest", "payload_bytes"],
            )

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return written(chosen.mapInArrow(run, f"id {kind}, url string, sha256 string, payload_digest string, payload_bytes long"), "marks")


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(identity: Column, sha: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(identity.cast("string"), F.lit("")), sha).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(date: str) -> Column:
    """Header block of a record, without the blank line that ends it."""
    http = F.col("http")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"), F.col("sha256"))),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-SHA256: "), F.col("sha256")),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("id").cast("string"))),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to"), F.col("sha256")))),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)).cast("string")),
    ]
    return F.concat_ws("\r\n", *lines)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, least: int = LEAST_REVISIT) -> None:
    """Write ``path/segments`` (WARC), ``path/index`` and ``path/headers`` (Parquet).

    Null html is an empty payload; a null url an empty URI.  Of equal payloads of at least
    ``least`` bytes the largest id (nulls smallest) is the response; rows that repeat both
    id and payload are responses all, and the payload is still stored once.  Extra columns
    are ignored.  An empty table gives an archive without records.
    """
    marks = payload_marks(pages, id_col, url_col, html_col)
    heads = marks.groupBy("sha256").agg(F.max("id").alias("head"), F.count("*").alias("n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = (F.col("payload_bytes") >= least) & ~F.col("id").eqNullSafe(F.col("head"))
    records = (
        weighted_join(marks, heads, "sha256", "n", marks.count())
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("head")))
        .withColumn("http", http)
        .withColumn("header", _header(date))
        .select("id", "sha256", "record_type", "header", "http", "n")
    )
    records.write.parquet(f"{path}/headers")
    discard(marks)
    records = pages.sparkSession.read.parquet(f"{path}/headers")
    # The payload joins its record by the record's own id; repeated rows fall together there.
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    # One key, never null, for join and grouping alike: the payloads are shuffled once.
    key = lambda of, sha: F.concat_ws("|", of.cast("string"), sha).alias("key")
    bodies = pages.select(key(F.col(id_col), F.sha2(html.cast("binary"), 256)), html.alias("body"))
    responses = records.where("record_type = 'response'").select(key(F.col("id"), F.col("sha256")), "header", "http").dropDuplicates(["key"])
    stored = (
        bodies.join(responses, "key")
        .groupBy("key").agg(F.first("header").alias("header"), F.first("http").alias("http"), F.first("body").alias("body"))
        .select(F.concat("header", F.lit(END), "http", "body").alias("value"))
    )
    again = records.where("record_type = 'revisit'").select(F.concat("header", F.lit(END), "http").alias("value"))
    stored.union(again).mapInArrow(_segments(f"{path}/segments"), "segment string, records long").write.parquet(f"{path}/index")


def _segments(uri: str):
    """Writer of one task's records (text, without their closing blank lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, members, size = Folder(uri), [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            folder.write(name, members)
            out = pa.record_batch([pa.array([name]), pa.array([len(members)], pa.int64())], names=["segment", "records"])
            members.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py().encode() + END.encode()
                if members and size + len(raw) > SEGMENT:
                    yield close()
                    size = 0
                gz = zlib.compressobj(4, wbits=31)
                members.append(gz.compress(raw) + gz.flush())
                size += len(raw)
        if members:
            yield close()

    return run


def members(stream) -> Iterator[bytes]:
    """What each gzip member of the bytes holds, one at a time."""
    view, at = memoryview(stream), 0
    while at < len(view):
        gz, out = zlib.decompressobj(31), []
        while not gz.eof:
            if at >= len(view):
                raise ValueError("truncated archive")
            block = view[at : at + (1 << 20)]
            out.append(gz.decompress(block))
            at += len(block) - len(gz.unused_data)
        yield b"".join(out)


def parse(stream) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record of gzipped WARC bytes."""
    for view in members(stream):
        at = 0
        while at < len(view):
            stop = view.find(b"\r\n\r\n", at)
            if stop < 0 or view[at : at + 5] != b"WARC/":
                raise ValueError("no record where one should begin")
            header = view[at:stop]
            size = int(header.rpartition(b"\r\nContent-Length: ")[2])
            block = view[stop + 4 : stop + 4 + size]
            if len(block) != size or view[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield header, block
            at = stop + 8 + size


def _fields(header: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:] if ": " in line)


RECORD = "id string, record_type string, sha256 string, payload_digest string, payload_bytes long, refers_to string, header string"


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the segments as they were written; digests of stored payloads are verified.

    payload_bytes (and payload, if asked for) are null for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(f"{path}/segments")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for header, block in parse(folder.mapped(name)):
                    f = _fields(header)
                    body = block.partition(b"\r\n\r\n")[2]
                    size = None
                    if f["WARC-Type"] == "response":
                        sha, b32 = _digests(body)
                        if (sha, "sha1:" + b32) != (f["X-Payload-SHA256"], f["WARC-Payload-Digest"]):
                            raise ValueError(f"the payload of {f['WARC-Record-ID']} does not match its digest")
                        size = len(body)
                    row = (f.get("X-Page-ID"), f["WARC-Type"], f["X-Payload-SHA256"], f["WARC-Payload-Digest"].removeprefix("sha1:"), size, f.get("X-Refers-To-Page-ID"), header.decode())
                    rows.append((*row, body.decode() if size is not None else None) if payloads else row)
                    held += len(block) if payloads else len(header)
                    if held >= 4 << 20:
                        yield _batch(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    index = spark.read.parquet(f"{path}/index").select("segment")
    # One segment a task, where there are not too many.
    index = index.repartition(max(1, min(index.count(), 100_000)), "segment")
    return index.mapInArrow(run, RECORD + ", payload string" * payloads)


def _batch(rows, payloads: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, record_type, header, payload) of every record: headers joined to stored payloads.

    A payload of n records goes out in n / SHARE copies, and the records are dealt to them.
    """
    content = read_archive(spark, path, payloads=True).where("record_type = 'response'").select("sha256", "payload")
    content = content.groupBy("sha256").agg(F.first("payload").alias("payload"))
    headers = spark.read.parquet(f"{path}/headers").withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int"))
    sizes = headers.where("record_type = 'response'").select("sha256", "shares").distinct()
    content = content.join(sizes, "sha256").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    headers = headers.withColumn("share", F.pmod(F.xxhash64("header"), F.col("shares")).cast("int"))
    return headers.select("id", "record_type", "header", "sha256", "share").join(content, ["sha256", "share"]).drop("sha256", "share")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write an archive into the shared folder, read it back, one row per record.

    (id, payload_bytes, payload_digest, record_type, refers_to); see ``write_archive``.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    found = written(read_archive(spark, path).drop("header"), "records")
    content = found.where("record_type = 'response'").select("sha256", F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    content = content.groupBy("sha256").agg(F.max("size").alias("size"), F.max("digest").alias("digest"))
    content = content.join(spark.read.parquet(f"{path}/headers").groupBy("sha256").agg(F.count("*").alias("n")), "sha256")
    content = written(content, "content")
    # Headers say which records there were; the segments' records are what came back.
    headers = spark.read.parquet(f"{path}/headers").select(F.col("id").cast("string").alias("id"), "record_type", "sha256")
    refers = found.where("record_type = 'revisit'").select("id", "sha256", "refers_to").distinct()
    out = headers.join(refers, headers["id"].eqNullSafe(refers["id"]) & (headers["sha256"] == refers["sha256"]), "left")
    out = out.select(headers["id"], "record_type", headers["sha256"], "refers_to")
    out = weighted_join(out, content, "sha256", "n", headers.count())
    return out.select(
        F.col("id").cast(kind).alias("id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
