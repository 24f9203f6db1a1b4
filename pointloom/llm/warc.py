"""WARC archives: written with Spark's text writer, read back along a verified chain of records."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, new_path, store

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
LEAST_REVISIT_BYTES = 100
FIELD = re.compile(rb"[!-9;-~]+:")


def _digest(html: Column) -> Column:
    return F.sha2(html.cast("binary"), 256)


def find_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat a payload of at least least_bytes."""
    d = pages.where(F.octet_length("_payload") >= least_bytes).select("page_id", _digest(F.col("_payload")).alias("digest"))
    first = d.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Writes one WARC/1.0 record per row of pages(page_id, url, html) under path.

    Of rows with equal payloads of at least least_bytes the smallest page_id is a response and the
    others revisit it; rows that share that smallest page_id are all responses. A null html is an
    empty payload, a null url has no target field, a null page_id is always a response. Payloads and urls
    may have any length. Control
    characters in a url are percent-encoded. Other columns are ignored. Records end with the text
    writer's line separator, so Spark's commit protocol covers the archives on any file system."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_payload"))
    revisits = store(find_revisits(pages, least_bytes), "revisits")  # read back, its size is known and small ones are broadcast
    rows = pages.withColumn("digest", _digest(F.col("_payload"))).join(revisits, ["page_id", "digest"], "left")
    again, size = F.col("refers_to").isNotNull(), F.octet_length("_payload")
    url = F.col("url")
    for c in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}")) if c else url
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(again, F.lit("")).otherwise(F.concat(http, F.col("_payload")))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", urn(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Payload-Length", size.cast("string")),
        F.when(again, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(again, field("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(F.col("_block")).cast("string")),
        F.lit("\r\n"),
        F.col("_block"),
    )
    rows.withColumn("_block", block).select(record.alias("value")).write.option("lineSep", END.decode()).text(path)
    drop_stored(revisits)


# Reading ------------------------------------------------------------------------------------------


class _Ranges:
    """Bytes of one file by position, read in blocks through any file system that pyarrow knows."""

    def __init__(self, uri: str, block: int):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
        self.file, self.block = files.open_input_file(path), block
        self.size, self.at, self.held = self.file.size(), 0, b""

    def get(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start < self.at or end > self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(max(end - start, min(self.block, self.size - start)), start)
        return self.held[start - self.at : end - self.at]

    def header(self, at: int) -> tuple[dict[str, str], int] | None:
        """The fields of a record that begins at `at` and where its block begins; None if it is none."""
        size = 4096
        while True:
            data = self.get(at, at + size)
            if not data.startswith(MAGIC):
                return None
            if (stop := data.find(END)) >= 0:
                break
            # a header may be of any length; what is none, as magic inside a payload, shows in its lines
            if len(data) < size or not all(map(FIELD.match, data[len(MAGIC) :].split(b"\r\n")[:-1])):
                return None
            size *= 4
        fields = {}
        for line in data[len(MAGIC) : stop].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if not colon:
                return None
            fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        return (fields, at + stop + len(END)) if fields.get("content-length", "").isdecimal() else None

    def next(self, at: int) -> int | None:
        """Where the record after the one at `at` begins, if `at` holds a whole record."""
        if (found := self.header(at)) is None:
            return None
        to = found[1] + int(found[0]["content-length"]) + len(END)
        return to if to <= self.size else None


def _splits(spark: SparkSession, path: str, chunk: int) -> tuple[DataFrame, int]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum(F.ceil(F.col("length") / chunk))).first()[0] or 0
    return files, int(total)


def find_candidates(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """(path, size, off, to) for each place that looks like a record: a task takes one byte range,
    finds every magic, also those inside payloads, and follows successors inside its range, so `to`
    is the first successor beyond the range (the file's size at its end)."""
    files, total = _splits(spark, path, chunk)
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("begin"))

    def scan(batches):
        for batch in batches:
            for uri, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist()):
                r = _Ranges(uri, chunk + (1 << 16))
                end = min(begin + chunk, r.size)
                data = r.get(begin, end + len(MAGIC) - 1)
                places = [m.start() + begin for m in re.finditer(re.escape(MAGIC), data)]
                to: dict[int, int | None] = {}
                for at in reversed(places):
                    n = r.next(at)
                    to[at] = n if n is None or n >= end else to.get(n)
                rows = [(at, to[at]) for at in places if to[at] is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(rows), pa.string()), pa.array([r.size] * len(rows), pa.int64()), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())],
                    names=["path", "size", "off", "to"],
                )

    return splits.repartition(max(1, min(total, 20_000)), "path", "begin").mapInArrow(scan, "path string, size long, off long, to long")


def chain_entries(candidates: DataFrame, chunk: int, files: int) -> DataFrame:
    """(path, off): the records that the chain from a file's start enters a byte range by. Pointer
    jumping: each round doubles the ranges that a pointer passes, and adds what the reached records'
    pointers reach. Raises ValueError if
    the chain of one of the `files` archives ends before its file does."""
    links = store(candidates, "warc-links")
    spans = links.agg(F.max(F.ceil(F.col("size") / chunk))).first()[0] or 0
    jump, reached = links.select("path", "off", "to"), links.where("off = 0").select("path", "off")
    span = 1
    while span < spans:
        ahead = reached.join(jump, ["path", "off"]).select("path", F.col("to").alias("off"))
        reached = store(reached.union(ahead).distinct(), "warc-reached")
        beyond = jump.select("path", F.col("off").alias("to"), F.col("to").alias("further"))
        jump = store(jump.join(beyond, ["path", "to"]).select("path", "off", F.col("further").alias("to")), "warc-jump")
        span *= 2
    ends = reached.join(links, ["path", "off"]).where("to = size").select("path").distinct().count()
    if ends < files:
        raise ValueError(f"{files - ends} archives break off inside a record")
    return reached.join(links.select("path", "off"), ["path", "off"], "left_semi")


RECORDS = "path string, offset long, record_type string, page_id long, refers_to long, uri string, payload_digest string, payload_length long, payload binary"


def read_archives(spark: SparkSession, path: str, chunk: int = 4 << 20) -> DataFrame:
    """The records under path, of any size and number, read from verified chain entries only."""
    files = _splits(spark, path, chunk)[0].count()
    entries = store(chain_entries(find_candidates(spark, path, chunk), chunk, files), "warc-entries")

    def page(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def records(batches):
        for batch in batches:
            for uri, at in zip(batch.column("path").to_pylist(), batch.column("off").to_pylist()):
                r, end, rows, held = _Ranges(uri, chunk + (1 << 16)), (at // chunk + 1) * chunk, [], 0
                while at < min(end, r.size):
                    f, begin = r.header(at)
                    to = begin + int(f["content-length"])
                    block = r.get(begin, to)
                    payload = block.partition(END)[2] if f.get("warc-type") == "response" else None
                    length = f.get("warc-payload-length", "")
                    rows.append((uri, at, f.get("warc-type"), page(f.get("warc-record-id")), page(f.get("warc-refers-to")), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:"), int(length) if length.isdecimal() else None, payload))
                    held += len(block)
                    at = to + len(END)
                    if held > 2 << 20:
                        yield out(rows)
                        rows, held = [], 0
                yield out(rows)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    total = entries.count()
    return entries.repartition(max(1, min(total, 20_000)), "path", "off").mapInArrow(records, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    r = read_archives(spark, path)
    whole = F.col("record_type") == "response"
    return r.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
