"""WARC archives with revisit records for payloads that an earlier record holds."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_folder, stash

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_SHARED = 100
RECORDS_PER_FILE = 2_000


def record_id(page: Column, digest: Column, copy: Column) -> Column:
    """A stable ``urn:uuid`` of page, payload and the number of the row among those that share both."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line, or null if there is no value; line breaks in it are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), safe)


def resolve(pages: DataFrame, smallest: int = SMALLEST_SHARED) -> DataFrame:
    """Add payload_digest, payload_bytes, record_type, refers_to, named (whether one record alone holds the response) and copy to (page_id, url, html).

    Only headers are shuffled by digest: the smallest page_id of each digest comes from an aggregation of (digest, page_id), combined before
    the shuffle, and what is joined back to the pages, by page_id and digest, are the revisits and the rows that repeat a page_id, without
    payloads. Payloads under ``smallest`` bytes are all responses, never enter the join by digest, and so are all records of the smallest
    page_id. copy tells apart rows of one page_id and payload, and rows without a page_id; it is 0 for all others.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sized = pages.select("*", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    heads = stash(sized.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count("*").alias("n")))
    large = heads.where((F.col("payload_bytes") >= smallest) & F.col("page_id").isNotNull())
    shared = large.groupBy("payload_digest").agg(F.min(F.struct("page_id", "n")).alias("f"), F.count("*").alias("pages")).where("pages > 1")
    again = large.join(shared, "payload_digest").where(F.col("page_id") > F.col("f.page_id"))
    again = again.select("page_id", "payload_digest", F.col("f.page_id").alias("first"), (F.col("f.n") == 1).alias("named"))
    repeated = heads.where((F.col("n") > 1) | F.col("page_id").isNull()).select("page_id", "payload_digest").withColumn("repeated", F.lit(True))
    notes = again.join(repeated, ["page_id", "payload_digest"], "full").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "first", "named", "repeated")
    # Rows without a page_id are only ever numbered, never joined.
    marked = sized.join(notes.where("_page is not null"), (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    number = F.when(F.coalesce("repeated", F.col("page_id").isNull()), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0))
    later = F.col("first").isNotNull()
    return marked.select(*sized.columns, F.when(later, "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"), "named", number.alias("copy"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", smallest: int = SMALLEST_SHARED) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as WARC 1.1 files below ``path``, each file one gzip member.

    Spark's text writer commits the files, with the two line breaks that end a record as its line separator, so a lost executor leaves no
    half archives. Revisit records have no block; they name the response that holds their payload, its digest and length.
    """
    r = resolve(pages, smallest)
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"), F.col("copy"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, header("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit & F.col("named"), header("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"), F.lit(0)))),
        header("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, header("X-Refers-To-Page", F.col("refers_to").cast("string"))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(block).cast("string")),
    )
    lines = r.select(F.concat(head, F.lit(CRLF * 2), block).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive, by Content-Length; one record is held at a time."""
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        headers = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("archive ends inside a record")
            name, value = line[:-2].decode("utf-8").split(": ", 1)
            headers[name] = value
        yield headers, archive.read(int(headers["Content-Length"]))
        archive.read(4)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``: page_id, url, record_type, refers_to, record_id, block_bytes, block_digest, payload_digest, payload_length and, if wanted, payload.

    block_bytes and block_digest are those of the block as read; payload_digest and payload_length are what the headers state.
    """
    schema = "page_id long, url string, record_type string, refers_to long, record_id string, block_bytes long, block_digest string, payload_digest string, payload_length long" + ", payload binary" * payload

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if x is None else int(x)
        for b in batches:
            for content in b["content"]:
                rows = []
                for h, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    row = (
                        whole(h.get("X-Page-Id")), h.get("WARC-Target-URI"), h["WARC-Type"], whole(h.get("X-Refers-To-Page")), h["WARC-Record-ID"], len(block),
                        hashlib.sha256(block).hexdigest(), h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"]),
                    )
                    rows.append((*row, block) if payload else row)
                out = pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(each, schema)


def archive(pages: DataFrame, path: str | None = None, smallest: int = SMALLEST_SHARED) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives and read them back: one row (page_id, payload_bytes, payload_digest, record_type, refers_to) per row.

    Digest and length of a response are taken from the block that was read; those of a revisit from the response it refers to, which it is
    joined with by page_id and digest. A null html is an empty payload; a null page_id is always a response. Repeated rows are archived
    each. Other columns are ignored; an empty table gives an empty one. ``path`` is a new folder, by default in the shared one.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), path, smallest=smallest)
    records = stash(read_archives(spark, path))
    responses = records.where("record_type = 'response'").select("page_id", F.col("block_bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest"), "record_type", "refers_to")
    originals = responses.where(F.col("payload_bytes") >= smallest).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = records.where("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")))
    resolved = revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(resolved)
