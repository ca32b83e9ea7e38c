r"""WARC archives: writing page captures, reading them back and assembling transactions.

Each page becomes three records that share a capture: request, response (or revisit) and metadata; request and
metadata name the response in WARC-Concurrent-To. A reader splits archives into records by Content-Length, and
assembly joins the records of a capture through those identifiers into one nested row.

Which page revisits which is decided on ids and digests alone; pages then move once, to meet their verdict, and Spark's
own text sink writes them where they stand (records end in CRLF CRLF, the sink's line separator), so any store that
Spark can write will do. Every file begins with a warcinfo record and holds about FILE_BYTES of payload.

Null html: an empty payload. Null page_id: written without an id and read back as null; it never becomes the record
that others revisit unless no other id has the payload, and then all of them are responses. Repeated rows: a capture
each. Ties for the smallest page_id: all rows of that id are responses. Very long pages: a record each, read one at a
time. Empty table: empty archive, empty result. Extra columns are ignored. Damaged archives: a capture whose payload
isn't the stated one has intact = false, one that lacks a record has complete = false; none is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, drop_stored, scratch_path, stored

CRLF = "\r\n"
#: A payload this long or longer may be revisited.
REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, page_id long, block_bytes long, payload_bytes long, payload_digest string, stated_digest string, payload binary"


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a null value leaves its line out."""
    parts = [F.when(v.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))) if isinstance(v, Column) else F.lit(f"{k}: {v}{CRLF}") for k, v in pairs]
    return F.concat(*parts)


def _record(header: Column, block: Column) -> Column:
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), header, _lines(("Content-Length", F.octet_length(block).cast("string"))), F.lit(CRLF), block)


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, pid (never null), url, html, digest, bytes."""
    html, page_id = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("page_id").cast("long")
    return pages.select(page_id.alias("page_id"), F.coalesce(page_id, F.lit(NULL_ID)).alias("pid"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))


def verdicts(pages: DataFrame) -> DataFrame:
    """pid, digest, bytes, alike (rows with both), refers_to (null for responses), refers_alike (rows it may mean). No html."""
    captures = stored(_rows(pages).groupBy("pid", "digest").agg(F.count("*").alias("alike"), F.max("bytes").alias("bytes")), "captures")
    known = F.when(F.col("pid") != NULL_ID, F.struct("pid", "alike"))  # min leaves nulls out
    first = captures.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("ids")).filter("ids > 1").select("digest", "first")
    # short payloads are their own digests' only rows or responses all the same
    joined = captures.join(first.hint("shuffle_hash"), "digest", "left")
    revisits = F.col("first.pid").isNotNull() & (F.col("pid") != F.col("first.pid"))
    return joined.select("pid", "digest", "bytes", "alike", F.when(revisits, F.col("first.pid")).alias("refers_to"), F.when(revisits, F.col("first.alike")).alias("refers_alike"))


def _urn(page: Column, digest: Column) -> Column:
    """A record's identifier from page and payload, so that a revisit can name the response without looking it up."""
    h = F.sha2(F.concat_ws(":", page.cast("string"), digest), 256)
    return F.concat_ws("-", *(F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def write_warc(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Writes path/*.txt.gz: WARC/1.1 records, one gzip stream a file. date: when pages were captured; now, if unknown."""
    verdict = stored(verdicts(pages), "verdicts")
    mean = verdict.agg(F.sum(F.col("bytes") * F.col("alike")) / F.sum("alike")).first()[0] or 0.0
    per_file = max(1, int(FILE_BYTES / (mean + 1024)))  # a capture's headers take about a kilobyte
    rows = _rows(pages).drop("bytes").join(verdict.hint("shuffle_hash"), ["pid", "digest"])
    # rows that share id and payload are told apart by a random identifier, drawn once and used in all three records
    rows = rows.withColumn("uid", F.when(F.col("alike") == 1, _urn(F.col("pid"), F.col("digest"))).otherwise(F.expr("uuid()")))
    rows = rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % per_file)
    stamp = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = lambda uid, suffix="": F.concat(F.lit("<urn:uuid:"), uid, F.lit(f"{suffix}>"))
    urn = lambda suffix="": named(F.col("uid"), suffix)
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("about:blank"))
    page = F.col("page_id").cast("string")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes").cast("string"))), F.lit(CRLF))
    response = _record(
        F.concat(
            _lines(
                ("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
                ("WARC-Record-ID", urn()),
                ("WARC-Date", stamp),
                ("WARC-Target-URI", uri),
                ("WARC-Page-ID", page),
                ("WARC-Payload-Digest", digest),
                ("WARC-Refers-To", F.when(F.col("refers_alike") == 1, named(_urn(F.col("refers_to"), F.col("digest"))))),
                ("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            ),
            F.when(is_revisit, F.lit(f"WARC-Profile: {IDENTICAL}{CRLF}")).otherwise(F.lit("")),
            _lines(("Content-Type", "application/http; msgtype=response")),
        ),
        F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html"))),
    )
    beside = lambda kind, suffix: (("WARC-Type", kind), ("WARC-Record-ID", urn(suffix)), ("WARC-Date", stamp), ("WARC-Concurrent-To", urn()), ("WARC-Target-URI", uri))
    request = _record(_lines(*beside("request", "-q"), ("Content-Type", "application/http; msgtype=request")), F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    metadata = _record(_lines(*beside("metadata", "-m"), ("Content-Type", "application/warc-fields")), _lines(("payloadBytes", F.col("bytes").cast("string"))))
    about = _record(_lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn("-i")), ("WARC-Date", stamp), ("Content-Type", "application/warc-fields")), F.lit(f"format: WARC File Format 1.1{CRLF}"))
    texts = rows.select(F.concat_ws(CRLF * 2, F.when(F.col("at") == 0, about), request, response, metadata).alias("value"))
    texts.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    drop_stored(verdict)


def _header(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block.split(b"\r\n"))}


def split_records(data: BinaryIO) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header and block of each record, by Content-Length; text that looks like a record inside a payload is payload."""
    head: list[bytes] = []
    while line := data.readline():
        if line != b"\r\n":
            head.append(line)
        elif head:
            header = _header(b"".join(head))
            yield header, data.read(int(header[b"content-length"]))
            head = []


def _parsed(header: dict[bytes, bytes], block: bytes, payloads: bool) -> dict:
    text = lambda k: header[k].decode("utf-8", "replace") if k in header else None
    number = lambda k: int(header[k]) if k in header else None
    kind, payload, declared = text(b"warc-type"), block, None
    if header.get(b"content-type", b"").startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        declared = _header(head).get(b"content-length")
    revisit = kind == "revisit"
    return {
        "record_id": text(b"warc-record-id"),
        "record_type": kind,
        "concurrent_to": text(b"warc-concurrent-to"),
        "refers_to": text(b"warc-refers-to-page-id"),
        "target_uri": text(b"warc-target-uri"),
        "page_id": number(b"warc-page-id"),
        "block_bytes": len(block),
        "payload_bytes": int(declared or 0) if revisit else len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else None,
        "stated_digest": (text(b"warc-payload-digest") or "").removeprefix("sha256:") or None,
        "payload": payload if payloads else None,
    }


_RECORD = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record; payload is null unless asked for. HTTP blocks are cut into headers and payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content.as_py())) as data:
                    for header, block in split_records(data):
                        rows.append(_parsed(header, block, payloads))
                        held += len(block) if payloads else 1024
                        if held > FILE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (or revisit) and metadata joined through WARC-Concurrent-To.

    complete: all three are there. intact: the response's payload has the digest that was stated; a revisit has none to compare.
    """
    part = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    pick = lambda *kinds: F.first(F.when(F.col("record_type").isin(*kinds), part), ignorenulls=True)
    captures = (
        records.filter(F.col("record_type") != "warcinfo")
        .withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture_id")
        .agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))
    )
    r = F.col("response")
    return captures.select(
        "*",
        (F.col("request").isNotNull() & r.isNotNull() & F.col("metadata").isNotNull()).alias("complete"),
        F.coalesce(r["stated_digest"].isNotNull() & (F.coalesce(r["payload_digest"], r["stated_digest"]) == r["stated_digest"]), F.lit(False)).alias("intact"),
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archive of all pages into the shared folder, reads it back, assembles captures: the contract's rows."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    captures = assemble(read_warc(spark, path).drop("payload"))
    r = F.col("response")
    return captures.select(
        r["page_id"].alias("page_id"),
        r["payload_bytes"].alias("payload_bytes"),
        F.coalesce(r["payload_digest"], r["stated_digest"]).alias("payload_digest"),
        r["record_type"].alias("record_type"),
        r["refers_to"].cast("long").alias("refers_to"),
        "complete",
        "intact",
    )
