"""WARC archives: writing captures with duplicate payloads as revisits, reading, and putting transactions together.

A capture is a response (or a revisit of an earlier response with the same payload) with its request and
its metadata, which name it as concurrent. Payloads below ``LEAST`` bytes are always stored.

Cases: a null payload is an empty one; a null id takes part like any other, but is the last choice as response
of its payload; a null address leaves the header out; line breaks in an address are written as %0D and %0A. Rows that
repeat both id and payload are one capture archived again: each comes back, with the same type.
An empty table gives an archive without records.

Archives are gzip files, so a task reads one file from start to end, one record at a time, by its declared length;
a payload may hold anything, whole records of an archive included.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
# Rows of a file at most; each capture has three.
ROWS_PER_FILE = 300_000

# Fixed values of the format.
BREAK = "\r\n"
END = "\r\n\r\n"
MARK = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "kind string, record_id string, concurrent_to string, refers_to string, address string, date string, "
    "payload_digest string, http_head string, payload binary, whole boolean"
)
HEADERS = {
    b"warc-type": "kind",
    b"warc-record-id": "record_id",
    b"warc-concurrent-to": "concurrent_to",
    b"warc-refers-to": "refers_to",
    b"warc-target-uri": "address",
    b"warc-date": "date",
    b"warc-payload-digest": "payload_digest",
}


def _urn(kind: str, key: Column, digest: Column) -> Column:
    """A record id that depends on the capture and the kind of record only."""
    hexed = F.md5(F.concat_ws("/", F.lit(kind), F.coalesce(key.cast("string"), F.lit("null")), digest))
    cuts = [F.substring(hexed, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str | Column, urn: Column, headers: list[Column], content: str, block: Column, date: str) -> Column:
    """One record without the break behind it."""
    head = [
        F.lit(MARK + "1"),
        F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
        F.concat(F.lit("WARC-Record-ID: "), urn),
        F.lit(f"WARC-Date: {date}"),
        *headers,
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(BREAK, *head), F.lit(END), block)


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", address: str = "url", payload: str = "html", least: int = LEAST, date: str = DATE
) -> None:
    """Write one capture per row.

    The smallest id of each payload is combined inside the map tasks; the rows meet it in one join, in which a
    payload that many rows share is split like any hot key.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(address).alias("address"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("n_bytes", F.octet_length("body"))
    firsts = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first_id"))
    rows = rows.join(firsts.withColumnRenamed("digest", "same"), F.col("digest") == F.col("same"), "left")
    again = F.col("same").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))

    uri = F.replace(F.replace(F.col("address"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    own = _urn("response", F.col("id"), F.col("digest"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), own)
    sha = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    first = F.concat(F.lit("WARC-Refers-To: "), _urn("response", F.col("first_id"), F.col("digest")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(END),
    )
    main = _record(
        F.when(again, "revisit").otherwise("response"),
        own,
        [target, sha, F.when(again, first), F.when(again, F.lit(f"WARC-Profile: {PROFILE}"))],
        "application/http; msgtype=response",
        F.when(again, http).otherwise(F.concat(http, F.col("body"))),
        date,
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}"))
    request = _record(
        "request", _urn("request", F.col("id"), F.col("digest")), [target, beside], "application/http; msgtype=request", asked, date
    )
    named = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(BREAK)), F.lit(""))
    metadata = _record(
        "metadata", _urn("metadata", F.col("id"), F.col("digest")), [target, beside], "application/warc-fields", named, date
    )
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": ROWS_PER_FILE}
    records.write.options(**options).mode("errorifexists").text(path)


def _parsed(head: bytes, block: bytes, whole: bool) -> dict:
    row: dict = dict.fromkeys(HEADERS.values())
    content = b""
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        name, value = name.strip().lower(), value.strip()
        if name in HEADERS:
            row[HEADERS[name]] = value.decode("utf-8", "replace")
        elif name == b"content-type":
            content = value
    http, payload = b"", block
    if content.startswith(b"application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    return row | {"http_head": http.decode("utf-8", "replace"), "payload": payload, "whole": whole}


LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)", re.IGNORECASE)
# Bytes of records that a task passes on at a time.
BATCH_BYTES = 4 << 20


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of all ``.gz`` archives below a folder. ``whole`` is false for a record that its file cuts off.

    The reader cuts files at the version mark of a record. A mark inside a record's block is put back: a record
    goes on until it has its declared length.
    """
    schema = pa.schema(
        [(n, pa.binary() if k == "binary" else pa.bool_() if k == "boolean" else pa.string()) for n, k in (x.split() for x in RECORD.split(", "))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held, size, file = 0, 0, None
        pieces: list[bytes] = []

        def close() -> None:
            """The record that ``pieces`` hold, complete or cut off by the end of its file."""
            nonlocal size
            if not pieces:
                return
            text = MARK.encode().join(pieces)
            head, _, block = text.partition(b"\r\n\r\n")
            n = LENGTH.search(head)
            n = int(n[1]) if n else 0
            rows.append(_parsed(head, block[:n], len(block) >= n))
            size += len(text)
            pieces.clear()

        need = 0
        for batch in batches:
            for name, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if name != file:
                    close()
                    file, need = name, None
                    # What lies before the first mark is no record.
                    if not piece:
                        continue
                if need is None or not pieces:
                    at = piece.find(b"\r\n\r\n")
                    n = LENGTH.search(piece[: max(at, 0)])
                    need = at + 4 + int(n[1]) if n else 0
                    held = len(piece)
                else:
                    held += len(MARK) + len(piece)
                pieces.append(piece)
                if held >= need:
                    close()
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    lines = spark.read.option("lineSep", MARK).option("pathGlobFilter", "*.gz").schema("value string").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its ``response`` or ``revisit``, with ``request`` and ``metadata`` beside it.

    Revisits also get what they refer to: id of the page, and the digest and length of the payload. Records join by
    their ids; a response that many revisits name is split like any hot key.
    """

    def beside(kind: str) -> DataFrame:
        found = records.where(F.col("kind") == kind)
        body = F.min(F.struct("record_id", "http_head", F.col("payload").cast("string").alias("body")))
        return found.groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(body.alias(kind))

    main = records.where(F.col("kind").isin("response", "revisit"))
    declared = F.regexp_extract("http_head", r"(?i)content-length:\s*(\d+)", 1).cast("long")
    stored = F.col("kind") == "response"
    main = main.withColumn("payload_bytes", F.when(stored, F.length("payload").cast("long")).otherwise(declared)).withColumn(
        "payload_sha256", F.when(stored, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
    )
    for kind in ("request", "metadata"):
        main = main.join(beside(kind), F.col("record_id") == F.col(f"{kind}_of"), "left").drop(f"{kind}_of")
    page = F.regexp_extract("metadata.body", r"page-id: (-?\d+)", 1)
    main = main.withColumn("page_id", F.when(page != "", page).cast("long"))
    answers = main.where(stored).groupBy(F.col("record_id").alias("answer")).agg(F.min("page_id").alias("answer_page"))
    main = main.join(answers, F.col("refers_to") == F.col("answer"), "left")
    body = F.struct("record_id", "date", "http_head", "payload", "payload_bytes", "payload_sha256", "refers_to")
    return main.select("page_id", "kind", "address", body.alias("main"), "request", "metadata", "answer_page")
