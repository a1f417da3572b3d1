"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the request, the response (or a revisit, if an equal payload is stored elsewhere) and
metadata. Request and metadata name the response in ``WARC-Concurrent-To``. Archives are written by Spark's text writer,
so in every store that Spark reaches, as gzip files of whole records; they are read as binary files and parsed by
``Content-Length``, so payloads may hold anything.

Null payloads are empty. Line ends in urls become blanks. A null url or page id leaves its header out. Each row is a
capture of its own, with record ids of its own, also where rows repeat or page ids are null.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegram.llm.common import written

END = "\r\n"
RECORDS_PER_FILE = 1500


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("_")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends behind it; null headers are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in headers]
    return F.concat(F.lit("WARC/1.1" + END), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit(END + END), block)


def write_captures(pages: DataFrame, path: str, min_revisit_bytes: int = 1000,
                   captured_at: str = "1970-01-01T00:00:00Z") -> None:
    """Write the captures of ``page_id, url, html``. Of equal payloads of at least ``min_revisit_bytes`` bytes that with
    the largest page id is stored, the others revisit it.

    A number in column ``row`` tells rows apart that repeat. Without one, the rows are numbered and written first: they
    are read twice, and need not come in the same order again.
    """
    numbered = pages
    if "row" not in pages.columns:
        numbered = written(pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row")), "pages")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    clean = F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]+", " ")
    pages = numbered.select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"), html.alias("html"),
                            F.col("row").cast("long").alias("row"))
    pages = pages.withColumns({"bytes": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    stored = (pages.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("first"), F.max_by("row", "page_id").alias("first_row"), F.count("*").alias("n"))
              .filter("n > 1").select("digest", "first", "first_row"))
    pages = pages.join(stored, "digest", "left")
    revisit = F.coalesce(F.col("page_id") < F.col("first"), F.lit(False)) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    page, url, day = F.col("page_id"), F.col("url"), F.lit(captured_at)
    own = (page, F.col("digest"), F.col("row"))
    response = _record_id("response", *own)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(END + END))
    common = [("WARC-Target-URI", url), ("WARC-Date", day), ("WARC-Page-ID", page)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    kinds = F.when(revisit, _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", response), *common, digest,
         ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To", _record_id("response", F.col("first"), F.col("digest"), F.col("first_row"))),
         ("Content-Type", F.lit("application/http; msgtype=response"))], http)).otherwise(_record(
             [("WARC-Type", F.lit("response")), ("WARC-Record-ID", response), *common, digest,
              ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html"))))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", *own)),
                       *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", *own)),
                        *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit(END)))
    (pages.select(F.explode(F.array(request, kinds, metadata)).alias("value")).write
     .option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; gzip members are opened."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            out.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(out)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(END)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """``record_id, type, concurrent_to, refers_to, uri, page_id, payload_bytes, payload_digest, payload`` of all records.

    A response's size and digest are those of the payload that was read; a revisit's are those that it states.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()),
                        ("refers_to", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, size, digest, payload = headers.get("warc-type"), len(block), None, block
        if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
            head, _, payload = block.partition(b"\r\n\r\n")
            fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
            size = len(payload)
            if kind == "revisit":
                size = int(fields.get(b"content-length", size))
                digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind != "revisit":
            digest = hashlib.sha1(payload).hexdigest()
        page = headers.get("warc-page-id")
        return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                headers.get("warc-target-uri"), None if page is None else int(page), size, digest,
                payload if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [row(h, b) for h, b in parse(data.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "record_id string, type string, concurrent_to string, refers_to string, uri string, page_id long, "
             "payload_bytes long, payload_digest string, payload binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, response, requests, metadata``.

    Requests and metadata are joined to the response or revisit that they name in ``concurrent_to``, directly or by way
    of another record (as metadata that name the request). A record whose capture has no response makes a row without
    one, under the id that it names, or its own id if it names none.
    """
    main = records.filter(F.col("type").isin("response", "revisit"))
    rest = records.filter(~F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False)))
    hop = (rest.filter("record_id IS NOT NULL AND concurrent_to IS NOT NULL").groupBy("record_id")
           .agg(F.min("concurrent_to").alias("next")).withColumnRenamed("record_id", "concurrent_to"))
    body = F.struct("record_id", "type", "uri", "page_id", "payload_bytes", "payload_digest", "payload")
    rest = (rest.join(hop, "concurrent_to", "left")
            .select(F.coalesce("next", "concurrent_to", "record_id").alias("capture_id"), "type", body.alias("record")))
    rest = rest.groupBy("capture_id").agg(
        F.collect_list(F.when(F.col("type") == "request", F.col("record"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.col("record"))).alias("metadata"))
    whole = F.struct("record_id", "type", "uri", "page_id", "payload_bytes", "payload_digest", "payload", "refers_to")
    main = main.select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    return main.join(rest, "capture_id", "full")


def whole_captures(captures: DataFrame) -> DataFrame:
    """``captures``, which must be as ``write_captures`` makes them: a response or revisit with one request and one
    metadata record of the same page. Any other capture fails the query."""
    request, metadata = F.get("requests", F.lit(0)), F.get("metadata", F.lit(0))
    page = F.col("response.page_id")
    whole = (F.col("response").isNotNull() & (F.size("requests") == 1) & (F.size("metadata") == 1)
             & page.eqNullSafe(request["page_id"]) & page.eqNullSafe(metadata["page_id"]))
    return captures.withColumn("response", F.when(whole, F.col("response")).otherwise(F.raise_error(F.concat(
        F.lit("capture without its request, response and metadata: "), F.coalesce("capture_id", F.lit("no id"))))))


def capture_digests(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` (a page id) of each capture with a response."""
    rows = captures.filter("response IS NOT NULL").select("response.*")
    stored = (rows.filter("type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("stored"))
              .withColumnRenamed("record_id", "refers_to"))
    return rows.join(stored, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("stored").alias("refers_to"))
