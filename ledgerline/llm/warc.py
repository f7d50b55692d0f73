"""WARC archives: written and read by Spark, captures assembled from their records.

Each page becomes three records: a request, a response or (where an earlier page has the same payload of at least
``LEAST`` bytes) a revisit, and metadata. Request and metadata name the response or revisit in WARC-Concurrent-To.
Archives are written by Spark's own text writer, whose line separator is the end mark of WARC records, so they go to
any store that Spark can write, under its commit protocol, and they are gzip-compressed. They are read again as whole
files, which a writer's partition keeps small, and parsed as a stream by Content-Length. Reading joins the three
records of a capture through their identifiers into one nested row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, partitions_for, scratch, table

#: Payloads from this size on are deduplicated; the format's line and record ends.
LEAST = 100
EOL, END = "\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _record_id(kind: str, page: Column, digest: Column, copy: Column) -> Column:
    """A stable identifier: the record's kind, and the page's key, digest and number among equals, hashed."""
    h = F.md5(F.concat_ws(":", F.lit(kind), page, digest, copy.cast("string")).cast("binary"))
    groups = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), groups, F.lit(">"))


def _record(kind: Column, record_id: Column, content_type: str, block: Column, more: list[Column]) -> Column:
    headers = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.col("uri")), *more, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *headers), F.lit(END), block)


def archive(pages: DataFrame, path: str, file_bytes: int = 32 << 20) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files of about ``file_bytes`` payload bytes each.

    Of pages with equal payloads of ``LEAST`` bytes or more, that with the smallest page_id is the response; among rows
    that repeat it, one is. Null payloads are empty; a null url is written as ``urn:unknown``, and line ends in a url
    as spaces. A null page_id comes after all others and its records name no page; rows without one are told apart by
    payload and number. Keys are written URL-encoded, so any text may be one. Other columns stay behind. An empty table
    writes no records.

    The verdicts come from narrow rows of key, digest and size, written to the shared folder, so that payloads are
    shuffled once, by key and digest, and never meet by digest, however many pages share one.
    """
    page = F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit("null"))
    html = F.coalesce("html", F.lit(""))
    narrow = checkpoint(pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes")))
    parts = partitions_for(narrow.agg(F.sum(F.col("bytes") + 1024)).first()[0], file_bytes)
    long = narrow.where(F.col("bytes") >= LEAST).select(page.alias("__page"), "page_id", F.col("digest").alias("__digest"))
    first = F.coalesce(F.concat(F.lit("="), F.min("page_id").cast("string")), F.lit("null"))
    shared = checkpoint(long.groupBy("__digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))  # so that AQE can split a digest that most pages have
    repeated = not shared.isEmpty()
    shared = long.join(shared, "__digest").select("__page", "__digest", "first").distinct().repartition(parts, "__page", "__digest")

    rows = pages.select(page.alias("page"), F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), "[\\r\\n]", " ").alias("uri"), html.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = rows.repartition(parts, "page", "digest")
    if repeated:
        rows = rows.join(shared.hint("shuffle_hash"), (F.col("page") == F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    else:  # a join with nothing would be planned anew after the payloads were shuffled, and shuffle them again
        rows = rows.withColumn("first", F.lit(None).cast("string"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page", "digest").orderBy("uri")))
    again = F.col("first").isNotNull() & ((F.col("page") != F.col("first")) | (F.col("copy") > 1))
    rows = rows.withColumn("kind", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
    own = (F.col("page"), F.col("digest"), F.col("copy"))
    rows = rows.withColumn("main", _record_id("capture", *own)).withColumn("source", F.when(again, _record_id("capture", F.col("first"), F.col("digest"), F.lit(1))))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{END}"), F.when(again, F.lit("")).otherwise(F.col("html")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    refers = F.concat(F.lit("WARC-Refers-To: "), F.col("source"), F.lit(f"{EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), F.col("main"))
    host = F.coalesce(F.nullif(F.regexp_extract("uri", "^[a-z]+://([^/]+)", 1), F.lit("")), F.lit("unknown"))
    request = F.concat(F.lit(f"GET / HTTP/1.1{EOL}Host: "), host, F.lit(END))
    named = F.when(F.col("page") != "null", F.concat(F.lit("page: "), F.url_encode(F.substring("page", 2, 1 << 30)), F.lit(EOL))).otherwise(F.lit(""))
    fields = F.concat(named, F.lit("payload-length: "), F.octet_length("html").cast("string"), F.lit(EOL))
    records = F.array(
        _record(F.lit("request"), _record_id("request", *own), "application/http; msgtype=request", request, [beside]),
        _record(F.col("kind"), F.col("main"), "application/http; msgtype=response", http, [digest, refers]),
        _record(F.lit("metadata"), _record_id("metadata", *own), "application/warc-fields", fields, [beside]),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(data: bytes, window: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, names in lower case; block) of each record of a gzip-compressed archive, one or many members, unpacked as it is read."""
    held, rest = bytearray(), data

    def more() -> bool:
        nonlocal rest, unpack
        while rest:
            made = unpack.decompress(rest, window)
            rest = unpack.unconsumed_tail
            if unpack.eof:
                rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            if made:
                held.extend(made)
                return True
        return False

    unpack = zlib.decompressobj(31)
    end, sep = END.encode(), EOL.encode()
    while True:
        while (at := held.find(end)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = bytes(held[:at]).lstrip().decode("utf-8", "surrogateescape").split(EOL)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, start = int(headers["content-length"]), at + len(end)
        while len(held) < start + size:
            if not more():
                raise ValueError("the archive ends inside a record's block")
        yield headers, bytes(held[start : start + size])
        del held[: start + size]
        while held[:2] == sep or (len(held) < 2 and more()):
            if held[:2] == sep:
                del held[:2]


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``: identifiers, type, uri, and what its block holds.

    ``payload_bytes`` and ``payload_digest`` are counted from the payload of a response as read, ``intact`` says whether
    the digest is the announced one; ``fields`` are a metadata record's. With ``payloads`` the response's payload and
    the request's block come along.
    """
    schema = "record_id string, type string, uri string, concurrent_to string, refers_to string, announced string, payload_bytes long, payload_digest string, intact boolean, fields map<string, string>, request string, payload binary"
    names = [x.strip().split(" ")[0] for x in schema.replace("map<string, string>", "map").split(",")]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        def told(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(content.as_py()):
                    kind = headers.get("warc-type")
                    announced = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    n = digest = intact = fields = request = payload = None
                    if kind == "response":
                        payload = block.partition(END.encode())[2]
                        n, digest = len(payload), sha256(payload).hexdigest()
                        intact = announced is None or announced == digest
                    elif kind == "metadata":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(EOL) if x)]
                    elif kind == "request":
                        request = block.decode("utf-8", "replace")
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), announced, n, digest, intact, fields, request if payloads else None, payload if payloads else None))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 20_000:
                        yield told(rows)
                        rows, size = [], 0
                if rows:
                    yield told(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row for each capture: ``capture_id``, ``request``, ``response`` (or revisit) and ``metadata``.

    The three meet through their identifiers: a response's own, or the one that request and metadata name as concurrent.
    One shuffle joins them; what a capture lacks is null. Archives without records give no rows.
    """
    rows = records(spark, path, payloads).withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    main = F.col("type").isin("response", "revisit")
    parts = {
        "request": (F.col("type") == "request", ["record_id", "uri", "request"]),
        "response": (main, ["record_id", "type", "uri", "refers_to", "announced", "payload_bytes", "payload_digest", "intact", "payload"]),
        "metadata": (F.col("type") == "metadata", ["record_id", "fields"]),
    }
    return rows.groupBy("capture_id").agg(*(F.first(F.when(own, F.struct(*columns)), ignorenulls=True).alias(name) for name, (own, columns) in parts.items()))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC archives, reads them back and assembles the captures; digests as read."""
    path = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    archive(pages, path)
    kind = pages.schema["page_id"].dataType
    found = checkpoint(captures(spark, path, payloads=False).select("capture_id", F.url_decode(F.col("metadata.fields")["page"]).cast(kind).alias("page_id"), F.col("metadata.fields")["payload-length"].cast("long").alias("told_bytes"), "response.*"))
    discard(spark, path)
    sources = found.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("source"))
    named = found.join(sources, "refers_to", "left")
    return named.select(
        "page_id", F.coalesce("payload_bytes", "told_bytes").alias("payload_bytes"),
        F.when(F.coalesce("intact", F.lit(True)), F.coalesce("payload_digest", "announced")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "record_id")).cast("string")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("source").alias("refers_to"),
    )


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
}
