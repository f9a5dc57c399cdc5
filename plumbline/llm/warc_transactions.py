"""WARC archives of page captures, and transactions assembled from them.

Writing: each capture gives a request, a response and a metadata record; request and metadata name the response in
WARC-Concurrent-To. Of captures with equal payloads (of MIN_REVISIT bytes at least) the one with the least page id is
a response, the others are revisits of it, without the payload. Records are lines of Spark's text sink with a line end
of two CRLFs, which makes each file a WARC file (gzip as a whole).

Reading: files are parsed by their content lengths; the records' fields, without payloads unless asked for, are
written once. Transactions are joined from them on the concurrent-to ids. Requests and metadata are reduced to one
for each id before the join, so that repeated ids can't multiply rows.

One pass takes the payloads' digests, sizes and first pages; the pages are read again to be written and aren't moved,
unless the payloads that several pages share are too many to be broadcast: captures are then joined to them under SALTS
salts, since equal payloads may be a third of all. Files are cut so that they hold about FILE_BYTES of payloads.

Defined results: a null html is an empty payload, a null url an empty URI; a null page_id is never the first page of
a payload unless all are null, and then all are responses; rows that repeat the first page's id are responses too; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, table, written

MIN_REVISIT = 0
SALTS = 32
#: Files are cut at so many records, or at fewer where pages are so long that these would be more than FILE_BYTES.
RECORDS_PER_FILE, FILE_BYTES = 30_000, 64 << 20
RECORD_BYTES = 1_500  # heads of a capture's three records
BROADCAST_FIRSTS = 200_000  # shared payloads that are broadcast; beyond, captures are joined to them by a shuffle
ROWS = 2_000  # records handed to Spark at a time
#: The alphabet of base32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digits: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five digits are 20 bits, four characters."""
    out = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(hex_digits, k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _id(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("none")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two CRLFs that end it; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(2 * CRLF), block)


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, int]:
    """(page_id, url, html, digest, size, first) and the records that a file may have for FILE_BYTES on average.

    first is the least page_id of the same payload, where others share it. Texts stay where they are as long as the
    payloads that are shared are few enough to be broadcast (BROADCAST_FIRSTS rows of 28 bytes); beyond that they are
    dealt into partitions of FILE_BYTES.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    seen = rows.groupBy("sha").agg(F.min(F.when(F.col("size") >= min_revisit, F.col("page_id"))).alias("first"), F.count("*").alias("n"), F.max("size").alias("size"))
    seen = written(seen.select(F.unhex("sha").alias("digest"), "first", "n", "size"), "warc-payloads")
    total = seen.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count(F.when(F.col("n") > 1, 1)).alias("shared")).first()
    n, size = total["n"] or 0, (total["bytes"] or 0) + RECORD_BYTES * (total["n"] or 0)
    firsts = seen.filter("n > 1").select("digest", "first")
    rows = rows.withColumn("digest", F.unhex("sha")).drop("sha")
    if total["shared"] <= BROADCAST_FIRSTS:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).repartition(parts, "digest", "salt")
        joined = salted.join(firsts.repartition(parts, "digest", "salt"), ["digest", "salt"], "left")
    each = 3 * max(1, FILE_BYTES * n // size) if n else 3
    return joined.select("page_id", "url", "html", base32(F.lower(F.hex("digest"))).alias("digest"), "size", "first"), min(RECORDS_PER_FILE, each)


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, compression: str = "gzip") -> None:
    """compression is gzip, a stream for each file, or none, where records can be reached by their place in the file."""
    c, each = captures(pages, min_revisit)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page, digest, uri = F.col("page_id"), F.col("digest"), F.col("url")
    own = _id("capture", page, digest)
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE))]
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(2 * CRLF))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _id("request", page, digest)), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{2 * CRLF}")))
    response = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("Content-Type", F.lit("application/http; msgtype=response"))]
        + [("WARC-Refers-To", F.when(revisit, _id("capture", F.col("first"), digest))), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
    )
    about = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), page.cast("string")), F.when(revisit, F.concat(F.lit("refers-to-page: "), F.col("first").cast("string"))), F.lit(""))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _id("metadata", page, digest)), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))], about)
    lines = c.select(F.explode(F.array(request, response, metadata)).alias("value"))
    lines.write.option("lineSep", 2 * CRLF).option("compression", compression).option("maxRecordsPerFile", each).text(path)


FIELDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, payload_digest string, payload_bytes long, page_id long, refers_to_page long, payload binary"


def parse(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """The records of a WARC file, gzip or not, of one member or many. It is unpacked as it is read, a record at a time.

    A response's payload is counted and its digest taken anew. Records of other types come with their heads alone.
    """
    raw = io.BytesIO(data)
    file = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if data[:2] == b"\x1f\x8b" else raw
    while version := file.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        lines = []
        while (line := file.readline()) not in (b"\r\n", b""):
            lines.append(line.decode().rstrip("\r\n"))
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = file.read(int(head["content-length"]))
        if file.read(4) != b"\r\n\r\n":
            raise ValueError("a record is shorter or longer than it says")
        out = {"type": head["warc-type"], "record_id": head["warc-record-id"], "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri")}
        if out["type"] in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            out |= {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(payload), "payload": payload if with_payload else None}
            if out["type"] == "response":
                out["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                out["payload_bytes"] = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        elif out["type"] == "metadata":
            fields = dict(x.partition(": ")[::2] for x in block.decode().split(CRLF) if x)
            out |= {k: int(fields[name]) if name in fields else None for k, name in (("page_id", "page-id"), ("refers_to_page", "refers-to-page"))}
        yield out


def records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of all archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in FIELDS.split(", "))])
        for b in batches:
            for data in b.column("content"):
                found = parse(data.as_py(), with_payload)
                while some := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, FIELDS)


def transactions(recs: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, uri, response, request, metadata and how many of the latter two."""

    def side(kind: str) -> DataFrame:
        whole = F.struct("record_id", "uri", "page_id", "refers_to_page")
        return recs.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(whole).alias(kind), F.count("*").alias(f"n_{kind}"))

    main = recs.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "uri", F.struct("type", "payload_digest", "payload_bytes", "refers_to", "payload").alias("response"))
    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    t = transactions(written(records(spark, path), "warc-records"))
    return t.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to"))


OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: list_aggregate(list_transform([3, 2, 1, 0], lambda s: (((strpos('0123456789abcdef', substr(h, i::INT, 1)) - 1) // (2 ** s)::INT) % 2)::VARCHAR), 'string_agg', '')), 'string_agg', '') AS bits,
             min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('{ALPHABET}', (1 + 16 * substr(bits, (5 * k + 1)::INT, 1)::INT + 8 * substr(bits, (5 * k + 2)::INT, 1)::INT + 4 * substr(bits, (5 * k + 3)::INT, 1)::INT + 2 * substr(bits, (5 * k + 4)::INT, 1)::INT + substr(bits, (5 * k + 5)::INT, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM b
"""
