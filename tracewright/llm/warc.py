"""WARC archives without repeated payloads (operator 7)."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Shorter payloads are always written: a revisit record would be no smaller.
MIN_BYTES = 1000
#: Payload bytes of an archive file, about; a file is read whole.
FILE_BYTES = 24 << 20
#: Parts over which each repeated digest's records are dealt.
SALTS = 32
#: Repeated digests are known by so many of their hash's values before their pages are looked up.
SLOTS = 1 << 20
#: The date of all records: pages have none of their own.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _bare(text: Column) -> Column:
    """A header value: without line ends, which would end the header."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, refers_url)`` of every page.

    Headers (digest, id, url) meet by digest, summed before the shuffle, so a digest that very many records share costs a
    row a task. Pages that are too short, or whose digest is surely not repeated by a table of SLOTS values at most, are
    responses where they are; only the others are shuffled, to join the repeated digests, dealt over SALTS parts each.
    Null html is an empty payload. Of pages with one payload of MIN_BYTES or more the largest id is the response, rows
    that repeat this id included; if all ids are null, all are responses.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    headers = rows.filter(F.col("payload_bytes") >= MIN_BYTES).groupBy("payload_digest").agg(
        F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n")
    )
    headers = cut(headers.filter("n > 1 and first_id is not null").drop("n"))
    slot = F.xxhash64("payload_digest").bitwiseAND(F.lit(SLOTS - 1))
    some = F.broadcast(headers.select(slot.alias("slot")).distinct().withColumn("maybe", F.lit(True)))  # SLOTS rows at most
    marked = rows.withColumn("slot", F.when(F.col("payload_bytes") >= MIN_BYTES, slot)).join(some, "slot", "left").drop("slot")
    first = marked.filter("maybe is null").withColumns({"first_id": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    repeated = headers.select("payload_digest", "first_id", "first_url", F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt"))
    salted = marked.filter("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(repeated, ["payload_digest", "salt"], "left").drop("salt").unionByName(first)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"),
    )


def _record_id(*parts: Column) -> Column:
    digest = F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("none")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(resolved: DataFrame) -> DataFrame:
    """``(record)``: the text of a WARC/1.1 record for each page, without the two line ends that close it.

    A revisit has the HTTP head of its response and no payload; its digest and length are the original's, and it names
    the response's record, date and target. A response's record id follows from its payload, page and target, so that
    revisits can name it; only responses that are equal in all three share one. A revisit's follows from its place too.
    """
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    own = [F.col("payload_digest"), F.col("page_id"), _bare(F.col("url"))]
    response = _record_id(F.lit("response"), F.col("payload_digest"), F.col("refers_to"), _bare(F.col("refers_url")))
    record_id = F.when(revisit, _record_id(F.lit("revisit"), *own, F.monotonically_increasing_id())).otherwise(_record_id(F.lit("response"), *own))
    return resolved.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _line("WARC-Type", F.col("record_type")),
            _line("WARC-Record-ID", record_id),
            _line("WARC-Date", F.lit(DATE)),
            _line("WARC-Target-URI", _bare(F.col("url"))),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("payload_digest"))),
            _line("X-Page-ID", key),
            _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            F.when(revisit, F.concat(
                _line("WARC-Profile", F.lit(_PROFILE)),
                _line("WARC-Refers-To", response),
                _line("WARC-Refers-To-Date", F.lit(DATE)),
                _line("WARC-Refers-To-Target-URI", _bare(F.col("refers_url"))),
                _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            )).otherwise(F.lit("")),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            _line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"), block,
        ).alias("record")
    )


def write(resolved: DataFrame, folder: str, mean_bytes: float) -> None:
    """Write the records as gzipped archives of about FILE_BYTES at most, by Spark's own committer.

    The text writer ends each row with the two line ends that close a record, so its files are archives. They follow
    the partitions of the join that resolved the records, and a large partition is written as several files.
    """
    most = max(1, int(FILE_BYTES / max(1.0, mean_bytes)))
    records(resolved).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).mode("overwrite").text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of every record of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield head, view[start:stop]
        at = stop + 4


def _number(text: str | None) -> int | None:
    return None if text in (None, "none") else int(text)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` of the archives in ``folder``.

    Digest and length of a response are taken from its payload, and must be what its header says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(zlib.decompress(content.as_py(), 31)):
                    said = head["warc-payload-digest"].removeprefix("sha1:").lower()
                    length = int(head["x-payload-length"])
                    if head["warc-type"] == "response":
                        payload = block[len(block) - length :]
                        if hashlib.sha1(payload).hexdigest() != said or not bytes(block[: len(block) - length]).endswith(b"\r\n\r\n"):
                            raise ValueError(f"payload of page {head['x-page-id']} is damaged")
                    rows.append((_number(head["x-page-id"]), length, said, head["warc-type"], _number(head.get("x-refers-to-page-id")), head["warc-target-uri"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives to ``folder`` (by default a new one in the shared folder) and read them back.

    A row for each page, whose id and url may be null or repeat; an empty table gives none; other columns don't matter.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    mean = pages.agg(F.avg(F.octet_length(F.col(html_col)))).first()[0] or 0.0
    write(resolve(pages, id_col, url_col, html_col), folder, mean)
    return read(spark, folder)
