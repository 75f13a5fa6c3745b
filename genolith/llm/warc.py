"""WARC archives without repeated payloads: revisit records are resolved by payload digest, and written with fresh headers.

An archive is a folder of WARC/1.1 files that Spark's text sink writes: a record ends with two line ends, which the sink adds. The
first field of all records of one write is the same WARC-Warcinfo-ID, drawn at random after the payloads were there, so
that it stands for the limit between two records and files are read in splits of any size. Each file begins with its warcinfo record.

Only headers (digest, length, page) are dealt by digest; a digest that several pages have is then brought to the pages.
A digest's response has a record id that follows from the digest, so that revisits refer to it without a look-up; the reader
joins revisits with their responses.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read

END = "\r\n\r\n"
#: Payloads with fewer bytes are written each time.
LEAST = 100
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = ("page_id", "url", "payload")


def _record_id(key: Column) -> Column:
    """<urn:uuid:...> that follows from a string."""
    h = F.sha2(key, 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*fields: tuple[str, Column | str]) -> Column:
    """Header lines; fields whose value is null are left out."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v.cast("string")) for name, v in fields])


def _uri(url: Column) -> Column:
    """Control characters and blanks of a URL, which would end its line or field, are escaped; an empty one is none."""
    for c in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url != "", url)


def resolve(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, payload binary) with digest, n_bytes, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the smallest page_id is a response (null after all others; of several
    rows with that page_id one), all others are revisits of it and come without payload. A null payload is an empty one. A
    row comes out for each row that goes in.
    """
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    key = F.struct(F.col("page_id").isNull().alias("null"), "page_id")
    heads = rows.where(f"n_bytes >= {least}").select("digest", key.alias("key"))
    counts = heads.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("rows"), F.countDistinct("key").alias("pages")).where("rows > 1")
    many = scratch.keep(counts.select("digest", F.col("first.page_id").alias("first"), (F.col("pages") < F.col("rows")).alias("tied")), "many")
    joined = rows.join(many, "digest", "left").withColumn("own", F.col("page_id").eqNullSafe(F.col("first")))
    revisit = F.col("first").isNotNull() | F.col("tied").isNotNull()
    plain = joined.where("tied IS NULL OR NOT tied OR NOT own").withColumn("again", revisit & ~F.col("own"))
    if many.where("tied").limit(1).count():
        # rows that share the first page_id and its payload: one of them is the response
        alike = joined.where("tied AND own").groupBy("digest", "page_id", "url", "n_bytes", "first").agg(F.count("*").alias("rows"), F.any_value("payload").alias("payload"))
        alike = alike.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("url"))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        plain = plain.select(*_COLUMNS, "digest", "n_bytes", "first", "again").unionByName(alike.select(*_COLUMNS, "digest", "n_bytes", "first", ((F.col("place") > 1) | (F.col("k") > 1)).alias("again")))
    again = F.col("again")
    return plain.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archive(records: DataFrame, folder: str, date: datetime.datetime | None = None, least: int = LEAST) -> str:
    """Writes what ``resolve`` gives as an archive, with fresh headers; returns the id of its warcinfo. A response's block is an HTTP answer."""
    info = f"<urn:uuid:{uuid.uuid4()}>"
    stamp = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    shared = _record_id(F.concat(F.lit(info), F.col("digest")))
    response = F.col("record_type") == "response"
    row = F.monotonically_increasing_id()
    own = _record_id(F.concat_ws("/", F.lit(info), row))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("n_bytes"))), F.lit(END))
    size = F.octet_length(http) + F.when(response, F.col("n_bytes")).otherwise(0)
    head = _lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.when(response & (F.col("n_bytes") >= least), shared).otherwise(own)),
        ("WARC-Date", stamp),
        ("WARC-Target-URI", _uri(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(~response, REVISIT)),
        ("WARC-Refers-To", F.when(~response, shared)),
        ("WARC-Page-ID", F.col("page_id")),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", size),
    )
    record = F.concat(F.lit(f"WARC/1.1\r\nWARC-Warcinfo-ID: {info}\r\n").cast("binary"), head.cast("binary"), F.lit(END).cast("binary"), http.cast("binary"), F.when(response, F.col("payload")).otherwise(F.lit(b"")))
    about = "software: genolith\r\nformat: WARC File Format 1.1\r\n"
    start = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {info}\r\nWARC-Date: {stamp}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}{END}{about}{END}"
    first = row.bitwiseAND((1 << 33) - 1) == 0  # of its partition, so of its file
    records.select(F.concat(F.when(first, F.lit(start)).otherwise("").cast("binary"), record).cast("string").alias("value")).write.mode("overwrite").option("lineSep", END).text(folder)
    return info


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All responses and revisits of an archive of ``write_archive``: fields (map), block (binary). Splits begin anywhere.

    A block whose length is not its Content-Length ends the job.
    """
    named = spark.read.option("lineSep", "\r\n").text(folder).where("value LIKE 'WARC-Record-ID: %'").limit(1).collect()
    info = named[0][0].partition(" ")[2] if named else "-"
    parts = spark.read.option("lineSep", f"WARC/1.1\r\nWARC-Warcinfo-ID: {info}\r\n").text(folder).where("value NOT LIKE 'WARC/1.1%' AND value <> ''")
    head = F.substring_index("value", END, 1)
    cut = parts.select(F.str_to_map(head, F.lit("\r\n"), F.lit(": ")).alias("fields"), F.col("value").cast("binary").alias("raw"), (F.octet_length(head) + len(END)).alias("at"))
    size = F.expr("CAST(fields['Content-Length'] AS int)")
    whole = F.octet_length("raw") == F.col("at") + size + len(END)
    block = F.when(whole, F.substring(F.col("raw"), F.col("at") + 1, size)).otherwise(F.raise_error(F.lit("a record is not as long as its header says")).cast("binary"))
    return cut.select("fields", block.alias("block"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, record_id, refers_to_id, digest (as the header says), payload (null for a revisit)."""
    records = read_records(spark, folder)
    field = lambda name: F.col("fields")[name]
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    payload = F.substring(F.col("block"), http + 1, F.greatest(F.octet_length("block") - http, F.lit(0)))
    return records.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to_id"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        F.when(field("WARC-Type") == "response", payload).alias("payload"),
    )


def read_payloads(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: lengths and digests of the payloads that are in the
    archive; a revisit has those of the response it refers to, or nulls if that is missing."""
    headers = read_archive(spark, folder).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}).drop("payload", "url", "digest")
    headers = scratch.keep(headers, "headers")
    revisits = headers.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to_id").alias("record_id"))
    wanted = scratch.keep(revisits.select("record_id").distinct(), "wanted")
    originals = headers.where("record_type = 'response'").join(wanted, "record_id", "left_semi").select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    found = scratch.keep(revisits, "revisits").join(scratch.keep(originals, "originals"), "record_id", "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = headers.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(*columns).unionByName(found.select(*columns))


def merge_archives(spark: SparkSession, folders: list[str], folder: str, scratch: Scratch, date: datetime.datetime | None = None, least: int = LEAST) -> str:
    """Writes one archive of the records of several, each payload once. Revisits are joined to the payload by its digest, wherever it is;
    one whose payload is in none of them raises an error. Returns the id of the warcinfo."""
    records = None
    for f in folders:
        own = read_archive(spark, f).select("page_id", "url", "digest", "record_type", "payload")
        records = own if records is None else records.unionByName(own)
    records = scratch.keep(records, "records")
    heads = scratch.keep(records.where("record_type = 'revisit'").select("page_id", "url", "digest"), "lone")
    wanted = scratch.keep(heads.select("digest").distinct(), "wanted")
    payloads = records.where("record_type = 'response'").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.any_value("payload").alias("payload"))
    payload = F.coalesce("payload", F.raise_error(F.lit("a revisit whose payload is in none of the archives")).cast("binary"))
    full = heads.join(scratch.keep(payloads, "payloads"), "digest", "left").select("page_id", "url", payload.alias("payload"))
    return write_archive(resolve(records.where("record_type = 'response'").select(*_COLUMNS).unionByName(full), scratch, least), folder, date, least)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, through the archive."""
    scratch = Scratch(spark, "op13")
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    folder = f"{scratch.root}/archive"
    write_archive(resolve(pages, scratch), folder)
    return read_payloads(spark, folder, scratch)


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
