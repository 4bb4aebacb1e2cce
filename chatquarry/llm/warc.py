"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins.

A folder holds two Parquet tables: `payloads` (digest, payload) and `headers` (id, row, digest, the exact bytes of the
header block, refers_to, refers_row, and the url where a header can't hold it as it is).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, bounded, table

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: The profile that marks a revisit of an identical payload (WARC 1.1, section 6.7.2).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """The folders of one archive."""

    folder: str

    @property
    def payloads(self) -> str:
        return f"{self.folder}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.folder}/headers"


def _record_id(ident: Column, row: Column) -> Column:
    """A urn:uuid that follows from the row's id and its number, so that rows that repeat have records of their own."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.coalesce(ident.cast("string"), F.lit("")), row.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


#: Characters that a header value can't hold.
CONTROLS = r"[\x00-\x1F\x7F]"


def _clean(text: Column) -> Column:
    """A header value: control characters percent-encoded, so that none ends its line; the url itself is kept apart then."""
    text = F.coalesce(text, F.lit(""))
    encode = lambda c: F.when(c.rlike(CONTROLS), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    return F.when(text.rlike(CONTROLS), F.array_join(F.transform(F.split(text, ""), encode), "")).otherwise(text)


def _header(kind: Column, ident: Column, row: Column, url: Column, date: str, digest: Column, size: Column, first: Column, first_row: Column) -> Column:
    lines = [
        F.concat(F.lit(f"{VERSION}{CRLF}WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <"), _record_id(ident, row), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _clean(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <"), _record_id(first, first_row), F.lit(f">{CRLF}WARC-Profile: {PROFILE}{CRLF}Content-Length: 0"))).otherwise(F.concat(F.lit(f"Content-Type: text/html{CRLF}Content-Length: "), size.cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")


def write(pages: DataFrame, archive: Archive, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shared_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row to the archive; nothing of it may exist yet.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads of at least `shared_bytes` bytes the
    one with the smallest id is a response and the others revisit it; smaller payloads are all responses. Rows that
    repeat the smallest id with the same payload are responses too. Every payload is stored once, by its SHA-256;
    with null ids the smallest is the least that isn't null. Every row has a record of its own, with an id of its own,
    rows that repeat included. Very long payloads are stored whole, an empty table gives an empty archive. Other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    brief = scratch.keep(rows.drop("payload").withColumn("row", F.monotonically_increasing_id()), "brief", wide=True)
    named = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("named")
    first = brief.groupBy("digest").agg(named, F.count(F.lit(1)).alias("times")).select("digest", F.col("named.id").alias("first"), F.col("named.row").alias("first_row"), "times")
    first = scratch.keep(first, "first")
    known = brief.join(first, "digest")
    kind = F.when((F.col("size") < shared_bytes) | F.coalesce(F.col("id") == F.col("first"), F.col("first").isNull()), "response").otherwise("revisit")
    known = known.withColumn("kind", kind)
    head = _header(F.col("kind"), F.col("id"), F.col("row"), F.col("url"), date, F.col("digest"), F.col("size"), F.col("first"), F.col("first_row"))
    refers = [F.when(F.col("kind") == "revisit", F.col(c)).alias(name) for c, name in (("first", "refers_to"), ("first_row", "refers_row"))]
    odd = F.when(F.col("url").isNull() | (F.col("url") == "") | F.col("url").rlike(CONTROLS), F.struct("url")).alias("odd_url")
    known.select("id", "row", "digest", head.alias("header"), *refers, odd).write.parquet(archive.headers)
    # One payload a digest, that of the smallest id. Ids and digests are joined, broadcast where they are few; the
    # payloads themselves are shuffled only where the copies are too many for that.
    shared = scratch.keep(brief.join(first.where("times > 1"), "digest"), "shared")
    repeated = scratch.keep(shared.where("id <=> first").groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    later = bounded(shared.where("id <> first").select("id", "digest"))
    nameless = bounded(shared.where("id is null and first is not null").select("digest").distinct())
    once = rows.join(later, ["id", "digest"], "left_anti").join(bounded(repeated), "digest", "left_anti")
    once = once.where("id is not null").unionByName(once.where("id is null").join(nameless, "digest", "left_anti")).select("digest", "payload")
    again = rows.join(bounded(repeated), "digest", "left_semi").select("digest", "payload").dropDuplicates(["digest"])
    once.unionByName(again).write.parquet(archive.payloads)
    scratch.drop(brief, first, shared, repeated)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Rebuilds the archive's records, a row each: id, url (as it was written, null too), record_type, payload_digest, payload_bytes, refers_to, header, payload.

    Type, digest and lengths are read from the header's bytes; the payload joins by digest and is verified against it.
    A record whose payload is missing or doesn't have the digest or length that its header states raises an error.
    """
    heads, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    text = F.decode("header", "UTF-8")
    heads = heads.select("id", "row", "header", "refers_to", "refers_row", "odd_url", _field(text, "WARC-Type").alias("record_type"), F.regexp_replace(_field(text, "WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), F.when(F.col("odd_url").isNotNull(), F.col("odd_url.url")).otherwise(_field(text, "WARC-Target-URI")).alias("url"), _field(text, "Content-Length").cast("long").alias("stated"), F.regexp_extract(text, r"WARC-Refers-To: <([^>]*)>", 1).alias("refers_uri"))
    checked = payloads.withColumns({"good": F.sha2("payload", 256) == F.col("digest"), "payload_bytes": F.octet_length("payload").cast("long")})
    out = heads.join(checked, heads.payload_digest == checked.digest, "left")
    right = F.coalesce(F.col("good"), F.lit(False)) & ((F.col("record_type") == "revisit") | (F.col("stated") == F.col("payload_bytes"))) & ((F.col("record_type") != "revisit") | (F.col("refers_uri") == _record_id(F.col("refers_to"), F.col("refers_row"))))
    out = out.withColumn("payload_bytes", F.when(right, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))
    return out.select("id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """id and the record's exact bytes: header block, payload (none for a revisit), two line ends."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("id", F.concat("header", body, F.lit((CRLF + CRLF).encode())).alias("record"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = Archive(Scratch(spark, "archive").path("warc"))
    write(table(spark, sf_dir, "pages"), archive)
    out = read(spark, archive)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < 100 or page_id = first then 'response' else 'revisit' end as record_type,
  case when payload_bytes < 100 or page_id = first then null else first end as refers_to
from f
"""
