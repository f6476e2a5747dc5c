"""A content-addressed archive of web records.

Payload bytes are stored once for each SHA-256 digest; the exact header bytes of every record are stored apart, with
the digest that they belong to. Records come back through a join. Digests are verified: rows of one digest must agree in
size and SHA-1 when they are stored, payloads must have their digest when they are read, and what a record's headers say of
its length and its payload's digest must be so.

Of records with equal payloads of at least min_bytes the one with the largest id is a response and the others revisit
it; smaller ones are all responses. The payload of a digest goes through the shuffle once for each map task at most.

Defined results
* null payload counts as empty; null ids rank below all others, their records are named by an empty string;
* rows that repeat with the same id and payload are each a response if one of them is;
* line breaks in addresses are left out of the headers;
* an empty table gives an empty archive; columns other than the id, the address and the payload aren't archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, scratch_path, stored, text_of

#: The date in every record, so that runs agree.
DATE = "2020-01-01T00:00:00Z"
#: The digests of responses are broadcast up to this many rows (some 100 bytes each).
BROADCAST_ROWS = 300_000
#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of 20 bytes given as 40 hex digits: 5 digits are 4 characters."""
    parts = []
    for at in range(1, 41, 5):
        v = F.conv(F.substring(hex40, at, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def headers(kind: Column, key: Column, url: Column, digest32: Column, size: Column, refers_to: Column) -> Column:
    """The exact bytes before a record's payload: the record's header and the HTTP header that starts its block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = kind == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _urn(key)),
        F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", ""))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest32),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http), "UTF-8")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes folder/payloads and folder/records."""
    t = packed(pages, _id=id_col, _url=F.col(f"`{url_col}`").cast("string"), _payload=F.encode(text_of(payload_col), "UTF-8")).drop("_row")
    t = t.withColumns({"sha256": F.sha2("_payload", 256), "_sha1": F.sha1("_payload"), "_size": F.octet_length("_payload").cast("long")})

    same = t.groupBy("sha256").agg(
        F.max_by("_payload", F.struct("_id")).alias("payload"), F.max("_id").alias("keep"),
        F.min("_size").alias("a"), F.max("_size").alias("z"), F.min("_sha1").alias("p"), F.max("_sha1").alias("q"),
    )
    checked = F.when((F.col("a") == F.col("z")) & (F.col("p") == F.col("q")), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("sha256"))))
    same.select(checked.alias("sha256"), "payload", "keep").write.option("compression", "zstd").parquet(f"{folder}/payloads")

    kept = pages.sparkSession.read.parquet(f"{folder}/payloads").select("sha256", "keep")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    r = t.drop("_payload").join(kept, "sha256")
    kind = F.when((F.col("_size") < min_bytes) | F.col("_id").eqNullSafe(F.col("keep")), F.lit("response")).otherwise(F.lit("revisit"))
    r = r.withColumns({"type": kind, "digest32": base32_of_hex(F.col("_sha1"))})
    head = headers(F.col("type"), F.col("_id"), F.col("_url"), F.col("digest32"), F.col("_size"), F.col("keep"))
    r.select(F.col("_id").alias("id"), head.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{folder}/records")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """sha256 and payload, verified."""
    t = spark.read.parquet(f"{folder}/payloads").select("sha256", "payload")
    good = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have its digest "), F.col("sha256"))))
    return t.select("sha256", good.alias("payload"))


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """id and record, the exact bytes of every record with its ending: header, payload unless it's a revisit, two line ends."""
    heads = spark.read.parquet(f"{folder}/records").withColumn("revisit", F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n"))
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    whole = heads.filter("not revisit").join(payloads(spark, folder), "sha256").select("id", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(heads.filter("revisit").select("id", F.concat("header", end).alias("record")))


def parsed(raw: DataFrame) -> DataFrame:
    """What records (id, record) say: id, type, name, url, digest32, refers_to (the name, null for responses), payload_bytes and
    payload_digest of the payload that they hold, null for revisits. A record whose length or digest isn't what its headers
    say fails."""
    # Latin-1 gives each byte a character, so that positions in the string are those of the bytes.
    t = raw.select("id", F.decode("record", "ISO-8859-1").alias("_s"))
    t = t.withColumn("_head", F.substring_index("_s", "\r\n\r\n", 1)).withColumn("_rest", F.expr("substr(_s, length(_head) + 5)"))
    t = t.withColumn("_http", F.substring_index("_rest", "\r\n\r\n", 1))
    lines = F.concat(F.lit("\r\n"), F.col("_head"), F.lit("\r\n"))
    field = lambda text, name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    t = t.withColumns({"type": field(lines, "WARC-Type"), "name": field(lines, "WARC-Record-ID"), "url": F.decode(F.encode(field(lines, "WARC-Target-URI"), "ISO-8859-1"), "UTF-8"), "refers_to": field(lines, "WARC-Refers-To")})
    t = t.withColumns({"digest32": F.regexp_extract(lines, r"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n", 1), "_block": field(lines, "Content-Length").cast("long")})
    http = F.concat(F.lit("\r\n"), F.col("_http"), F.lit("\r\n"))
    t = t.withColumns({"_said": field(http, "Content-Length").cast("long"), "_payload": F.encode(F.expr("substr(_rest, length(_http) + 5, _block - length(_http) - 4)"), "ISO-8859-1")})
    response = F.col("type") == "response"
    size = F.octet_length("_payload").cast("long")
    whole = (F.length("_rest") == F.col("_block") + 4) & F.col("_rest").endswith("\r\n\r\n") & (~response | (F.col("_said") == size)) & (response | (size == 0))
    t = t.withColumns({"payload_bytes": F.when(response, size), "payload_digest": F.when(response, base32_of_hex(F.sha1("_payload")))})
    good = whole & (~response | (F.col("payload_digest") == F.col("digest32")))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("a record isn't what its headers say: "), F.coalesce("name", F.lit("without a name")))))
    return t.select("id", checked.alias("type"), "name", "url", "digest32", "refers_to", "payload_bytes", "payload_digest")


def pages_back(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """Per record, from its bytes: the id under its own name, payload_bytes and payload_digest of the full payload (for revisits
    that of the response they refer to), record_type, refers_to (the response's id as text) and url."""
    found = stored(parsed(rebuilt(spark, folder)), "records-back")
    own = found.filter("type = 'response'").drop("name", "refers_to")
    named = found.filter("type = 'response'").select(F.col("name").alias("refers_to"), "digest32", F.col("payload_bytes").alias("_b"), F.col("payload_digest").alias("_d")).distinct()
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    other = found.filter("type = 'revisit'").join(named, ["refers_to", "digest32"], "left")
    missing = F.raise_error(F.concat(F.lit("there is no record "), F.col("refers_to")))
    other = other.select("id", "type", "url", "digest32", F.regexp_extract("refers_to", r"^<urn:record:(.*)>$", 1).alias("refers_to"), F.coalesce("_b", missing.cast("long")).alias("payload_bytes"), F.col("_d").alias("payload_digest"))
    both = own.withColumn("refers_to", F.lit(None).cast("string")).unionByName(other)
    return both.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "digest32", "url")


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    folder = scratch_path(pages.sparkSession, "archive")
    write(pages, folder, min_bytes, id_col, url_col, payload_col)
    return pages_back(pages.sparkSession, folder, id_col)


QUERY = "op5_warc"

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, sha1(h) AS s, CAST(strlen(h) AS BIGINT) AS n, max(page_id) AS keep FROM p GROUP BY h),
b AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1) FOR i IN range(32)], '') AS d FROM k)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN b USING (h)
"""
