"""Content-addressed web archive: payload bytes once by digest, record headers apart, records rebuilt by a join.

The archive is two Parquet tables: payloads (address, payload, uses) holds every distinct payload once under its SHA-256;
records (header, address, slot) holds what precedes the payload in every record: the exact WARC/1.1 header and the HTTP head
with which its block begins. A response's block ends with the payload, a revisit's with the HTTP head. A read joins the tables,
checks the digest and the lengths that the heads state, and gives back the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.skew import join_counted
from vellumspark.llm.store import staged

# RFC 4648 base 32, and the profile URI of revisit records.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

# Records of one payload that meet in one group of the join.
SLOT = 4096


def base32(hex_digest: Column) -> Column:
    """Upper-case base 32 of a digest of whole 20-bit groups in hex, such as SHA-1."""
    groups = [F.conv(F.substring(hex_digest, at, 5), 16, 10).cast("int") for at in range(1, 41, 5)]
    letters = [F.substring(F.lit(ALPHABET), F.shiftright(g, k).bitwiseAND(31) + 1, F.lit(1)) for g in groups for k in (15, 10, 5, 0)]
    return F.concat(*letters)


def _page(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record a page under path; of equal payloads of at least min_bytes the smallest id is the response.

    The others become revisit records that refer to it. Smaller payloads are all responses. Null html is an empty
    payload, a null url an empty target; line ends in a url become spaces. Rows that repeat an id are one record each and
    the first of equal payloads is still the smallest id, so repeated rows of it are responses. A page with a null id is
    archived without a number in its record id: it revisits a numbered page of equal payload, and is a response where
    there is none. Other columns are not read. An empty table gives an empty archive.

    Digests alone are grouped and joined, those of a large part of all pages apart. A payload is one row of the store,
    combined before its shuffle, with the number of its records.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    digests = rows.select("record_id", "url", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    marks = staged(digests, "digests")
    firsts = staged(marks.groupBy("address").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n"), F.ceil(F.count("*") / SLOT).cast("int").alias("slots")), "firsts")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    known = join_counted(marks, firsts, ["address"]).withColumn("http", http)
    response = F.col("first_id").isNull() | F.col("record_id").eqNullSafe(F.col("first_id")) | (F.col("size") < min_bytes)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _page(F.col("record_id"))),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(response, "").otherwise(F.concat(_line("WARC-Refers-To", _page(F.col("first_id"))), _line("WARC-Profile", F.lit(PROFILE)))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length("http") + F.when(response, F.col("size")).otherwise(0)).cast("string")),
        F.lit("\r\n"),
        F.col("http"),
    )
    slot = F.pmod(F.xxhash64("record_id", "url"), F.col("slots")).cast("int")
    known.select(header.cast("binary").alias("header"), "address", slot.alias("slot")).write.option("compression", "zstd").parquet(f"{path}/records")
    stored = rows.groupBy(F.sha2("payload", 256).alias("address")).agg(F.first("payload").alias("payload"), F.count("*").alias("uses"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(lines: Column, name: str, place: int = 1) -> Column:
    """What follows the field's name in the first line (or the one of another place) that starts with it; null where no line does."""
    return F.substring(F.try_element_at(F.filter(lines, lambda x: x.startswith(f"{name}: ")), F.lit(place)), len(name) + 3, 1 << 30)


def _number(page: Column) -> Column:
    return F.regexp_extract(page, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Every record's exact head and its fields: header, address, slot, record_id, url, record_type, payload_digest, refers_to, block, size.

    block is the length of the record's block, size that of its payload, which the HTTP head also states for revisits. Lines of a header end with CR LF and with nothing else, whatever separators a url holds.
    """
    records = spark.read.schema("header binary, address string, slot int").parquet(f"{path}/records")
    lines = F.split(F.col("header").cast("string"), "\r\n", -1)
    return records.select(
        "header",
        "address",
        "slot",
        _number(_field(lines, "WARC-Record-ID")).alias("record_id"),
        _field(lines, "WARC-Target-URI").alias("url"),
        _field(lines, "WARC-Type").alias("record_type"),
        F.regexp_extract(_field(lines, "WARC-Payload-Digest"), "^sha1:(\\w+)$", 1).alias("payload_digest"),
        _number(_field(lines, "WARC-Refers-To")).alias("refers_to"),
        _field(lines, "Content-Length").try_cast("long").alias("block"),
        _field(lines, "Content-Length", -1).try_cast("long").alias("size"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every stored payload once: address, payload, and uses, the number of its records."""
    return spark.read.schema("address string, payload binary, uses long").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records rebuilt: header fields, payload, the record's exact bytes, and what the payload's own bytes give.

    digest (SHA-1 in base 32) and length are computed from the joined payload; verified says that they and its SHA-256
    agree with the heads and the address, and that the block is as long as its header says. A payload of many records is repeated for every SLOT of them, so that no
    task has to rebuild all.
    """
    stored = read_payloads(spark, path).select("address", "payload", F.explode(F.sequence(F.lit(0), F.ceil(F.col("uses") / SLOT).cast("int") - 1)).alias("slot"))
    joined = read_headers(spark, path).join(stored, ["address", "slot"])
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    whole = joined.withColumn("record", F.concat("header", body, F.lit("\r\n\r\n").cast("binary")))
    seen = whole.withColumn("digest", base32(F.sha1("payload"))).withColumn("length", F.octet_length("payload").cast("long"))
    # A record ends with two line ends, and its WARC header with the first empty line.
    begin = F.instr(F.col("header").cast("string"), "\r\n\r\n")
    named = F.octet_length(F.substring(F.col("header").cast("string"), F.lit(1), begin + 3))
    whole_block = F.octet_length("record") - 4 - named == F.col("block")
    agree = whole_block & (F.sha2("payload", 256) == F.col("address")) & (F.col("digest") == F.col("payload_digest")) & (F.col("length") == F.col("size"))
    return seen.withColumn("verified", F.coalesce(agree, F.lit(False))).drop("slot", "size", "block")
