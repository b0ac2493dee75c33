"""Registered queries of the llm operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import hamming, mixing, quality, store, warcstore
from vellumspark.llm.decontam import decontaminate
from vellumspark.llm.golay import fuzzy_classes
from vellumspark.llm.linededup import line_dedup
from vellumspark.llm.metrictree import vector_codes
from vellumspark.llm.neardup import near_duplicates
from vellumspark.llm.periodic import periodic_runs
from vellumspark.llm.siteextract import extract_pages
from vellumspark.llm.substring import substring_dedup
from vellumspark.llm.tokens import token_counts

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "turn")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Classifier:
    return quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, fitted(spark, docs, sf_dir))
    return scores.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "archive")
    warcstore.write_archive(table(spark, sf_dir, "pages"), path)
    back = warcstore.read_archive(spark, path)
    columns = [F.col("record_id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "verified"]
    return back.select(*columns, F.octet_length("record").cast("long").alias("record_bytes"))


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.hamming_topk(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fuzzy_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_classes(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of which repeat a period of their own from some word on to the end, as op13's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    placed = split.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, cast(a as int) + 1, p), cast(ceil((n - a) / p) as int))), 1, cast(n - a as int))")
    made = F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("longest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_main_text": op7_main_text,
    "op8_warc": op8_warc,
    "op9_hamming_topk": op9_hamming_topk,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fuzzy_hashing": op11_fuzzy_hashing,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op9_hamming_topk": hamming.SQL,
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS l FROM documents),
        w AS (SELECT doc_id, p, array_to_string(l[p + 1 : p + 3], chr(10)) AS t
              FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS p FROM d WHERE len(l) >= 3)),
        f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS k FROM w),
        g AS (SELECT DISTINCT doc_id, p + j AS at FROM f, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
        x AS (SELECT d.doc_id, i - 1 AS at, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d) d),
        k AS (SELECT x.doc_id, count(*) AS n, count(g.at) AS gone, coalesce(string_agg(line, chr(10) ORDER BY x.at) FILTER (WHERE g.at IS NULL), '') AS kept
              FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.at = x.at GROUP BY x.doc_id)
        SELECT doc_id, n::BIGINT AS n_lines, gone::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k
    """,
}
