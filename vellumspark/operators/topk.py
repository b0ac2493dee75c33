"""Orderings, limits and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def priority_order(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.desc("priority"), "seq", "created_at").limit(n)


def task_ranked_order(items: DataFrame, ranks: dict[str, int], n: int) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col("task")]
    return items.orderBy(F.desc("priority"), F.coalesce(rank, F.lit(99)), "seq").limit(n)


def group_limit(groups: DataFrame, order: str, hits: str, by: list[str], limit: int = 100) -> DataFrame:
    """Groups in order up to the one that reaches the limit, which is kept whole."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("_b", F.coalesce(F.sum(hits).over(before), F.lit(0))).where(F.col("_b") < limit).drop("_b")


def glossary_order(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """Terms (term_id, src) with how often they occur (matches: term_id), most frequent first, then by source."""
    n = matches.groupBy("term_id").agg(F.count("*").alias("occurrences"))
    return terms.join(n, "term_id", "left").na.fill(0, ["occurrences"]).orderBy(F.desc("occurrences"), "src")


def log_tail(log: DataFrame, key: str, order: list, n: int = 120) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def boosted_priority(items: DataFrame, base: dict[str, int], boosted: DataFrame, key: str) -> DataFrame:
    """Base priority by task, 500 more for chosen keys, 100 for a reader's request and 200 for a re-run."""
    p = F.coalesce(F.create_map(*(F.lit(x) for kv in base.items() for x in kv))[F.col("task")], F.lit(0))
    chosen = boosted.select(key).distinct().withColumn("_b", F.lit(500))
    extra = F.when(F.col("origin") == "reader", 100).when(F.col("origin") == "rerun", 200).otherwise(0)
    return items.join(chosen, key, "left").withColumn("priority", p + F.coalesce("_b", F.lit(0)) + extra).drop("_b")
