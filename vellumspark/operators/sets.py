"""Set operations over terms, titles and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def title_union(known: DataFrame, outline: DataFrame, headings: DataFrame) -> DataFrame:
    """Distinct titles of over two characters from three sources: doc_id, title."""
    t = known.select("doc_id", "title").unionByName(outline.select("doc_id", "title")).unionByName(headings.select("doc_id", "title"))
    return t.distinct().where(F.char_length("title") > 2)


def exclude_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known.select(F.lower("src").alias("key")).distinct(), "key", "left_anti")


def insert_new_terms(terms: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Terms with the incoming ones whose source, in any case, is new; of equal incoming sources the first stays."""
    fresh = incoming.withColumn("_k", F.lower("src")).join(terms.select(F.lower("src").alias("_k")).distinct(), "_k", "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(order))).where("_n = 1")
    return terms.unionByName(first.select(*terms.columns))
