"""Ordered operators: numbering, neighbours, runs and ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from vellumspark.staging import staged

UP_TO = (Window.unboundedPreceding, 0)


def assign_ord(rows: DataFrame, parent: list[str], order: list) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)) - 1)


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in an order over all of them, without one task that holds them all.

    Rows are dealt by ranges of the order and counted by range; a row's place is its place in its range after the ranges
    before. Only the counts, one a partition, meet in one task. Rows of equal order share a range and are told apart at will.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_k", inside).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_range", "_before", "_k")


def paragraph_numbers(blocks: DataFrame, node: str, order: str) -> DataFrame:
    """Running number of a block in its node without headings, which get 0."""
    w = Window.partitionBy(node).orderBy(order).rowsBetween(*UP_TO)
    body = F.when(F.col("type") != "heading", 1).otherwise(0)
    return blocks.withColumn("number", F.when(F.col("type") == "heading", 0).otherwise(F.sum(body).over(w)))


def prev_next(nodes: DataFrame, part: str, order: list[str], chapter: str) -> DataFrame:
    """Previous and next node of a reading order, and whether a node is the last of its chapter."""
    w = Window.partitionBy(part).orderBy(*order)
    last = F.coalesce(F.lead(chapter).over(w) != F.col(chapter), F.lit(True))
    return nodes.select("*", F.lag("node_id").over(w).alias("prev"), F.lead("node_id").over(w).alias("next"), last.alias("last_of_chapter"))


def line_gaps(lines: DataFrame, body_size: float) -> DataFrame:
    """Distance of a body line to the one before on its page."""
    w = Window.partitionBy("doc_id", "page").orderBy("y")
    return lines.where(F.abs(F.col("size") - body_size) < 0.5).withColumn("gap", F.col("y") - F.lag("y").over(w)).where("gap is not null")


def assign_to_cut(blocks: DataFrame, cuts: DataFrame, doc: str, pos: str) -> DataFrame:
    """Every block with the key of the last cut at or before it; null before the first."""
    marked = blocks.join(cuts, [doc, pos], "left")
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(*UP_TO)
    return marked.withColumn("node_key", F.last("cut", ignorenulls=True).over(w)).drop("cut")


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def item_keys(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Zero-padded keys from 1 inside a group, two digits at least."""
    w = Window.partitionBy(*group)
    width = F.greatest(F.lit(2), F.char_length(F.count("*").over(w).cast("string")))
    return rows.withColumn("key", F.lpad(F.row_number().over(w.orderBy(*order)).cast("string"), width, F.lit("0")))


def context_rows(rows: DataFrame, chapter: list[str], order: str, col: str) -> DataFrame:
    """The two texts before and the one after, in a chapter."""
    w = Window.partitionBy(*chapter).orderBy(order)
    return rows.select("*", F.lag(col, 2).over(w).alias("before2"), F.lag(col, 1).over(w).alias("before1"), F.lead(col, 1).over(w).alias("after1"))


def chapter_ranges(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Page ranges from chapter starts, with a leading range when the first chapter starts later: doc_id, start, end."""
    w = Window.partitionBy("doc_id").orderBy("start")
    starts = outline.select("doc_id", F.col("page").alias("start")).distinct()
    lead = starts.groupBy("doc_id").agg(F.min("start").alias("first")).where("first > 0").select("doc_id", F.lit(0).alias("start"))
    every = starts.union(lead).join(pages, "doc_id")
    return every.select("doc_id", "start", (F.coalesce(F.lead("start").over(w), F.col("page_count")) - 1).alias("end"))


def chapter_numbers(nodes: DataFrame, doc: str, order: list[str], label: str) -> DataFrame:
    """Chapter numbers: a given one restarts the count, a missing one follows the one before."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(*UP_TO)
    island = nodes.withColumn("_i", F.count(label).over(w))
    v = Window.partitionBy(doc, "_i").orderBy(*order)
    base = F.coalesce(F.first(label).over(v.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    return island.withColumn("number", base + F.row_number().over(v) - 1).drop("_i")


def parent_from_depth(entries: DataFrame, doc: str, pos: str, depth: str) -> DataFrame:
    """Position of the nearest earlier entry of smaller depth as parent_pos, null for none; depths of any size.

    The entries of a document pass in order through one task, batch by batch; what is kept are the open ancestors.
    """
    columns, at = entries.columns, [entries.columns.index(c) for c in (doc, pos, depth)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, []
        for batch in batches:
            parents = []
            for key, where, deep in zip(*(batch.column(k).to_pylist() for k in at)):
                if (key,) != current:
                    current, open_ = (key,), []
                if deep is None:
                    parents.append(None)
                    continue
                while open_ and open_[-1][1] >= deep:
                    open_.pop()
                parents.append(open_[-1][0] if open_ else None)
                open_.append((where, deep))
            kind = batch.schema.field(at[1]).type
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, kind)], names=[*columns, "parent_pos"])

    schema = StructType([*entries.schema.fields, StructField("parent_pos", entries.schema[pos].dataType)])
    return entries.repartition(doc).sortWithinPartitions(doc, pos).mapInArrow(placed, schema)


def heading_depth(headings: DataFrame, doc: str, size: str, title: str) -> DataFrame:
    """Depth of a heading, up to 2: 0 for a chapter label, the number of dots of a dotted number, else its size's rank.

    A dotted number stands before white space or alone, as in 2.3 Notes; four parts of which one has three digits are an address.
    """
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(F.round(size)))) - 1
    dotted = F.regexp_extract(title, r"^\s*(?!(?=[\d.]*\d{3})\d{1,3}(?:\.\d{1,3}){3}(?!\S))(\d+(?:\.\d+)+)(?!\S)", 1)
    depth = F.when(F.lower(title).rlike(r"^\s*(chapter|part|appendix)\b"), 0).when(dotted != "", F.least(F.char_length(dotted) - F.char_length(F.replace(dotted, F.lit("."), F.lit(""))), F.lit(2))).otherwise(F.least(rank, F.lit(2)))
    return headings.withColumn("depth", depth.cast("int"))


def budgeted_passages(rows: DataFrame, anchor: str, doc: str = "doc_id", max_chars: int = 12_000) -> DataFrame:
    """Rows around an anchor by distance until one would pass the budget; the first row always stays."""
    w = Window.partitionBy(doc).orderBy(F.abs(F.col("ord") - F.col(anchor)), "ord").rowsBetween(*UP_TO)
    size = F.char_length("text")
    r = rows.withColumn("_sum", F.sum(size).over(w)).withColumn("_n", F.count("*").over(w))
    # Sums only grow, so rows after the first overflow also lie past the budget.
    return r.where((F.col("_sum") <= max_chars) | (F.col("_n") == 1)).drop("_sum", "_n")


def dependency_chain(chunks: DataFrame, chapter: str, order: str) -> DataFrame:
    """Each chunk depends on the one before it in its chapter."""
    before = F.lag("id").over(Window.partitionBy(chapter).orderBy(order))
    return chunks.withColumn("depends_on", F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)))


def history_tail(turns: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n turns before each turn, oldest first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


def round_robin_sample(segments: DataFrame, chapter: str, order: str, rounds: int = 6, words: int = 3000, doc: str | None = None) -> DataFrame:
    """The k-th paragraph of every chapter in round k, in chapter order, while the words before stay under the budget."""
    r = segments.withColumn("round", F.row_number().over(Window.partitionBy(*filter(None, [doc, chapter])).orderBy(order))).where(F.col("round") <= rounds)
    parts = [F.col(doc)] if doc else []
    before = Window.partitionBy(*parts).orderBy("round", chapter).rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0))).where(F.col("_before") < words).drop("_before")
