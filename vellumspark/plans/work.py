"""Planning of translation work: chunks of open segments, edit chunks of finished ones, dependencies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.operators.packing import chunk_by_budget
from vellumspark.operators.tree import effective_skip


def plan_work(segments: DataFrame, translations: DataFrame, translate_words: int, edit_words: int, nodes: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Chunks of every node: node, task, chunk, seq, words, segments, depends_on.

    Open segments are packed for translation, drafted ones for editing; finished ones are left out, and so are nodes that are
    skipped themselves or lie under a skipped one (nodes: node_id, parent_id, skip). seq is 100 times the node's place in the
    book (index: node_id, index; 0 without) plus the chunk's. A chunk depends on the one before it in its node, the first
    edit chunk on the last translation chunk.
    """
    if nodes is not None:
        hidden = effective_skip(nodes).where("skip").select(F.col("node_id").alias("node"))
        segments = segments.join(hidden, "node", "left_anti")
    s = segments.join(translations, "segment_id", "left").withColumn("words", F.regexp_count("text", F.lit(r"\S+")))
    todo = s.where("status is null or status in ('pending', 'queued')")
    edit = s.where("status in ('drafted', 'flagged')")

    def packed(rows: DataFrame, task: str, budget: int) -> DataFrame:
        c = chunk_by_budget(rows, ["node"], "ord", "words", budget)
        return rows.join(c, ["node", "ord"]).groupBy("node", "chunk").agg(F.sum("words").alias("words"), F.count("*").alias("segments")).withColumn("task", F.lit(task))

    both = packed(todo, "translate", translate_words).unionByName(packed(edit, "edit", edit_words))
    if index is not None:
        both = both.join(index.select(F.col("node_id").alias("node"), "index"), "node")
    else:
        both = both.withColumn("index", F.lit(0).cast("long"))
    w = Window.partitionBy("node").orderBy(F.desc("task"), "chunk")
    id_ = F.concat_ws(":", "node", "task", "chunk")
    return both.withColumn("seq", 100 * F.col("index") + F.row_number().over(w) - 1).withColumn("depends_on", F.lag(id_).over(w)).drop("index")
