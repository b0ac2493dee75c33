"""Line dedup over overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.skew import join_counted
from vellumspark.llm.store import staged


def _windows(lines: Column, size: int) -> Column:
    """Position and 128-bit hash of every run of `size` lines, from two 64-bit hashes of each line."""
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    last = F.size(lines) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    run = lambda h, i, part: F.xxhash64(*(h[i + k][part] for k in range(size)))
    # The hashes are bound once a text: a transform over an array of one.
    bound = F.transform(F.array(hashes), lambda h: F.transform(places, lambda i: F.struct(i.alias("pos"), run(h, i, "a").alias("h1"), run(h, i, "b").alias("h2"))))
    return bound[0]


def line_dedup(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes the lines covered by a window of `size` consecutive lines that occurred before.

    The first occurrence is the one of the smallest (id, position) among all documents. Returns the input's columns with
    the text replaced by the lines left, joined by newlines, and n_lines and n_removed appended (columns of those names in
    the input are replaced).

    Lines are split at newlines and compared to the byte. A text with fewer lines than a window keeps them all; an empty
    text is one empty line; a null text stays null with 0 lines. Rows that share an id count as one document, so a
    repeated row is not a later occurrence of itself. Documents with a null id are left as they are. An empty table gives
    no rows. Windows are reduced to their first place before
    the shuffle, and rows of a window common to a large part of all documents stay where they are.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = F.split(F.col(text_col), "\n", -1)
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.explode(_windows(lines, size)).alias("w"))
    windows = staged(ids.select("_id", "w.pos", "w.h1", "w.h2"), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.min(F.struct("_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_counted(windows, staged(repeated, "repeated"), ["h1", "h2"]).where(F.struct("_id", "pos") != F.col("first"))
    gone = later.groupBy("_id").agg(F.collect_set("pos").alias("_starts"))
    # All is linear in the lines: the positions left are those of the text without the covered ones, in order.
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + size - 1))))
    gone = gone.select(F.col("_id"), covered.alias("_covered"))

    def kept(whole: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("_covered"))
        return F.array_join(F.transform(places, lambda i: whole[i]), "\n")

    # The lines are bound once a text, as above.
    left = F.transform(F.array(lines), kept)[0]
    out = {c: F.col(c) for c in keep} | {text_col: F.when(F.col("_covered").isNull(), F.col(text_col)).otherwise(left)}
    columns = [
        *(v.alias(k) for k, v in out.items()),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"),
    ]
    known = docs.where(F.col(id_col).isNotNull()).select(*keep)
    known = known.join(gone, known[id_col].cast("long") == gone["_id"], "left").select(*columns)
    # Rows without an id would all meet in one task of the join.
    unknown = docs.where(F.col(id_col).isNull()).select(*keep).withColumn("_covered", F.lit(None).cast("array<int>"))
    return known.unionByName(unknown.select(*columns))
