"""Corpus-wide text jobs that return rows rather than a changed column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import text as T


def search_snippets(texts: DataFrame, key: str, col: str, query: str, before: int = 70, after: int = 90) -> DataFrame:
    """Text around the first hit with an ellipsis where it is cut: key, snippet, marks (ranges inside the snippet)."""
    q = query.lower()
    r = texts.select(F.col(key), F.col(col).alias("t"), T.contains_ranges(F.col(col), F.lit(q)).alias("r")).where(F.size("r") > 0)
    lo = F.greatest(F.col("r")[0]["start"] - before, F.lit(0))
    hi = F.least(F.col("r")[0]["end"] + after, F.char_length("t"))
    lead = F.when(lo > 0, "…").otherwise("")
    body = F.substring("t", lo + 1, hi - lo)
    marks = F.transform(F.filter("r", lambda x: x["end"] <= hi), lambda x: F.struct((x["start"] - lo + F.char_length(lead)).alias("start"), (x["end"] - lo + F.char_length(lead)).alias("end")))
    return r.select(key, F.concat(lead, body, F.when(hi < F.char_length("t"), "…").otherwise("")).alias("snippet"), marks.alias("marks"))


def revision_churn(revisions: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Words inserted and deleted between two versions, as multisets."""
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    count = lambda c, name: revisions.select(*keys, F.explode(words(c)).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias(name))
    both = count(before, "old").join(count(after, "new"), [*keys, "w"], "full_outer").na.fill(0, ["old", "new"])
    return both.groupBy(*keys).agg(F.sum(F.greatest(F.col("new") - F.col("old"), F.lit(0))).alias("inserted"), F.sum(F.greatest(F.col("old") - F.col("new"), F.lit(0))).alias("deleted"))


def untranslated_runs(pairs: DataFrame, keys: list[str], col: str = "tgt") -> DataFrame:
    """First run of four or more Latin words in a target's prose, outside code, URLs and parentheses."""
    from vellumspark.plans.quality import LATIN_RUN, prose

    run = F.regexp_extract(prose(F.col(col)), LATIN_RUN, 0)
    return pairs.select(*keys, F.trim(run).alias("run")).where("run <> ''")
