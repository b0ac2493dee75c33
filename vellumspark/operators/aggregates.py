"""Counters, robust statistics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.functions import lang
from vellumspark.functions import text as T


def progress_counters(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total and finished segments of a counter_join frame; skipped nodes and skipped translations do not count."""
    kept = rows.where("not skip").where("status is null or status <> 'skipped'")
    return kept.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*lang.DONE)).alias("done"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows by status, and those of them rejected: an error noted while still open."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull() & F.col("status").isin("queued", "running")).alias("rejected"))


def task_status_pivot(rows: DataFrame, by: str, statuses: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot("status", statuses).count().na.fill(0)


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: str, pos: str, step: float = 0.5) -> DataFrame:
    """The value, rounded to a step, with most weight; the one seen first wins ties."""
    bucket = F.floor(F.col(value) / step + 0.5) * step
    sums = rows.groupBy(*by, bucket.alias("mode")).agg(F.sum(weight).alias("w"), F.min(pos).alias("p"))
    return sums.groupBy(*by).agg(F.max_by("mode", F.struct("w", (-F.col("p")).alias("p"))).alias("mode"))


def nearest_rank_percentile(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The element at round((n - 1) p) of the sorted values of a group; ranked in a sort, without collecting the group."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(value))
    r = rows.where(F.col(value).isNotNull()).select(*by, value, at.alias("_k"), F.count("*").over(w).alias("_n"))
    return r.where(F.col("_k") == F.floor((F.col("_n") - 1) * p + 0.5) + 1).select(*by, F.col(value).alias("value"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles with one rounding: the product's error is worked out from halves of its factors, the sum's from its parts."""
    high = lambda x: 134217729.0 * x - (134217729.0 * x - x)
    error = lambda p: (high(a) * high(b) - p + high(a) * (b - high(b)) + (a - high(a)) * high(b)) + (a - high(a)) * (b - high(b))

    def total(p: Column) -> Column:
        return T.bind(p + c, lambda s: s + (((p - (s - (s - p))) + (c - (s - p))) + error(p)))

    return T.bind(a * b, total)


def with_percentile(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """Rows with the continuous percentile of their group: neighbours in order are interpolated as quantile_cont does it.

    Its product with the lower neighbour is fused with the sum, so a place that lies exactly on a bound stays on its side.
    Values are ranked in a sort, without collecting the group.
    """
    w = Window.partitionBy(*by)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last()))).withColumn("_at", (F.count(value).over(w) - 1) * F.lit(p))
    element = lambda k: F.max(F.when(F.col("_k") == k + 1, F.col(value))).over(w)
    r = r.withColumn("_lo", element(F.floor("_at"))).withColumn("_hi", element(F.ceil("_at"))).withColumn("_part", F.col("_at") - F.floor("_at"))
    return r.withColumn(name, fused(F.col("_lo"), 1 - F.col("_part"), F.col("_hi") * F.col("_part"))).drop("_k", "_at", "_lo", "_hi", "_part")


def in_margin(page_height: float, zone: float = 0.08) -> Column:
    """The margin a line stands in: top by a line more than the zone, bottom, or null."""
    return F.when(F.col("y") <= zone * page_height + F.col("size"), "top").when(F.col("y") >= (1 - zone) * page_height, "bottom")


def repeating_margin_lines(lines: DataFrame, page_height: float, ranges: DataFrame | None = None, zone: float = 0.08, share: float = 0.25) -> DataFrame:
    """Shapes of margin lines that stand on two pages at least and on a quarter of all pages, or of one chapter's pages.

    ranges hold doc_id, start and end of chapters in pages; without them a document is one. Returns doc_id, zone, pattern
    and the number of pages.
    """
    margin = lines.withColumn("zone", in_margin(page_height, zone)).where("zone is not null").select("doc_id", "zone", T.header_pattern(F.col("text")).alias("pattern"), "page").where("pattern <> ''").distinct()
    total = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("all_pages"))
    n = margin.groupBy("doc_id", "zone", "pattern").agg(F.count("*").alias("pages")).where("pages >= 2").join(total, "doc_id")
    whole = F.col("pages") >= share * F.col("all_pages")
    if ranges is None:
        return n.where(whole).drop("all_pages")
    inside = margin.join(ranges.select("doc_id", "start", "end"), "doc_id").where("page between start and end").groupBy("doc_id", "zone", "pattern", "start", "end").agg(F.count("*").alias("k"))
    often = inside.where((F.col("k") >= 2) & (F.col("k") >= F.ceil((F.col("end") - F.col("start") + 1) * share))).select("doc_id", "zone", "pattern").distinct().withColumn("_often", F.lit(True))
    return n.join(often, ["doc_id", "zone", "pattern"], "left").where(whole | F.col("_often")).drop("all_pages", "_often")


# Fixed value: what a lone page number looks like.
LONE_NUMBER = r"(?i)^(?:page\s+)?[-–—\s]*(?:\d{1,4}|[ivxlcdm]{1,7})[-–—\s]*$"


def remove_headers_footers(lines: DataFrame, page_height: float, titles: DataFrame | None = None, ranges: DataFrame | None = None, zone: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Lines without running heads and lone page numbers, and the printed number of each page that had one.

    A margin line goes when it is a page number, when its shape repeats (repeating_margin_lines), or when it is small and
    repeats a title (doc_id, title) or a large line of its document. Dropped heads may carry the page's number at an end.
    """
    from vellumspark.operators.joins import running_title_lines

    body = weighted_mode(lines.withColumn("_n", F.char_length("text")).withColumn("_o", F.col("page") * 100000 + F.col("y")), ["doc_id"], "size", "_n", "_o").withColumnRenamed("mode", "_body")
    marked = lines.join(body, "doc_id").withColumns({"zone": in_margin(page_height, zone), "pattern": T.header_pattern(F.col("text")), "_row": F.struct("page", "y", "x0")})
    large = marked.where((F.col("size") >= 1.3 * F.col("_body")) & (F.char_length(F.trim("text")) > 2)).select("doc_id", F.col("text").alias("title"))
    known = large if titles is None else titles.where(F.char_length(F.trim("title")) > 2).select("doc_id", "title").union(large)
    margin = marked.where("zone is not null")
    heads = running_title_lines(margin.withColumn("ord", F.col("_row")), known.distinct().withColumn("rid", F.xxhash64("title")), page_height, F.col("_body"), zone=None)
    heads = heads.select("doc_id", "_row").distinct().withColumn("_head", F.lit(True))
    repeating = repeating_margin_lines(lines, page_height, ranges, zone).select("doc_id", "zone", "pattern").withColumn("_again", F.lit(True))
    number = F.col("text").rlike(LONE_NUMBER)
    judged = margin.join(repeating, ["doc_id", "zone", "pattern"], "left").join(heads, ["doc_id", "_row"], "left")
    judged = judged.withColumn("_lone", number).withColumn("_drop", number | F.coalesce("_again", "_head", F.lit(False)))
    kept = marked.where("zone is null").select(*lines.columns).unionByName(judged.where("not _drop").select(*lines.columns))
    alone = F.regexp_replace(F.regexp_replace("text", r"(?i)^page\s+", ""), r"[-–—\s]", "")
    beside = F.regexp_extract(F.trim("text"), r"^(\d{1,4})\s|\s(\d{1,4})$", 0)
    found = judged.where("_drop").withColumn("_p", F.lower(F.when(F.col("_lone"), alone).otherwise(F.trim(beside)))).where("_p <> ''")
    return kept, found.groupBy("doc_id", "page").agg(F.max_by("_p", F.struct(F.col("_lone"), "y")).alias("printed"))


def length_outliers(pairs: DataFrame, by: list[str], threshold: float = 3.5, min_chars: int = 40, least: int = 5) -> DataFrame:
    """Pairs whose log length ratio lies far from their group's median, in robust deviations."""
    r = pairs.where(F.char_length("src") >= min_chars).where(F.char_length("tgt") > 0).withColumn("ratio", F.ln(F.char_length("tgt") / F.char_length("src")))
    med = r.groupBy(*by).agg(F.median("ratio").alias("med"), F.count("*").alias("n")).where(F.col("n") >= least)
    dev = r.join(med, by).withColumn("dev", F.abs(F.col("ratio") - F.col("med")))
    mad = dev.groupBy(*by).agg(F.median("dev").alias("mad")).withColumn("mad", F.when(F.col("mad") == 0, 0.05).otherwise(F.col("mad")))
    return dev.join(mad, by).withColumn("z", 0.6745 * F.col("dev") / F.col("mad")).where(F.col("z") > threshold).drop("med", "n", "dev", "mad")


def style_share(runs: DataFrame, by: list[str]) -> DataFrame:
    """Whether over 80 % of a line's characters, superscripts aside, are bold, italic or monospaced."""
    n = F.char_length("text")
    body = runs.where("not superscript")
    share = lambda c: (F.sum(F.when(F.col(c), n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1)) > 0.8).alias(c)
    return body.groupBy(*by).agg(share("bold"), share("italic"), share("mono"))


def repeated_phrases(texts: DataFrame, key: str, col: str) -> DataFrame:
    """First phrase said back to back: one word four times or two to six words three times; shortest, then earliest.

    A row a text that has one; texts are judged in place, so no word is shuffled.
    """
    return texts.select(key, T.repeated_phrase(F.col(col)).alias("phrase")).where("phrase is not null")


def script_share(texts: DataFrame, key: str, col: str, language: str) -> DataFrame:
    """Letters of the language's script and Latin letters in prose, and whether the first are too few."""
    script = lang.SCRIPTS[language]
    prose = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(col), r"`[^`]+`", " "), T.URL, " "), r"\([^()]*\)", " ")
    r = texts.select(key, F.regexp_count(prose, F.lit(f"[\\p{{{script}}}&&\\p{{L}}]")).alias("target"), F.regexp_count(prose, F.lit(r"\p{IsLatin}")).alias("latin"))
    return r.withColumn("issue", (F.col("target") + F.col("latin") >= 3) & (F.col("target") < 0.5 * (F.col("target") + F.col("latin"))))


def usage_totals(usage: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return usage.groupBy(*by).agg(*(F.sum(c).alias(c) for c in cols))


def reading_ratio(progress: DataFrame, readable: int | DataFrame, user: str, node: str) -> DataFrame:
    """Share of the readable nodes that each user has read."""
    return progress.groupBy(user).agg((F.count_distinct(node) / F.greatest(F.lit(readable), F.lit(1))).alias("ratio"))


def quiz_score(answers: DataFrame, questions: DataFrame, by: str) -> DataFrame:
    """Right answers among those that can be checked; short answers do not count."""
    j = answers.join(questions.where("kind <> 'short'"), "question_id")
    return j.groupBy(by).agg(F.count("*").alias("checked"), F.count_if(F.col("answer") == F.col("solution")).alias("correct"))
