"""Filters and predicates over nodes, segments, translations and positioned items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import lang

# Node kinds that hold text.
READABLE = ("front", "chapter_intro", "section", "subsection", "back")
TERMINAL = r"[.!?…:;؟۔»\"”')\]]\s*$"
TRAILING_REFS = r"(?:\s*\[\^[^\]]+\])+\s*$"


def readable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are not skipped and hold text, chapters and parts only when they have no children."""
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    n = nodes.join(parents, "node_id", "left")
    whole = F.col("kind").isin("chapter", "part") & F.col("has_children").isNull()
    return n.where(~F.col("skip") & (F.col("kind").isin(*READABLE) | whole)).drop("has_children")


def translatable_segments(segments: DataFrame) -> DataFrame:
    """Segments marked translatable whose type has a short code, with that code."""
    codes = F.create_map(*(F.lit(x) for kv in lang.TYPE_CODES.items() for x in kv))
    return segments.where("translatable").withColumn("code", codes[F.col("type")]).where("code is not null")


def visible_text(translations: DataFrame) -> DataFrame:
    return translations.where(F.col("status").isin(*lang.VISIBLE)).withColumn("text", F.coalesce("final", "draft"))


def approved_terms(terms: DataFrame, language: str) -> DataFrame:
    return terms.where((F.col("lang") == language) & (F.col("status") != "proposed"))


def scanned_pages(pages: DataFrame, lines: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with under 30 characters of text and images over half of their area."""
    text = lines.groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("chars"))
    area = images.groupBy("doc_id", "page").agg(F.sum(F.col("width") * F.col("height")).alias("area"))
    p = pages.join(text, ["doc_id", "page"], "left").join(area, ["doc_id", "page"], "left")
    return p.where((F.coalesce("chars", F.lit(0)) < 30) & (F.coalesce("area", F.lit(0)) >= 0.5 * F.col("width") * F.col("height"))).select("doc_id", "page")


def empty_pages(pages: DataFrame, lines: DataFrame, least: int = 20) -> DataFrame:
    text = lines.groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("chars"))
    return pages.join(text, ["doc_id", "page"], "left").where(F.coalesce("chars", F.lit(0)) < least).select("doc_id", "page")


def clean_recognised_words(words: DataFrame, scale: float = 3.0) -> DataFrame:
    """Recognised words as positioned items in points; unsure ones only when they hold a letter or digit."""
    kept = words.where((F.col("confidence") >= 20) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    ascent = F.col("baseline") - F.col("line_top")
    size = F.greatest(F.floor(2 * (ascent / scale) / 0.72 + 0.5) / 2, F.lit(4.0))
    return kept.select("text", (F.col("x0") / scale).alias("x"), (F.col("baseline") / scale).alias("y"), ((F.col("x1") - F.col("x0")) / scale).alias("width"), size.alias("size"))


def upright_items(items: DataFrame) -> DataFrame:
    """Items whose transform (a, b, c, d) does not turn them, with their size."""
    return items.where("abs(b) <= 0.01 and abs(c) <= 0.01").withColumn("size", F.hypot("c", "d"))


def large_images(images: DataFrame, least: float = 30.0) -> DataFrame:
    return images.where((F.col("width") > least) & (F.col("height") > least))


def lacks_ending(text: Column) -> Column:
    """Whether a text stops without terminal punctuation, footnote references aside."""
    return ~F.regexp_replace(text, TRAILING_REFS, "").rlike(TERMINAL)


def suspected_breaks(segments: DataFrame) -> DataFrame:
    return segments.where((F.col("type") == "paragraph") & ~F.col("skip") & lacks_ending(F.col("text")))


def runnable(items: DataFrame, **equals) -> DataFrame:
    """Queued items that match every given column value; None is no condition."""
    out = items.where("status = 'queued'")
    for name, value in equals.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def extraction_warnings(report: DataFrame) -> DataFrame:
    """One row a rule that holds for a document: doc_id, rule, pages (at most 50)."""
    rule = lambda holds, name, pages: F.when(holds, F.struct(F.lit(name).alias("rule"), pages.cast("array<int>").alias("pages")))
    r = F.array_compact(
        F.array(
            rule(F.size("ocr_pages") > 0, "ocr_used", F.slice("ocr_pages", 1, 50)),
            rule(F.size("empty_pages") > 0, "no_text", F.slice("empty_pages", 1, 50)),
            rule(~F.col("from_outline"), "not_from_outline", F.array()),
            rule(F.col("break_ratio") > 0.01, "breaks", F.slice("break_pages", 1, 50)),
        )
    )
    return report.select("doc_id", F.explode(r).alias("w")).select("doc_id", "w.rule", "w.pages")


def review_queue(translations: DataFrame, segments: DataFrame, nodes: DataFrame, changes: DataFrame, mode: str = "flagged") -> DataFrame:
    """Translations to look at, in document order, with the last engine change: flagged ones, or all with flags or a suggestion.

    segments place a translation (segment_id, node_id, ord) in the tree of nodes; changes hold segment_id, change and at.
    """
    from vellumspark.operators.tree import with_paths

    wanted = F.col("status") == "flagged"
    if mode == "all":
        wanted = wanted | (F.size("flags") > 0) | F.col("suggestion").isNotNull()
    last = changes.groupBy("segment_id").agg(F.max_by("change", "at").alias("last_change"))
    placed = segments.join(with_paths(nodes).select("node_id", "path"), "node_id")
    return translations.where(wanted).join(placed, "segment_id").join(last, "segment_id", "left").orderBy("path", "ord")
