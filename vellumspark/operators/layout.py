"""Layout of positioned text: lines, reading order, paragraphs, merging, structure."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.functions import text as T
from vellumspark.operators import aggregates as G
from vellumspark.operators.filters import TERMINAL, TRAILING_REFS, lacks_ending
from vellumspark.staging import staged

# List markers, captions and footnote starts.
MARKER = r"^\s*(?:[•◦▪●○■□–—*·]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)])\s+"
CAPTION = r"(?i)^(?:figure|fig\.|table|exhibit|chart|plate)\s+[\dIVX]+(?:[.:-]\d+)*"
FOOTNOTE = r"^(?:\d{1,3}|[*†‡§])\s*"
HYPHEN = r"[A-Za-z]-\s*$"
WORD_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
FRONT = r"^(?:preface|foreword|acknowledg\w*|contents|table of contents|dedication|copyright|about the authors?|introduction|prologue|title page|cover)\b"
BACK = r"^(?:appendix|appendices|index|glossary|bibliography|references|notes|endnotes|answers|afterword|epilogue|credits)\b"


def group_baselines(items: DataFrame) -> DataFrame:
    """Items with the line they stand on: baselines within 0.3 of the size are one line, a wide gap starts another.

    Lines are islands over sorted baselines, pieces of a line islands over the running right edge; a page is a partition.
    """
    page = ["doc_id", "page"]
    w = Window.partitionBy(*page).orderBy("y", "x")
    new = F.coalesce(F.col("y") - F.lag("y").over(w) > 0.3 * F.greatest("size", F.lag("size").over(w)), F.lit(True))
    rows = items.where("text <> ''").withColumn("_r", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(*page, "_r").orderBy("x")
    edge = F.max(F.col("x") + F.col("width")).over(v.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("x") - edge > 1.8 * F.greatest("size", F.lit(6.0))) & (F.trim("text") != "")
    cut = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_g", cut).withColumn("line_id", F.dense_rank().over(Window.partitionBy(*page).orderBy("_r", "_g"))).drop("_r", "_g")


def build_lines(items: DataFrame) -> DataFrame:
    """Lines from items with a line_id: text with spaces at gaps, box, dominant size and baseline, superscripts marked.

    The size with most characters rules; smaller raised items are superscripts and join without a space. A line is one
    row of its few items, grouped once.
    """
    key = ["doc_id", "page", "line_id"]
    g = items.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("x", "text", "width", "size", "y"))).alias("runs"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"))
    step_of = lambda r: F.floor(r["size"] / 0.5 + 0.5) * 0.5

    def weight(s: Column) -> Column:
        same = F.filter("runs", lambda r: step_of(r) == s)
        return F.struct(F.aggregate(same, F.lit(0), lambda a, r: a + F.char_length(r["text"])).alias("w"), (-same[0]["x"]).alias("p"), s.alias("s"))

    sizes = F.array_distinct(F.transform("runs", step_of))
    g = g.withColumn("size", F.array_max(F.transform(sizes, weight))["s"])
    g = g.withColumn("y", F.get(F.filter("runs", lambda r: F.abs(r["size"] - F.col("size")) <= 0.25), F.lit(0))["y"])
    raised = lambda r: (r["size"] < 0.85 * F.col("size")) & (r["y"] < F.col("y"))
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("e"))

    def step(a, r):
        space = (r["x"] - a["e"] > 0.15 * F.col("size")) & ~raised(r) & ~a["t"].endswith(" ") & ~r["text"].startswith(" ")
        return F.struct(F.concat(a["t"], F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), r["text"]).alias("t"), (r["x"] + r["width"]).alias("e"))

    return g.withColumn("text", F.trim(F.aggregate("runs", start, step, lambda a: a["t"]))).withColumn("superscripts", F.size(F.filter("runs", raised))).drop("runs")


def reading_order(lines: DataFrame, rtl: bool = False) -> DataFrame:
    """Lines with column and position: two columns where each side holds a quarter of at least six lines of a page.

    Lines over both columns split a page into regions; a region reads one column, then the other.
    """
    page = Window.partitionBy("doc_id", "page")
    left, right, n = F.min("x0").over(page), F.max("x1").over(page), F.count("*").over(page)
    mid, gutter = (left + right) / 2, (right - left) * 0.02
    r = lines.withColumn("_l", F.col("x1") <= mid + gutter).withColumn("_r", F.col("x0") >= mid - gutter).withColumn("_n", n)
    two = (F.col("_n") >= 6) & (F.sum(F.col("_l").cast("int")).over(page) >= 0.25 * F.col("_n")) & (F.sum(F.col("_r").cast("int")).over(page) >= 0.25 * F.col("_n"))
    r = r.withColumn("_two", two)
    span = F.col("_two") & ~F.col("_l") & ~F.col("_r")
    by_y = page.orderBy("y", "x0")
    first = F.col("_r") if rtl else F.col("_l")
    column = F.when(~F.col("_two") | span, 0).when(first, 1).otherwise(2)
    # A spanning line closes the region before it: regions alternate with spanning lines.
    before = F.coalesce(F.sum(span.cast("int")).over(by_y.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    region = 2 * before + span.cast("int")
    r = r.withColumn("_g", region).withColumn("column", column)
    return r.withColumn("pos", F.row_number().over(page.orderBy("_g", "column", "y", "x0"))).drop("_l", "_r", "_n", "_two", "_g")


def document_stats(lines: DataFrame) -> DataFrame:
    """Body size, median line gap between 0.8 and 2.2 body sizes: one row a document."""
    weighted = lines.withColumn("_n", F.char_length("text")).withColumn("_p", F.struct("page", "y"))
    body = G.weighted_mode(weighted.withColumn("_o", F.col("page") * 100000 + F.col("y")), ["doc_id"], "size", "_n", "_o").withColumnRenamed("mode", "body_size")
    w = Window.partitionBy("doc_id", "page").orderBy("y")
    b = lines.join(body, "doc_id").where("abs(size - body_size) < 0.6").withColumn("gap", F.col("y") - F.lag("y").over(w)).where("gap > body_size * 0.8 and gap < body_size * 2.2")
    gap = G.nearest_rank_percentile(b, ["doc_id"], "gap", 0.5).withColumnRenamed("value", "gap")
    return body.join(gap, "doc_id", "left").select("doc_id", "body_size", F.coalesce("gap", F.col("body_size") * 1.25).alias("line_gap"))


def paragraph_blocks(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """Lines with the block they belong to, numbered per page in reading order.

    A block starts at a new column, a wide or negative gap, another size, weight or spacing, a list marker, a first-line
    indent, or after a sentence end with room left on the line. A line that hangs under a list item stays with it.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    column = ["doc_id", "page", "column"]
    r = G.with_percentile(G.with_percentile(lines.join(stats, "doc_id"), column, "x0", 0.1, "_el"), column, "x1", 0.9, "_er")
    prev = lambda c: F.lag(c).over(page)
    expected = F.when(F.abs(prev("size") - F.col("body_size")) < 0.6, F.col("line_gap")).otherwise(prev("size") * 1.2)
    gap = F.col("y") - prev("y")
    marker = F.col("text").rlike(MARKER) & ~F.col("mono")
    bold = (F.col("bold") != prev("bold")) & F.when(F.col("bold"), F.char_length("text") < 90).otherwise(F.char_length(prev("text")) < 90) & ~F.col("mono")
    indent = F.col("x0") - F.col("_el")
    deeper = ~F.col("mono") & (indent > F.col("size") * 0.6) & (prev("x0") - F.col("_el") < F.col("size") * 0.3)
    word = F.char_length(F.regexp_extract("text", r"^\S+", 0)) * F.col("size") * 0.5
    room = ~F.col("mono") & ~lacks_ending(prev("text")) & (F.col("_er") - prev("x1") > word + F.col("size") * 0.5)
    hard = (F.col("column") != prev("column")) | (gap > expected * 1.35) | (gap < 0) | (F.abs(F.col("size") - prev("size")) > 0.6) | (F.col("mono") != prev("mono")) | bold | marker
    r = r.withColumn("_hard", F.coalesce(hard, F.lit(True))).withColumn("_soft", F.coalesce(deeper | room, F.lit(False))).withColumn("_marker", marker)
    # A hanging line is judged against the head of its block: heads are known from hard breaks and markers alone.
    head = F.sum(F.col("_hard").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("_h", head)
    hw = Window.partitionBy("doc_id", "page", "_h").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    text_x = F.first(F.col("x0") + F.char_length(F.regexp_extract("text", MARKER, 0)) * F.col("size") * 0.5).over(hw)
    hanging = F.first("_marker").over(hw) & (indent > F.col("size") * 0.3) & (F.abs(F.col("x0") - text_x) < F.col("size"))
    new = F.col("_hard") | (F.col("_soft") & ~hanging)
    return r.withColumn("_new", new).withColumn("block", F.sum(F.col("_new").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0))).drop("_el", "_er", "_hard", "_soft", "_marker", "_h", "_new")


def join_block_text(lines: DataFrame) -> DataFrame:
    """Text of every block: lines in order, line-end hyphens before a small letter taken out."""
    g = lines.groupBy("doc_id", "page", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("l"), F.max("size").alias("size"), F.min("y").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("column").alias("column"),
        F.bool_and("bold").alias("bold"), F.bool_and("mono").alias("mono"), F.count("*").alias("n_lines"),
    )
    return g.withColumn("text", F.aggregate("l", F.lit(""), lambda a, x: join_texts(a, x["text"]))).withColumn("hyphens", hyphen_joins("l.text")).drop("l")


def hyphen_joins(texts: str) -> Column:
    """How many of the texts are joined to the one before by taking out its hyphen."""
    full = F.filter(texts, lambda x: F.trim(x) != "")
    joins = F.zip_with(F.slice(full, F.lit(1), F.size(full) - 1), F.slice(full, F.lit(2), F.size(full)), lambda a, b: F.rtrim(a).rlike(HYPHEN) & F.ltrim(b).rlike("^[a-z]"))
    return F.when(F.size(full) > 1, F.size(F.filter(joins, lambda j: j))).otherwise(0)


def join_texts(a: Column, b: Column) -> Column:
    left, right = F.rtrim(a), F.ltrim(b)
    hyphen = left.rlike(HYPHEN) & right.rlike("^[a-z]")
    return F.when(left == "", right).when(hyphen, F.concat(F.substring(left, F.lit(1), F.char_length(left) - 1), right)).otherwise(F.concat(left, F.lit(" "), right))


def merge_continuations(blocks: DataFrame, key: list[str], order: str) -> DataFrame:
    """Blocks joined to a successor that carries their sentence on: key, first order, type, text, parts.

    A successor continues when it is an unindented paragraph without list marker and the block before it, of a type that
    can go on, lacks an ending or breaks off in a hyphen. Whether a block ends depends only on its last part, so break
    flags from neighbours and a running sum find the groups.
    """
    w = Window.partitionBy(*key).orderBy(order)
    can = F.lag("type").over(w).isin("paragraph", "list_item", "quote", "footnote")
    open_ = lacks_ending(F.lag("text").over(w)) | F.rtrim(F.lag("text").over(w)).rlike(HYPHEN)
    goes_on = can & (F.col("type") == "paragraph") & (F.coalesce(F.col("indent"), F.lit(0.0)) <= 0.5) & ~F.col("text").rlike(MARKER) & open_
    # A merged part is a paragraph that joined a block able to go on, so the chain keeps its first type.
    g = blocks.withColumn("_g", F.sum(F.coalesce(~goes_on, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = g.groupBy(*key, "_g").agg(F.sort_array(F.collect_list(F.struct(order, "type", "text"))).alias("p"))
    return parts.select(*key, F.col("p")[0][order].alias(order), F.col("p")[0]["type"].alias("type"), F.aggregate("p", F.lit(""), lambda a, x: join_texts(a, x["text"])).alias("text"), F.size("p").alias("parts"))


def merge_across_pages(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """As merge_continuations, but only over page and column breaks and past footnotes, figures and captions.

    What each block is by itself (ended, marker, head of a kind) is worked out in place. What a merged block may take next
    depends on its head, so a document's flags, not its texts, pass in order through one step that numbers the groups; the
    texts of a group then join in order.
    """
    body = blocks.where("type not in ('footnote', 'figure', 'caption')")
    plain = F.rtrim(T.strip_markup(F.col("text")))
    ended = ~(plain.rlike(r"\p{L}[-‐]$") | ~F.regexp_replace(plain, TRAILING_REFS, "").rlike(TERMINAL))
    flags = body.select(key, order, "type", "page", "column", "size", "x0", "indent", "text_x", ended.alias("ended"), F.col("text").rlike(MARKER).alias("marker"))
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in (key, order))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, group, head, last = None, 0, None, None
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if b[key] != doc:
                    doc, group, head, last = b[key], 0, None, None
                goes_on = False
                if head is not None and (b["page"], b["column"]) != (last["page"], last["column"]) and not last["ended"] and not b["marker"]:
                    hanging = head["type"] == "list_item" and head["text_x"] is not None and abs(b["x0"] - head["text_x"]) < 1.2 * b["size"]
                    able = head["type"] in ("paragraph", "list_item", "quote") and (b["type"] == "paragraph" or b["type"] == "quote" and head["type"] in ("quote", "list_item"))
                    indented = b["indent"] > 0.5 * b["size"] and not hanging and b["type"] != "quote"
                    goes_on = able and not indented and abs(head["size"] - b["size"]) <= 0.6
                if not goes_on:
                    group, head = group + 1, b
                last = b
                out.append(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=[key, order, "_g"])

    numbered = flags.repartition(key).sortWithinPartitions(key, order).mapInArrow(grouped, f"{kinds}, _g int")
    parts = body.join(numbered, [key, order]).groupBy(key, "_g").agg(F.sort_array(F.collect_list(F.struct(order, "type", "text"))).alias("p"))
    return parts.select(key, F.col("p")[0][order].alias(order), F.col("p")[0]["type"].alias("type"), F.aggregate("p", F.lit(""), lambda a, x: join_texts(a, x["text"])).alias("text"), F.size("p").alias("parts"), hyphen_joins("p.text").alias("hyphens"))


def classify_blocks(blocks: DataFrame, page_height: float = 600.0) -> DataFrame:
    """Type of every block by size, weight, place and wording, with caption, footnote and list details."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    small, big = F.col("size") <= F.col("body_size") * 0.92, F.col("size") >= F.col("body_size") * 1.15
    short_bold = F.col("bold") & (F.col("n_lines") <= 3) & (words <= 16) & ~F.trim("text").rlike("[.,;]$")
    quote = (F.col("x0") >= F.col("edge_left") + F.col("body_size") * F.when(F.col("n_lines") > 1, 1.2).otherwise(2.5)) & ((F.col("n_lines") == 1) | (F.col("x1") <= F.col("edge_right") - F.col("body_size") * 1.2)) & (words > 3)
    kind = (
        F.when(F.col("mono"), "code").when(F.col("text").rlike(CAPTION) & (words < 80), "caption").when(small & (F.col("y") > page_height * 0.6) & F.col("text").rlike(FOOTNOTE), "footnote")
        .when((big & (words <= 30)) | short_bold, "heading").when(F.col("text").rlike(MARKER) & (words > 1), "list_item").when(quote, "quote").otherwise("paragraph")
    )
    b = blocks.withColumn("type", kind)
    level = F.when(F.col("type") == "list_item", F.greatest(F.lit(0), F.floor((F.col("x0") - F.col("edge_left")) / (F.col("size") * 1.5) + 0.5).cast("int")))
    return b.withColumn("level", level).withColumn("figure_id", F.when(F.col("type") == "caption", F.regexp_extract("text", r"[\dIVX]+(?:[.:-]\d+)*", 0))).withColumn("footnote_id", F.when(F.col("type") == "footnote", F.trim(F.regexp_extract("text", FOOTNOTE, 0))))


def classify_titles(entries: DataFrame, doc: str, pos: str) -> DataFrame:
    """Kind of every outline entry: front and back matter by wording and place, else part, chapter, section by depth."""
    title = F.lower(F.trim("title"))
    front, back = title.rlike(FRONT), title.rlike(BACK)
    e = entries.withColumn("_body", ~front & ~back)
    w = Window.partitionBy(doc)
    lo, hi = F.min(F.when(F.col("_body"), F.col(pos))).over(w), F.max(F.when(F.col("_body"), F.col(pos))).over(w)
    kind = F.when(front & (F.col(pos) < F.coalesce(lo, F.lit(1 << 30))), "front").when(back & (F.col(pos) > F.coalesce(hi, F.lit(-1))), "back").when(title.rlike(r"^part\b"), "part").when(F.col("depth") == 0, "chapter").when(F.col("depth") == 1, "section").otherwise("subsection")
    skip = title.rlike(r"^(?:contents|table of contents|index|copyright|title page|cover)\b")
    return e.withColumn("kind", kind).withColumn("skip", skip).drop("_body")


def chapter_label(titles: DataFrame) -> DataFrame:
    """Number and rest of a chapter title; number words become digits."""
    words = F.create_map(*(F.lit(x) for k, w in enumerate(WORD_NUMBERS) for x in (w, str(k + 1))))
    named = F.regexp_extract("title", r"(?i)^\s*(?:chapter|part|section)\s+([0-9]+|[ivxlc]+|" + "|".join(WORD_NUMBERS) + r")\b[\s.:–—-]*(.*)$", 1)
    rest = F.regexp_extract("title", r"(?i)^\s*(?:chapter|part|section)\s+(?:[0-9]+|[ivxlc]+|" + "|".join(WORD_NUMBERS) + r")\b[\s.:–—-]*(.*)$", 1)
    lead, tail = F.regexp_extract("title", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+(.*)$", 1), F.regexp_extract("title", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+(.*)$", 2)
    number = F.when(named != "", F.coalesce(F.try_element_at(words, F.lower(named)), named)).when(lead != "", lead)
    return titles.withColumn("number", number).withColumn("rest", F.when(named != "", rest).when(lead != "", tail).otherwise(F.col("title")))


def parse_contents_lines(lines: DataFrame) -> DataFrame:
    """Entries of contents pages: title, printed label and depth by indent."""
    p = r"^\s*(.*?\S)\s*(?:\.\s*){2,}\s*([0-9]{1,4}|[ivxlc]{1,6})\s*$|^\s*(.*?\S)\s{2,}([0-9]{1,4}|[ivxlc]{1,6})\s*$"
    get = lambda k: F.regexp_extract("text", p, k)
    e = lines.withColumn("title", F.when(get(1) != "", get(1)).otherwise(get(3))).withColumn("label", F.when(get(2) != "", get(2)).otherwise(get(4))).where("title <> '' and label <> ''")
    least = F.min("x0").over(Window.partitionBy("doc_id"))
    return e.withColumn("depth", F.least(F.lit(3), F.floor((F.col("x0") - least) / 12 + 0.5).cast("int"))).select("doc_id", "page", "y", "title", "label", "depth")


def render_block_text(runs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Inline markup of blocks from styled runs (text, bold, italic, sup): emphasis only where not the whole block has it."""
    n = F.char_length("text")
    share = G.style_share(runs.withColumn("superscript", F.col("sup")).withColumn("mono", F.lit(False)), key).select(*key, F.col("bold").alias("_b"), F.col("italic").alias("_i"))
    r = runs.where(n > 0).join(share, key)
    safe = F.regexp_replace("text", r"([*`])", r"\\$1")
    body, lead, trail = F.trim(safe), F.regexp_extract("text", r"^\s*", 0), F.regexp_extract("text", r"\s*$", 0)
    mark = F.when(F.col("bold") & ~F.col("_b"), "**").when(F.col("italic") & ~F.col("_i"), "*").otherwise("")
    piece = F.when(F.col("sup") & F.col("text").rlike(r"^\s*\d{1,3}\s*$"), F.concat(F.lit("[^"), F.trim("text"), F.lit("]"))).when(body == "", F.col("text")).otherwise(F.concat(lead, mark, body, mark, trail))
    g = r.withColumn("piece", piece).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "piece"))).alias("p"))
    return g.select(*key, F.regexp_replace(F.array_join(F.transform("p", lambda x: x["piece"]), ""), r"\*\*\*\*", "").alias("text"))


def infer_page_labels(pages: DataFrame, printed: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """Label of every page: supplied ones, else numbers by the most voted offset of printed ones, else 1 on.

    Pages before the numbered part keep a printed label or count in roman numerals.
    """
    n = printed.where(F.col("printed").rlike(r"^\d+$")).withColumn("off", F.col("printed").cast("int") - F.col("page"))
    votes = n.groupBy("doc_id", "off").agg(F.count("*").alias("v")).where("v >= 2")
    best = votes.groupBy("doc_id").agg(F.max_by("off", F.struct("v", (-F.col("off")).alias("o"))).alias("off"))
    r = pages.join(best, "doc_id", "left").join(printed, ["doc_id", "page"], "left")
    k = F.col("page") + 1

    def places(one: str, five: str, ten: str, unit: int) -> Column:
        forms = ("", one, 2 * one, 3 * one, one + five, five, five + one, five + 2 * one, five + 3 * one, one + ten)
        return F.array(*map(F.lit, forms))[(F.floor(k / unit) % 10).cast("int")]

    roman = F.concat(F.repeat(F.lit("m"), F.floor(k / 1000).cast("int")), places("c", "d", "m", 100), places("x", "l", "c", 10), places("i", "v", "x", 1))
    number = F.col("page") + F.col("off")
    label = F.when(F.col("off").isNull(), k.cast("string")).when(number >= 1, number.cast("string")).otherwise(F.coalesce("printed", roman))
    out = r.select("doc_id", "page", label.alias("label"))
    if supplied is None:
        return out
    return out.join(supplied.withColumnRenamed("label", "_l"), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("_l", "label").alias("label"))


def build_structure(blocks: DataFrame, entries: DataFrame | None = None, depth: str = "level") -> tuple[DataFrame, DataFrame]:
    """Nodes and segments of documents from blocks (doc_id, ord, type, level, text).

    entries (doc_id, ord, depth, title) say where nodes begin, from an outline or a contents page; a document without any
    takes its headings, by level. Every entry opens a node under the nearest earlier one of smaller depth. Text before the
    first entry belongs to a front node; text of a node before its first child, where both are there, to an intro node
    before that child. Footnotes come last in their node; a heading at its entry is the first segment of its own node.
    """
    from vellumspark.operators.windows import assign_to_cut, parent_from_depth
    from vellumspark.sources.tables import content_hash

    heads = blocks.where("type = 'heading'").select("doc_id", "ord", F.coalesce(depth, F.lit(1)).alias("depth"), F.col("text").alias("title"))
    if entries is not None:
        given = entries.select("doc_id", "ord", F.col("depth").cast(heads.schema["depth"].dataType), "title")
        heads = given.unionByName(heads.join(given.select("doc_id").distinct(), "doc_id", "left_anti"))
    tree = parent_from_depth(heads, "doc_id", "ord", "depth")
    node_id = lambda *parts: content_hash(F.concat_ws("|", F.col("doc_id").cast("string"), *(p.cast("string") for p in parts)))
    nodes = tree.select("doc_id", node_id(F.col("ord")).alias("node_id"), F.when(F.col("parent_pos").isNotNull(), node_id(F.col("parent_pos"))).alias("parent_id"), F.col("ord").alias("pos"), "depth", "title", F.lit("section").alias("kind"))
    placed = assign_to_cut(blocks, heads.select("doc_id", "ord", F.col("ord").alias("cut")), "doc_id", "ord").withColumn("_key", F.coalesce("node_key", F.lit(-1)))
    front = placed.where("node_key is null").select("doc_id").distinct().select("doc_id", node_id(F.lit(-1)).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(-1).alias("pos"), F.lit(1).alias("depth"), F.lit("").alias("title"), F.lit("front").alias("kind"))
    # A node with children and text of its own: that text gets a node of its own, first among the children.
    parents = tree.where("parent_pos is not null").select("doc_id", F.col("parent_pos").alias("_key")).distinct().withColumn("_parent", F.lit(True))
    own = placed.join(parents, ["doc_id", "_key"], "left").withColumn("_intro", F.coalesce("_parent", F.lit(False)) & (F.col("ord") != F.col("_key")) & (F.col("type") != "footnote"))
    w = Window.partitionBy("doc_id", "node_id").orderBy((F.col("type") == "footnote").cast("int"), "ord")
    segments = own.withColumn("node_id", F.when(F.col("_intro"), node_id(F.col("_key"), F.lit("intro"))).otherwise(node_id(F.col("_key"))))
    segments = segments.withColumn("seq", F.row_number().over(w) - 1).select("doc_id", "node_id", "seq", "type", "text", content_hash(F.col("text")).alias("src_hash"), "ord")
    intro = own.where("_intro").select("doc_id", "_key").distinct().join(tree.select("doc_id", F.col("ord").alias("_key"), "depth"), ["doc_id", "_key"])
    intro = intro.select("doc_id", node_id(F.col("_key"), F.lit("intro")).alias("node_id"), node_id(F.col("_key")).alias("parent_id"), F.col("_key").alias("pos"), (F.col("depth") + 1).alias("depth"), F.lit("").alias("title"), F.lit("intro").alias("kind"))
    return nodes.unionByName(front).unionByName(intro), segments


class Layout(NamedTuple):
    """What layout_pipeline finds: merged blocks, page labels, nodes, segments, and one report row a document."""

    blocks: DataFrame
    labels: DataFrame
    nodes: DataFrame
    segments: DataFrame
    report: DataFrame


def layout_pipeline(items: DataFrame, page_height: float = 600.0, outline: DataFrame | None = None) -> Layout:
    """Text items to typed, merged blocks, page labels, structure and report.

    outline holds doc_id, lid, title, page and depth; entries are found again among the blocks (similar_titles), and where
    that fails begin at the first block of their page. A document is dealt to one partition at the start, so that the windows
    of its pages and columns need no further shuffle. Lines, kept lines and blocks are written once each, as several later
    steps use them.
    """
    from vellumspark.operators.joins import first_block_after, similar_titles
    from vellumspark.operators.windows import chapter_ranges
    from vellumspark.plans.reports import extraction_report

    lines = staged(build_lines(group_baselines(items.repartition("doc_id"))).withColumn("bold", F.lit(False)).withColumn("mono", F.lit(False)), "lines")
    pages = lines.select("doc_id", "page").distinct()
    titles = ranges = None
    if outline is not None:
        titles, ranges = outline.select("doc_id", "title"), chapter_ranges(outline.where("depth = 1").select("doc_id", "page"), pages.groupBy("doc_id").agg((F.max("page") + 1).alias("page_count")))
    kept, printed = G.remove_headers_footers(lines, page_height, titles, ranges)
    kept = staged(kept, "kept-lines")
    stats = document_stats(kept)
    blocks = join_block_text(paragraph_blocks(reading_order(kept), stats))
    edges = kept.groupBy("doc_id").agg(F.percentile("x0", 0.1).alias("edge_left"), F.percentile("x1", 0.9).alias("edge_right"))
    typed = classify_blocks(blocks.join(stats.join(edges, "doc_id"), "doc_id"), page_height)
    typed = typed.withColumn("ord", F.col("page").cast("long") * 100000 + F.col("block")).withColumn("indent", F.greatest(F.col("x0") - F.col("edge_left"), F.lit(0.0))).withColumn("text_x", F.when(F.col("type") == "list_item", F.col("x0") + F.col("size")))
    typed = staged(typed.select("doc_id", "ord", "type", "level", "text", "page", "column", "size", "x0", "indent", "text_x", "hyphens"), "typed-blocks")
    aside = typed.where("type in ('footnote', 'figure', 'caption')").select("doc_id", "ord", "type", "text", F.lit(1).alias("parts"), F.lit(0).alias("hyphens"))
    merged = staged(merge_across_pages(typed, "doc_id", "ord").unionByName(aside), "blocks")
    entries = None
    if outline is not None:
        near = typed.select("doc_id", F.col("ord").alias("rid"), T.normalize_title(F.col("text")).alias("title"), "page", "type", F.regexp_count("text", F.lit(r"\S+")).alias("words"))
        matched = similar_titles(outline.select("doc_id", "lid", T.normalize_title(F.col("title")).alias("title"), "page"), near)
        starts = merged.select("doc_id", F.col("ord").alias("pos"), F.col("ord").alias("block"))
        asked = outline.join(matched, ["doc_id", "lid"], "left").select("doc_id", F.coalesce("rid", F.col("page").cast("long") * 100000).alias("pos"), F.col("lid").cast("string").alias("entry"))
        placed = first_block_after(asked, starts).where("block is not null")
        entries = placed.join(outline.withColumn("entry", F.col("lid").cast("string")), ["doc_id", "entry"]).groupBy("doc_id", F.col("block").alias("ord")).agg(F.min_by(F.struct("depth", "title"), "lid").alias("e")).select("doc_id", "ord", "e.*")
    nodes, segments = build_structure(merged.join(typed.select("doc_id", "ord", "level"), ["doc_id", "ord"], "left"), entries)
    report = extraction_report(merged, "doc_id", lines, kept, nodes, typed)
    return Layout(merged, infer_page_labels(pages, printed), nodes, segments, report)
