"""Joins between segments, translations, terms, batches and positioned text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from vellumspark.functions import lang
from vellumspark.functions import text as T
from vellumspark.staging import staged


def segment_text(translations: DataFrame, segments: DataFrame) -> DataFrame:
    shown = translations.where(F.col("status").isin(*lang.VISIBLE)).select("segment_id", F.coalesce("final", "draft").alias("tgt"))
    return shown.join(segments, "segment_id")


def counter_join(segments: DataFrame, nodes: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """Segments with their node and their translation in one language, if any."""
    return segments.join(nodes, "node_id").join(translations.where(F.col("lang") == language), "segment_id", "left")


def ready_items(items: DataFrame) -> DataFrame:
    """Queued items none of whose known dependencies is unfinished; unknown ids do not block."""
    needs = items.where("status = 'queued'").select("id", F.explode("depends_on").alias("need"))
    unfinished = items.where("status <> 'succeeded'").select(F.col("id").alias("need"))
    return items.where("status = 'queued'").join(needs.join(unfinished, "need").select("id").distinct(), "id", "left_anti")


def restrict_to(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids, key, "left_semi")


def memory_key(c):
    return F.trim(F.regexp_replace(T.nfc(c), r"\s+", " "))


def translation_memory(todo: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reuses the last finished row of an equal source: (hits, remaining). A row's own finished version is no hit."""
    last = done.where("status = 'final'").groupBy(memory_key(F.col("src")).alias("k")).agg(F.max_by(F.struct("segment_id", "tgt"), "segment_id").alias("m"))
    joined = todo.withColumn("k", memory_key(F.col("src"))).join(last, "k", "left")
    hit = F.col("m").isNotNull() & (F.col("m.segment_id") != F.col("segment_id"))
    return joined.where(hit).select("segment_id", F.col("m.segment_id").alias("from_id"), F.col("m.tgt").alias("tgt")), joined.where(~F.coalesce(hit, F.lit(False))).select("segment_id")


# Bigrams are counted in so many classes to tell rare from common ones: a bounded table.
RARITY = 1024


def _bigram_counts(z: str) -> Counter:
    return Counter(map("".join, zip(z, z[1:])))


def _rarest(often: list[int], ratio: float):
    """Adds to rows with z, as the last columns, the rarest occurrences of its bigrams (g, and k for its k-th): as many as must hold a common one."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, grams, turns = [], [], []
            for i, z in enumerate(batch.column(batch.schema.get_field_index("z")).to_pylist()):
                n = len(z) - 1
                left = n - ceil(ratio * n - 1e-9) + 1
                counts = _bigram_counts(z)
                for g in sorted(counts, key=lambda g: (often[crc32(g.encode()) % RARITY], g)):
                    take = min(left, counts[g])
                    at += [i] * take
                    grams += [g] * take
                    turns += range(take)
                    left -= take
                    if not left:
                        break
            kept = batch.drop_columns(["z"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(grams, pa.string()), pa.array(turns, pa.int32())], names=[*kept.schema.names, "g", "k"])

    return rarest


def _compared(threshold: float):
    """Turns x and y, the last columns, into the score of those that reach the threshold."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("x", "y"))):
                scores.append(1.0 if x == y else 2 * (_bigram_counts(x) & _bigram_counts(y)).total() / (len(x) + len(y) - 2))
            kept = batch.drop_columns(["x", "y"])
            out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], names=[*kept.schema.names, "score"])
            yield out.filter(pa.array([v >= threshold for v in scores], pa.bool_()))

    return compared


def similar_pairs(left: DataFrame, right: DataFrame, on: list[str], threshold: float, title: str = "title") -> DataFrame:
    """Pairs of titles with the same `on` whose bigram Dice score (with multiplicity) is `threshold` or more: on, lid, rid, score.

    A score of t needs sizes within a ratio of t / (2 - t) and that share of the larger one's bigrams. So titles that no size
    of the other side can match go first; of what is left only as many bigrams become rows as must hold a common one (the
    rarest by the other side's counts), and pairs that meet there are compared in full.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    ratio = threshold / (2 - threshold)

    def sized(d: DataFrame, key: str) -> DataFrame:
        # A filter on titles would have them worked out once more below it, so they are written first.
        z = staged(d.select(*on, key, F.regexp_replace(title, " ", "").alias("z")), "titles")
        return z.withColumn("n", F.char_length("z") - 1).where("n > 0")

    def within(d: DataFrame, other: DataFrame) -> DataFrame:
        span = other.groupBy(*on).agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
        return d.join(span, on).where((F.col("n") >= F.floor(ratio * F.col("_lo"))) & (ratio * F.col("n") <= F.col("_hi") + 1)).drop("_lo", "_hi")

    a, b = sized(left, "lid"), sized(right, "rid")
    a = within(a, b)
    counted = b.select(F.explode(F.transform(T.bigrams(F.col("z")), lambda g: F.crc32(g) % RARITY)).alias("c")).groupBy("c").count().collect()
    often = [0] * RARITY
    for r in counted:
        often[r["c"]] = r["count"]

    def first(d: DataFrame, key: str, n: str) -> DataFrame:
        rows = d.select(*on, key, F.col("n").alias(n), "z")
        schema = StructType([*(f for f in rows.schema.fields if f.name != "z"), StructField("g", StringType()), StructField("k", IntegerType())])
        return rows.mapInArrow(_rarest(often, ratio), schema)

    met = first(a, "lid", "_n").join(first(within(b, a), "rid", "_m"), [*on, "g", "k"])
    near = met.where((F.col("_n") >= F.floor(ratio * F.col("_m"))) & (F.col("_m") >= F.floor(ratio * F.col("_n")))).select(*on, "lid", "rid").distinct()
    full = near.join(a.select(*on, "lid", F.col("z").alias("x")), [*on, "lid"]).join(b.select(*on, "rid", F.col("z").alias("y")), [*on, "rid"]).select(*on, "lid", "rid", "x", "y")
    schema = StructType([*full.select(*on, "lid", "rid").schema.fields, StructField("score", DoubleType())])
    return full.mapInArrow(_compared(threshold), schema)


def similar_titles(entries: DataFrame, blocks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Matches outline entries (doc_id, lid, title, page) to blocks (doc_id, rid, title, page, type, words) in order.

    A match is one block or two that follow each other in a document. It begins on the entry's page or the next, has at
    most 20 words unless it is a heading, and others than headings lose 0.1. Titles are compared as they are and without
    their numbers; equal ones without numbers score 1. All scores are made in parallel; then one pass over a document's
    entries in order gives each its best block after the previous match (doc_id, lid, rid, score).
    """
    near = blocks.where("type = 'heading' or words <= 20")
    after = Window.partitionBy("doc_id").orderBy("rid")
    two = near.select("doc_id", "rid", "page", "type", F.concat_ws(" ", "title", F.lead("title").over(after)).alias("title"), F.lead("title").over(after).alias("_next")).where("_next is not null").drop("_next")
    spans = near.select("doc_id", "rid", "page", "type", "title", F.lit(1).alias("span")).unionByName(two.withColumn("span", F.lit(2)))
    spans = spans.withColumn("rid", F.struct(F.col("rid").cast("long").alias("rid"), "span")).drop("span")
    # A match begins on the entry's page or the next: pages are part of the key, and pages without entries go at once.
    asked = entries.select("doc_id", "lid", F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page"), "title")
    spans = staged(spans.join(asked.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi"), "spans")
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("title")), F.struct(F.lit(1).alias("form"), T.strip_title_number(F.col("title")).alias("title")))).alias("f")
    both = lambda d, i: d.select("doc_id", "page", i, forms).select("doc_id", "page", i, "f.*")
    # Rounding below must not lose a score that is the threshold but for the last digit.
    scores = similar_pairs(both(asked, "lid"), both(spans, "rid"), ["doc_id", "page", "form"], threshold - 1e-8).groupBy("doc_id", "lid", "rid").agg(F.max("score").alias("score"))
    joined = scores.join(spans.select("doc_id", "rid", "type"), ["doc_id", "rid"])
    fit = joined.withColumn("score", F.round(F.col("score") - F.when(F.col("type") == "heading", 0.0).otherwise(0.1), 9)).where(F.col("score") >= threshold)
    fit = fit.select("doc_id", "lid", "rid.rid", "rid.span", "score")

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, entry, last, placed = None, None, -1, False
        for batch in batches:
            out = []
            for i, (d, lid, rid, span) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if (d,) != doc:
                    doc, entry, last = (d,), None, -1
                if lid != entry:
                    entry, placed = lid, False
                if not placed and rid > last:
                    placed, last = True, rid + span - 1
                    out.append(i)
            yield batch.drop_columns(["span"]).take(pa.array(out, pa.int64()))

    # A document's rows pass in order through one task, batch by batch; a call for each document would cost more than its rows.
    dealt = fit.select("doc_id", F.col("lid").cast("long").alias("lid"), "rid", "span", "score").repartition("doc_id").sortWithinPartitions("doc_id", "lid", F.desc("score"), "rid", "span")
    return dealt.mapInArrow(ordered, f"doc_id {entries.schema['doc_id'].dataType.simpleString()}, lid long, rid long, score double")


def running_title_lines(lines: DataFrame, titles: DataFrame, page_height: float, body_size: float | Column = 10.0, zone: float | None = 0.08, threshold: float = 0.9) -> DataFrame:
    """Small lines in the top or bottom margin that repeat a title of their document; zone None: all lines are margin lines.

    lines hold doc_id, ord (an id of any type), text, size and y, titles doc_id, rid and title.
    """
    small = lines.where(F.col("size") <= 1.05 * (body_size if isinstance(body_size, Column) else F.lit(body_size)))
    if zone is not None:
        from vellumspark.operators.aggregates import in_margin

        small = small.where(in_margin(page_height, zone).isNotNull())
    named = small.select("doc_id", F.col("ord").alias("lid"), T.normalize_title(F.col("text")).alias("title"))
    known = titles.select("doc_id", "rid", T.normalize_title(F.col("title")).alias("title"))
    found = similar_pairs(named, known, ["doc_id"], threshold).select("doc_id", F.col("lid").alias("ord")).distinct()
    return small.join(found, ["doc_id", "ord"], "left_semi")


def label_to_page(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """First page after the contents page with an entry's printed label: doc_id, title, page."""
    j = entries.join(labels.select("doc_id", F.col("label").alias("l"), "page"), "doc_id").where("lower(l) = lower(label) and page > contents_page")
    return j.groupBy("doc_id", "title").agg(F.min("page").alias("page"))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values on one side only, with how often: keys, value, missing (left only) and extra (right only)."""
    a = left.groupBy(*keys, value).agg(F.count("*").alias("l"))
    b = right.groupBy(*keys, value).agg(F.count("*").alias("r"))
    d = F.coalesce("l", F.lit(0)) - F.coalesce("r", F.lit(0))
    return a.join(b, [*keys, value], "full_outer").where(d != 0).select(*keys, value, F.greatest(d, F.lit(0)).alias("missing"), F.greatest(-d, F.lit(0)).alias("extra"))


def markup_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Markup tokens that source and target do not share."""
    side = lambda c: pairs.select(*keys, F.explode(T.markup_tokens(F.col(c))).alias("token"))
    return multiset_difference(side("src"), side("tgt"), keys, "token")


def numbers_of(src: Column, tgt: Column) -> tuple[Column, Column]:
    """Digit runs that a source asks for, ordinals aside, and those of its target."""
    need = F.regexp_extract_all(F.regexp_replace(T.fold_digits(T.strip_markup(src)), r"(?i)\b\d+(?:st|nd|rd|th)\b", " "), F.lit("[0-9]+"), F.lit(0))
    return need, F.regexp_extract_all(T.fold_digits(tgt), F.lit("[0-9]+"), F.lit(0))


def missing_numbers(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Digit runs of the source that the target lacks, ordinals aside; more numbers in the target are fine."""
    need, have = numbers_of(F.col("src"), F.col("tgt"))
    d = multiset_difference(pairs.select(*keys, F.explode(need).alias("number")), pairs.select(*keys, F.explode(have).alias("number")), keys, "number")
    return d.where("missing > 0").select(*keys, "number", "missing")


def key_integrity(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, unknown and repeated keys of a result against what was asked for."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("asked"))
    r = returned.groupBy(*keys).agg(F.count("*").alias("got"))
    rule = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "unknown").when(F.col("got") > 1, "duplicate")
    return e.join(r, keys, "full_outer").select(*keys, rule.alias("rule")).where("rule is not null")


def apply_overrides(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Override rows replace base rows of their key, whole."""
    return base.join(overrides, keys, "left_anti").unionByName(overrides)


def superscript_hosts(lines: DataFrame) -> DataFrame:
    """Small raised items with the line they belong to: doc_id, page, item, host.

    Items meet hosts of the same page through bands of y, of which a host has all that it reaches up to, not all lines of a page.
    """
    band = lambda c: F.floor(c / 20)
    small = lines.select("doc_id", "page", F.col("id").alias("item"), F.col("size").alias("s"), F.col("y").alias("sy"), F.col("x0").alias("sx"), band(F.col("y")).alias("b"))
    reached = F.explode(F.sequence(band(F.col("y") - 0.6 * F.greatest(F.col("size"), F.lit(0.0))), band(F.col("y")))).alias("b")
    hosts = lines.select("doc_id", "page", F.col("id").alias("host"), F.col("size").alias("h"), F.col("y").alias("hy"), "x0", "x1", reached)
    j = small.join(hosts, ["doc_id", "page", "b"]).where("item <> host and s < 0.85 * h and hy - sy between 0 and 0.6 * h and sx between x0 - 2 * s and x1 + 2 * s")
    return j.groupBy("doc_id", "page", "item").agg(F.min_by("host", F.struct(F.abs(F.col("hy") - F.col("sy")), "host")).alias("host"))


def resolve_citations(answers: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """First mention of every known [P1]-style label of an answer, in order: keys, position, label, segment_id."""
    found = answers.select(*keys, F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(P\d{1,3})\]"), F.lit(1))).alias("at", "label"))
    first = found.groupBy(*keys, "label").agg(F.min("at").alias("at"))
    known = first.join(labels, [*keys, "label"])
    w = Window.partitionBy(*keys).orderBy("at")
    return known.withColumn("position", F.row_number().over(w)).drop("at")


def batch_status_join(batches: DataFrame, items: DataFrame, state: str) -> DataFrame:
    return batches.join(items.where(F.col("state") == state), "item_id").groupBy("item_id").agg(F.count("*").alias("n"))


def dehyphenate(line_pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Whether a line-end hyphen goes: by which of left-right and leftright more documents hold, else by the right part's case."""
    joined = F.lower(F.concat("left", "right"))
    hyphened = F.lower(F.concat("left", F.lit("-"), "right"))
    v = lambda name: vocabulary.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    p = line_pairs.withColumn("joined", joined).withColumn("hyphened", hyphened).join(v("joined"), "joined", "left").join(v("hyphened"), "hyphened", "left").na.fill(0, ["n_joined", "n_hyphened"])
    join = F.when(F.col("n_joined") != F.col("n_hyphened"), F.col("n_joined") > F.col("n_hyphened")).otherwise(F.col("right").rlike(r"^\p{Ll}"))
    return p.withColumn("text", F.when(join, F.concat("left", "right")).otherwise(F.concat("left", F.lit("-"), "right"))).drop("joined", "hyphened", "n_joined", "n_hyphened")


def first_block_after(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """First block at or after an entry's position: an as-of match forward on (doc_id, pos).

    Entries and blocks of a document are merged by position in one window; no pairs are made.
    """
    e = entries.select("doc_id", F.col("pos"), F.col("entry"), F.lit(None).cast("long").alias("block"), F.lit(0).alias("k"))
    b = blocks.select("doc_id", F.col("pos"), F.lit(None).cast("string").alias("entry"), F.col("block").cast("long"), F.lit(1).alias("k"))
    w = Window.partitionBy("doc_id").orderBy("pos", "k", "block").rowsBetween(0, Window.unboundedFollowing)
    return e.unionByName(b).withColumn("found", F.first("block", ignorenulls=True).over(w)).where("entry is not null").select("doc_id", "entry", F.col("found").alias("block"))
