"""Findings of FINDINGS_r03: results that differed from their SQL on larger tables, and steps that grew too fast."""

import time

from pyspark.sql import functions as F

from tests.core.test_round4 import shuffled
from vellumspark.functions import text as T
from vellumspark.operators import index as I
from vellumspark.operators import windows as W
from vellumspark.plans.reports import extractive_digest
from vellumspark.staging import new_path
from vellumspark.streaming import jobs as ST


def test_a_backlog_is_dealt_into_ticks_at_once(spark):
    rows = spark.range(1, 1301).select((F.col("id") * 3).alias("id")).orderBy(F.rand(1))
    got = sorted((r.id, r.tick) for r in ST.change_ticks(rows, after=60, limit=100, first=7).collect())
    assert got == [(i, 7 + k // 100) for k, i in enumerate(range(63, 3901, 3))]
    assert ST.change_ticks(rows, after=3900).count() == 0


def test_addresses_and_amounts_are_no_section_numbers(spark):
    titles = ["Big", "44.144.126.223 Th anatble", "2.3 Notes", "1.2.3.4 Deep", "3.5% growth", "2.1"]
    h = spark.createDataFrame([(1, k, 20.0 if k < 2 else 10.0, t) for k, t in enumerate(titles)], "doc_id long, ord int, size double, text string")
    got = [r.depth for r in W.heading_depth(h, "doc_id", "size", "text").orderBy("ord").collect()]
    assert got == [0, 0, 1, 2, 1, 1]


def test_an_index_is_written_with_one_shuffle_of_its_postings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seg_id"), "text")
    path = new_path(spark, "once")
    mb = shuffled(spark, lambda: I.write_index(docs, path, chunk_texts=16))
    rows = I.open_index(spark, path).postings().count()
    assert mb * 1e6 < 25 * rows


def test_arabic_digits_are_no_marks(spark):
    t = spark.createDataFrame([("سال ١٢٣ می‌شود كتاب‌ها ٥*b*",)], "text string")
    got = t.select(T.keywords(T.strip_markup(F.col("text"))).alias("w"), T.normalize_for_search(F.col("text")).alias("n")).first()
    assert got.w == ["سال", "123", "میشود", "کتابها", "5b"] and got.n == "سال 123 میشود کتابها 5*b*"
    assert t.select(T.without_marks(F.lit("١٢٣é"))).first()[0] == "١٢٣e"


def test_a_closing_sentence_takes_no_square_of_its_text(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 150_000 + "!?x. Last one.  ")], "doc_id long, ord int, text string")
    start = time.monotonic()
    assert extractive_digest(rows, "doc_id", "ord").first().closing == "Last one."
    assert time.monotonic() - start < 15


def test_a_book_is_exported_by_its_entries(spark):
    """No row of the export, and no aggregate below it, holds the texts of a whole book."""
    from vellumspark.sources.tables import reading_export

    nodes = spark.createDataFrame([("b", k, k, k % 2, "section" if k % 2 else "chapter", k, f"T{k}", None, k == 3, k - k % 2) for k in range(6)], "book string, node_id long, pos long, depth long, kind string, number long, title_src string, title_tgt string, skip boolean, chapter long")
    rows = spark.createDataFrame([("b", k, i, "p", f"x{i}", None) for k in range(5) for i in (1, 0)], "book string, node_id long, ord int, type string, src string, tgt string")
    terms = spark.createDataFrame([("b", "z", "y", None), ("b", "a", "<", "d")], "book string, src string, tgt string, definition string")
    entries, books = reading_export(nodes, rows, terms, spark.createDataFrame([("b", 1, 10)], "book string, done long, total long"))
    got = [(r.id, r.label, r.chapter, None if r.rows is None else [x.src for x in r.rows]) for r in entries.orderBy("pos").collect()]
    both = ["x0", "x1"]
    assert got == [(0, "0. T0", None, both), (1, "T1", "T0", both), (2, "2. T2", None, both), (4, "4. T4", None, both), (5, "T5", "T4", None)]
    assert [([t.src for t in r.glossary], r.done, r.total) for r in books.collect()] == [(["a", "z"], 1, 10)]
