"""Fixed cases from the sixth reading."""

import duckdb
import pandas as pd

from vellumspark.functions import text as T
from vellumspark.operators import aggregates as G
from vellumspark.operators import joins as J
from vellumspark.operators import terms as M
from vellumspark.plans import quality as Q


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_checked_in_place(spark):
    pairs = [(1, "See 1 and 1 `a` `b`.", "1 `b` `a`"), (2, "go on go on go on, 7", "so so so so 7 8"), (3, "so so so so", "no no no no"), (4, None, "x"), (5, "3rd of 2", "2")]
    frame = spark.createDataFrame(pairs, "k int, src string, tgt string")
    found = Q.quality_check(frame, ["k"], "de")
    assert sorted((r.k, r.code) for r in found.collect()) == [(1, "numbers")]
    assert sorted((r.k, r.code) for r in Q.quality_check(frame.selectExpr("k", "tgt src", "src tgt"), ["k"], "de").collect()) == [(2, "numbers"), (4, "empty")]
    assert "Exchange" not in plan(found) and "Window" not in plan(found)


def test_repeated_phrases_are_found_in_place(spark):
    texts = ["a b a b a b a b a", "x. -- X, x‌(x) y", "very very very", "b c b c b c d d d d", "a b c d e f a b c d e f a b c d e f", "a b c d e f g " * 4, " ,. ", None, "go-on go-on ...go-on!\ngo-on", "one two-one two one twos one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = G.repeated_phrases(frame, "k", "t")
    assert {r.k: r.phrase for r in got.collect()} == {0: "a b", 1: "x", 3: "d", 4: "a b c d e f", 8: "go-on"}
    assert "Exchange" not in plan(got)


def test_numbers_meet_with_multiplicity(spark):
    rows = [(["1", "1", "2"], ["2", "1", "1"]), (["1", "1"], ["1", "2"]), ([], ["1"]), (["3"], []), (["2"], ["2", "2"]), (None, None)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    assert [r.v for r in frame.select("k", T.lacks_some(frame.a, frame.b).alias("v")).orderBy("k").collect()] == [False, True, False, True, False, False]


def test_titles_are_placed_in_order_batch_by_batch(spark):
    titles = ["lever arms", "pulley blocks", "lever arms", "wedge", "lever arms"]
    entries = spark.createDataFrame([(d, k, t, 0) for d in range(9) for k, t in enumerate(titles)], "doc_id long, lid int, title string, page int")
    blocks = spark.createDataFrame([(d, 10 * k, t, 0, "heading", 2) for d in range(9) for k, t in enumerate(["pulley blocks", *titles[:3], "else", "lever arms"])], "doc_id long, rid long, title string, page int, type string, words int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = J.similar_titles(entries, blocks)
        got = sorted((r.doc_id, r.lid, r.rid, r.score) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(d, lid, rid, 1.0) for d in range(9) for lid, rid in ((0, 10), (1, 20), (2, 30), (4, 50))]
    assert "FlatMapGroupsInPandas" not in plan(found)


def test_edges_are_interpolated_as_in_sql(spark):
    """Every group's percentile to the last digit; plain interpolation is off in some."""
    rows = [((i * 7919) % 400, float(50 + 5 * ((i * i * 31 + i * 17) % 401) + (18 if i % 4 == 0 else 0))) for i in range(6000)]
    frame = spark.createDataFrame(rows, "g int, x double")
    con = duckdb.connect()
    for p in (0.1, 0.9):
        got = {r.g: r.q for r in G.with_percentile(frame, ["g"], "x", p, "q").collect()}
        rows_ = pd.DataFrame(rows, columns=["g", "x"])  # noqa: F841
        assert got == dict(con.execute(f"SELECT DISTINCT g, quantile_cont(x, {p}) OVER (PARTITION BY g) FROM rows_").fetchall())


def test_plurals_meet_their_singulars_without_further_shuffles(spark):
    counts = {"city": 2, "cities": 3, "bus": 1, "buses": 4, "big boxes": 2, "big box": 1, "axes": 5, "yes": 1, "ye": 2, "s": 1, "glass": 2, "glasses": 1, "series": 1, "s caseses": 1, "s cases": 1, "s case": 1, "boss": 1}
    frame = spark.createDataFrame([(k, k, n, 1, 0, 0) for k, n in counts.items()], "key string, form string, n long, words int, bonus int, place int")
    merged = M.merge_plurals(M.surface_form(frame))
    assert {r.key: (r.n, r.form) for r in merged.collect()} == {
        "city": (5, "city"), "bus": (5, "bus"), "big box": (3, "big box"), "axes": (5, "axes"), "ye": (3, "ye"), "s": (1, "s"), "glass": (3, "glass"), "series": (1, "series"), "s cases": (2, "s cases"), "s case": (1, "s case"), "boss": (1, "boss")
    }
    texts = spark.createDataFrame([(1, "Levers and a lever.")], "doc_id long, text string")
    assert plan(M.merge_plurals(M.surface_form(M.term_candidates(texts)))).count("Exchange hashpartitioning") == 2
