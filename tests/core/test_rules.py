"""Small fixed inputs with known results, for rules that the stored tables do not exercise."""

import random

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import aggregates as G
from vellumspark.operators import filters as P
from vellumspark.operators import joins as J
from vellumspark.operators import layout as L
from vellumspark.operators import packing
from vellumspark.operators import terms as M
from vellumspark.operators import tree as R
from vellumspark.plans import quality as Q


def values(spark, texts, f):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_search_form(spark):
    texts = ["كتاب‌ها", "کتاب ها", "می‌شود", "Éaux  ÇA", "بـزرگ", "۱۲۳", None]
    assert values(spark, texts, T.normalize_for_search) == ["کتابها", "کتابها", "میشود", "eaux ca", "بزرگ", "123", None]


def test_markup(spark):
    texts = ["an *early* and **bold** `code` text[^1]", "see [[fig:2.1]] and https://example.org/a.", r"\*not\* emphasis", "2 * 3 * 4"]
    assert values(spark, texts, T.strip_markup) == ["an early and bold code text", "see  and https://example.org/a.", "*not* emphasis", "2 * 3 * 4"]
    assert [sorted(v) for v in values(spark, texts[:2], T.markup_tokens)] == [["code:code", "fn:1"], ["fig:2.1", "url:https://example.org/a"]]
    assert values(spark, ["a < *b* `c`[^2]"], T.markup_to_html) == ["a &lt; <em>b</em> <code>c</code><sup>2</sup>"]


def test_repetition(spark):
    texts = ["one two three", "very very very good", "very very very very good", "go on go on go on now", "a b c a b c a b c", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert {r.k: r.phrase for r in G.repeated_phrases(rows, "k", "t").collect()} == {2: "very", 3: "go on", 4: "a b c"}


def test_length_outliers(spark):
    src = "This sentence is long enough to be measured by the length ratio check."
    pairs = [("g", str(i), src, "x" * (70 + i)) for i in range(8)] + [("g", "short", src, "x" * 8), ("few", "a", src, "x")]
    rows = spark.createDataFrame(pairs, "g string, k string, src string, tgt string")
    assert [r.k for r in G.length_outliers(rows, ["g"]).collect()] == ["short"]


def test_chunks(spark):
    rows = spark.createDataFrame([("n", k, w) for k, w in enumerate((3, 3, 5, 9, 1))], "n string, ord int, w int")
    assert [r.chunk for r in packing.chunk_by_budget(rows, ["n"], "ord", "w", 8).orderBy("ord").collect()] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("ranges", [1, 3, 9, 40])
def test_chunks_of_groups_that_span_ranges(spark, ranges):
    """Against the plain fold: groups of one row and of most rows, empty rows, rows over the budget, equal places."""
    draw = random.Random(5)
    rows = [("big", i // 2, draw.choice((0, 0, 1, 1, 2, 3, 5, 11, 25, None))) for i in range(1500)]
    rows += [("one", i, 1) for i in range(400)] + [(None, i, draw.randrange(4)) for i in range(60)] + [(f"g{i}", 0, i) for i in range(30)]
    want, state = {}, {}
    for g, k, w in sorted(rows, key=lambda r: (r[0] or "", r[1], -1 if r[2] is None else r[2])):
        chunk, total = state.get(g, (0, 0))
        if total > 0 and total + (w or 0) > 10:
            chunk, total = chunk + 1, 0
        state[g] = chunk, total + (w or 0)
        want.setdefault((g, k), []).append(chunk)
    frame = spark.createDataFrame(rows, "g string, k int, w int").repartition(5)
    got = {}
    for r in packing.chunk_by_budget(frame, ["g"], "k", "w", 10, ranges).collect():
        got.setdefault((r.g, r.k), []).append(r.chunk)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert packing.chunk_by_budget(frame.limit(0), ["g"], "k", "w", 10, ranges).count() == 0


@pytest.mark.parametrize(
    "language,terms,text,want",
    [
        ("en", [("alg", "algorithm"), ("mem", "memory")], "Algorithms are everywhere; an algorithm’s steps and the memories it uses.", ["alg", "alg", "mem"]),
        ("en", [("bs", "binary search"), ("bin", "binary"), ("ds", "data structure")], "Binary search needs binary data structures.", ["bs", "bin", "ds"]),
        ("en", [("alg", "algorithm")], "algorithmic thinking", []),
        ("fa", [("alg", "الگوریتم")], "الگوریتم‌ها و الگوریتمی ساده", ["alg", "alg"]),
        ("fa", [("bs", "جست‌وجوی دودویی"), ("ds", "ساختار داده")], "جست وجوی دودویی روي ساختار داده‌ها", ["bs", "ds"]),
        ("fa", [("alg", "الگوریتم")], "ناالگوریتم", []),
    ],
)
def test_term_matches(spark, language, terms, text, want):
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = M.match_terms(texts, spark.createDataFrame(terms, "term_id string, src string"), language=language)
    assert [r.term_id for r in got.orderBy("start").collect()] == want


def test_hyphens(spark):
    vocabulary = spark.createDataFrame([("computation", 2), ("self-driving", 1)], "word string, n int")
    pairs = spark.createDataFrame([("compu", "tation"), ("self", "driving"), ("Anglo", "Saxon"), ("some", "thing")], "left string, right string")
    assert sorted(r.text for r in J.dehyphenate(pairs, vocabulary).collect()) == ["Anglo-Saxon", "computation", "self-driving", "something"]


def test_page_labels(spark):
    pages = spark.createDataFrame([("d", k) for k in range(7)] + [("e", 0), ("e", 1)], "doc_id string, page int")
    printed = spark.createDataFrame([("d", 3, "2"), ("d", 4, "3"), ("d", 6, "5")], "doc_id string, page int, printed string")
    supplied = spark.createDataFrame([("e", 0, "a"), ("e", 1, "b")], "doc_id string, page int, label string")
    got = [r.label for r in L.infer_page_labels(pages, printed, supplied).orderBy("doc_id", "page").collect()]
    assert got == ["i", "ii", "1", "2", "3", "4", "5", "a", "b"]


def test_two_columns(spark):
    rows = [("title", 60.0, 50.0, 360.0)] + [(f"left {k}", 100.0 + 14 * k, 50.0, 190.0) for k in range(4)] + [(f"right {k}", 100.0 + 14 * k, 220.0, 360.0) for k in range(4)]
    lines = spark.createDataFrame([("d", 0, *r) for r in rows], "doc_id string, page int, text string, y double, x0 double, x1 double")
    got = [r.text for r in L.reading_order(lines).orderBy("pos").collect()]
    assert got == ["title"] + [f"left {k}" for k in range(4)] + [f"right {k}" for k in range(4)]
    rtl = [r.text for r in L.reading_order(lines, rtl=True).orderBy("pos").collect()]
    assert rtl[1] == "right 0" and rtl[5] == "left 0"


def test_gutter_and_superscript(spark):
    items = [("left", 50.0, 100.0, 40.0, 10.0), ("side", 95.0, 100.0, 40.0, 10.0), ("far", 300.0, 100.5, 40.0, 10.0), ("2", 136.0, 97.5, 3.0, 6.0)]
    frame = spark.createDataFrame([("d", 0, *r) for r in items], "doc_id string, page int, text string, x double, y double, width double, size double")
    grouped = L.group_baselines(frame)
    texts = sorted(r.text for r in L.build_lines(grouped).collect())
    assert "left side" in " ".join(texts) or "left side2" in texts
    assert any("far" == t for t in texts)


def test_continuations(spark):
    blocks = [("d", 0, "list_item", "1. The list goes", 0.0), ("d", 1, "paragraph", "on here.", 0.0), ("d", 2, "paragraph", "A compu-", 0.0), ("d", 3, "paragraph", "tation ends.", 0.0), ("d", 4, "paragraph", "• not this", 0.0), ("d", 5, "paragraph", "indented", 2.0)]
    frame = spark.createDataFrame(blocks, "doc_id string, ord int, type string, text string, indent double")
    got = [(r.type, r.text) for r in L.merge_continuations(frame, ["doc_id"], "ord").orderBy("ord").collect()]
    assert got == [("list_item", "1. The list goes on here."), ("paragraph", "A computation ends."), ("paragraph", "• not this"), ("paragraph", "indented")]


def test_across_pages(spark):
    rows = [("d", 0, "paragraph", "It breaks off", 0, 0, 10.0, 50.0, 0.0, None), ("d", 1, "footnote", "1 note", 0, 0, 8.0, 50.0, 0.0, None), ("d", 2, "paragraph", "and goes on.", 1, 0, 10.0, 50.0, 0.0, None), ("d", 3, "paragraph", "New one", 1, 0, 10.0, 50.0, 0.0, None), ("d", 4, "paragraph", "same page", 1, 0, 10.0, 50.0, 0.0, None)]
    frame = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, page int, column int, size double, x0 double, indent double, text_x double")
    got = [r.text for r in L.merge_across_pages(frame, "doc_id", "ord").orderBy("ord").collect()]
    assert got == ["It breaks off and goes on.", "New one", "same page"]


def test_contents_and_labels(spark):
    lines = spark.createDataFrame([("d", 0, 10.0, 50.0, "1 Levers ........ 12"), ("d", 0, 24.0, 62.0, "1.1 Arms    14"), ("d", 0, 38.0, 50.0, "no entry")], "doc_id string, page int, y double, x0 double, text string")
    assert [(r.title, r.label, r.depth) for r in L.parse_contents_lines(lines).orderBy("y").collect()] == [("1 Levers", "12", 0), ("1.1 Arms", "14", 1)]
    titles = spark.createDataFrame([("Chapter Three: Pulleys",), ("2.1 Wheels",), ("Plain",)], "title string")
    assert [(r.number, r.rest) for r in L.chapter_label(titles).collect()] == [("3", "Pulleys"), ("2.1", "Wheels"), (None, "Plain")]


def test_recognised_words(spark):
    words = spark.createDataFrame([("good", 30.0, 90.0, 0.0, 30.0, 90.0), ("~", 0.0, 3.0, 0.0, 30.0, 5.0), ("ok", 0.0, 3.0, 0.0, 30.0, 5.0)], "text string, x0 double, x1 double, line_top double, baseline double, confidence double")
    assert [(r.text, r.x, r.y, r.width, r["size"]) for r in P.clean_recognised_words(words).orderBy("text").collect()] == [("good", 10.0, 10.0, 20.0, 14.0), ("ok", 0.0, 10.0, 1.0, 14.0)]


TREE = [("b", "c1", None, 0, 0, "chapter", "One", False), ("b", "s1", "c1", 0, 1, "section", "A", False), ("b", "s2", "c1", 1, 1, "section", "B", False), ("b", "s3", "c1", 2, 1, "section", "C", False)]


def edit(spark, op, node, value=None):
    nodes = spark.createDataFrame(TREE, "book string, node_id string, parent_id string, ord int, depth int, kind string, title string, skip boolean")
    segments = spark.createDataFrame([("b", f"{n}-{k}", n, k) for n in ("s1", "s2", "s3") for k in range(3)], "book string, segment_id string, node_id string, ord int")
    n, s, e = R.apply_structure_ops(nodes, segments, spark.createDataFrame([("b", op, node, value)], "book string, op string, node_id string, value string"))
    return {r.node_id: r for r in n.collect()}, s.orderBy("node_id", "ord").collect(), e.collect()


def test_structure_edits(spark):
    n, s, e = edit(spark, "demote", "s2")
    assert (n["s2"].parent_id, n["s2"].depth, n["s2"].kind, n["s3"].ord) == ("s1", 2, "subsection", 1) and not e
    n, s, e = edit(spark, "promote", "s2")
    assert (n["s2"].parent_id, n["s2"].depth, n["s2"].kind, n["s3"].parent_id) == (None, 0, "chapter", "s2")
    n, s, e = edit(spark, "merge_prev", "s2")
    assert "s2" not in n and [r.segment_id for r in s if r.node_id == "s1"] == ["s1-0", "s1-1", "s1-2", "s2-0", "s2-1", "s2-2"] and [r.ord for r in s if r.node_id == "s1"] == list(range(6))
    n, s, e = edit(spark, "split", "s2", "s2-1")
    assert n["s2'"].ord == n["s2"].ord + 1 and [r.segment_id for r in s if r.node_id == "s2'"] == ["s2-1", "s2-2"]
    n, s, e = edit(spark, "skip", "c1")
    assert all(r.skip for r in n.values())
    for op, node, value in (("promote", "c1", None), ("demote", "s1", None), ("rename", "s1", "  "), ("split", "s2", "s2-0"), ("skip", "nope", None)):
        assert len(edit(spark, op, node, value)[2]) == 1


def test_quality_codes(spark):
    pairs = [(1, "There are 12 pulleys.", ""), (2, "See `run()` and 3 more.", "Siehe run() und mehr."), (3, "A lever.", "Una palanca."), (4, "A short one.", "so so so so gut")]
    frame = spark.createDataFrame(pairs, "k int, src string, tgt string")
    got = sorted((r.k, r.code) for r in Q.quality_check(frame, ["k"], "de").collect())
    assert got == [(1, "empty"), (2, "markup"), (2, "numbers"), (4, "repetition")]
    persian = spark.createDataFrame([(1, "The lever moves the load.", "This is still English text here"), (2, "The lever moves.", "اهرم حرکت می‌کند, بله"), (3, "A lever.", "اهرم")], "k int, src string, tgt string")
    terms = spark.createDataFrame([("t", "lever", "اهرم", "concept")], "term_id string, src string, tgt string, kind string")
    got = sorted((r.k, r.code) for r in Q.quality_check(persian, ["k"], "fa", terms).collect())
    assert got == [(1, "glossary"), (1, "target_script"), (2, "latin_punctuation")]


def test_mined_terms(spark):
    texts = ["The *Mechanical Advantage* of a lever. Levers move loads; a lever moves a load.", "NASA built levers. The Great Lever is old, the lever of Archimedes too. `lever` code"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tallies = {r.key: (r.n, r.bonus, r.form) for r in M.surface_form(M.term_candidates(frame)).collect()}
    # Emphasised, capitalised and plain occurrences add up; the greatest bonus counts.
    assert tallies["mechanical advantage"] == (3, 6, "Mechanical Advantage") and tallies["nasa"] == (2, 2, "NASA")
    assert tallies["great lever"][1] == 2 and tallies["archimedes"][1] == 2 and "code" in tallies and tallies["lever"][0] == 4
    merged = {r.key: (r.n, r.form) for r in M.merge_plurals(M.surface_form(M.term_candidates(frame))).collect()}
    assert "levers" not in merged and merged["lever"] == (6, "lever") and "loads" not in merged
    assert M.merge_plurals(M.surface_form(M.term_candidates(frame)), "de").where("key = 'levers'").count() == 1
    terms = spark.createDataFrame([("a b", 2, 9), ("a", 1, 10), ("b", 1, 20), ("a b c", 3, 8)], "key string, words int, n long")
    assert {r.key for r in M.drop_subsumed(terms).collect()} == {"b", "a b c"}


def test_first_mention_texts(spark):
    rows = [
        ("h", 1, 0, "heading", "The lever"), ("a", 1, 1, "p", "A lever and a lever (Hebel) lift."), ("b", 1, 2, "p", "Levers (hebel) and *pulley* (Rolle), pulley."),
        ("c", 2, 0, "p", "No pulley; wheel (Rad) and wheel (Rad)."), ("d", 2, 1, "p", "crank (Kurbel)"),
    ]
    frame = spark.createDataFrame(rows, "segment_id string, chapter int, ord int, type string, text string")
    terms = spark.createDataFrame([(1, "Hebel", "lever", "first_in_chapter"), (2, "Rolle", "pulley", "first_in_chapter"), (3, "Rad", "wheel", "never"), (4, "Kurbel", "crank", "always")], "term_id int, src string, tgt string, policy string")
    known = spark.createDataFrame([(2, "rolle")], "chapter int, src string")
    got = {r.segment_id: r.text for r in M.first_mention_texts(frame, terms, introduced=known)[0].collect()}
    assert got == {
        "h": "The lever", "a": "A lever (Hebel) and a lever lift.", "b": "Levers and *pulley* (Rolle), pulley.", "c": "No pulley; wheel and wheel.", "d": "crank (Kurbel)",
    }


def test_import_by_profile(spark):
    current = spark.createDataFrame([(1, "en", "user_edited", "mine", 1)], "segment_id long, lang string, status string, text string, version int")
    results = spark.createDataFrame([(1, "en", "new  text", 0.9, None), (2, "en", "a  lever", 0.8, None), (3, "en", "gone `x`", 0.9, None), (4, "en", "fine", 0.9, "low")], "segment_id long, lang string, text string, confidence double, flag string")
    sources = spark.createDataFrame([(k, 1, k, "p", "quelle") for k in (1, 2, 3, 4)], "segment_id long, chapter int, ord long, type string, src string")

    def run(**options):
        out = Q.import_results(current, results, sources, "en", **options)
        return {r.segment_id: (r.status, r.text) for r in out.translations.collect()}, {(r.segment_id, r.code) for r in out.flags.collect()}

    texts, flags = run(profile="best")
    assert texts == {1: ("user_edited", "mine"), 2: ("flagged", "a lever"), 3: ("flagged", "gone `x`"), 4: ("flagged", "fine")}
    assert flags == {(2, "low_confidence"), (3, "markup"), (4, "editor")}
    assert run(profile="balanced")[0][2] == ("final", "a lever")
    assert {s for s, _ in run(task="translate")[0].values()} == {"user_edited", "drafted"}
    texts, flags = run(task="translate", profile="economy")
    assert texts[3][0] == "flagged" and texts[4][0] == "final" and flags == {(3, "markup")}
    terms = spark.createDataFrame([("t", "Hebel", "lever", "concept", "first_in_chapter")], "term_id string, src string, tgt string, kind string, policy string")
    assert run(terms=terms)[0][2][1] == "a lever (Hebel)"


def test_running_heads(spark):
    rows = [(p, 10.0, "Levers and Loads", 9.0) for p in range(2)] + [(p, 60.0 + 14 * k, f"Body line {p} {k}", 10.0) for p in range(8) for k in range(6)]
    rows += [(0, 100.0, "LEVERS AND LOADS", 18.0), (2, 580.0, "- 3 -", 9.0), (3, 580.0, "xii", 9.0), (4, 10.0, "12   Old Machines", 9.0), (5, 10.0, "13   Old Machines", 9.0), (6, 10.0, "Only here", 9.0)]
    lines = spark.createDataFrame([("d", p, y, 50.0, 90.0, t, s) for p, y, t, s in rows], "doc_id string, page int, y double, x0 double, x1 double, text string, size double")
    ranges = spark.createDataFrame([("d", 0, 3), ("d", 4, 7)], "doc_id string, start int, end int")
    kept, printed = G.remove_headers_footers(lines, 600.0, ranges=ranges)
    texts = {r.text for r in kept.collect()}
    assert {"Only here", "LEVERS AND LOADS"} <= texts and len(texts) == 50
    assert {r.page: r.printed for r in printed.collect()} == {2: "3", 3: "xii", 4: "12", 5: "13"}


def test_titles_over_two_blocks(spark):
    entries = spark.createDataFrame([("d", 0, "3 the mechanical advantage of levers", 0), ("d", 1, "loads", 1)], "doc_id string, lid int, title string, page int")
    blocks = spark.createDataFrame([("d", 0, "loads", 0, "heading", 1), ("d", 1, "the mechanical advantage", 0, "heading", 3), ("d", 2, "of levers", 0, "heading", 2), ("d", 3, "loads", 1, "paragraph", 1)], "doc_id string, rid long, title string, page int, type string, words int")
    got = [(r.lid, r.rid, r.score) for r in J.similar_titles(entries, blocks).orderBy("lid").collect()]
    assert got == [(0, 1, 1.0), (1, 3, 0.9)]


def test_sentences(spark):
    texts = ['One. Two! "Three?" Four', "a.b c…  d\ne", " ", "فارسی؟ بله."]
    assert values(spark, texts, T.sentences) == [["One.", "Two!", '"Three?"', "Four"], ["a.b c…", "d", "e"], [], ["فارسی؟", "بله."]]


def test_reading_search(spark):
    from vellumspark.operators import search as S

    rows = [(1, "n1", 1, 0, "source", "The *lever* moves loads"), (2, "n1", 1, 1, "source", "a load moves the lever"), (3, "n2", 2, 0, "source", "levers: the lever moves, the lever moves"), (3, "n2", 2, 0, "target", "el lever moves"), (4, "n3", 3, 0, "target", "LEVÉR MOVES")]
    segments = spark.createDataFrame(rows, "seg_id long, node string, node_pos int, ord int, side string, text string")
    asked = spark.createDataFrame([(1, "Lever  mov"), (2, "l")], "query_id int, query string")
    terms = spark.createDataFrame([("t1", "lever move", "x"), ("t2", "lever", "y"), ("t3", "a", "Lever moves")], "term_id string, src string, tgt string")
    hits, glossary = S.prefix_search(segments, asked, terms)
    assert sorted((r.node, r.seg_id, r.side, r.found) for r in hits.collect()) == [("n1", 1, "source", 1), ("n2", 3, "source", 2), ("n2", 3, "target", 1), ("n3", 4, "target", 1)]
    assert {r.term_id for r in glossary.collect()} == {"t1", "t3"}
    hits, _ = S.prefix_search(segments, asked, shown=2)
    assert {r.node for r in hits.collect()} == {"n1", "n2"}
