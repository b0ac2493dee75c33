"""Queries of layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.functions import text as T
from vellumspark.operators import joins as J
from vellumspark.operators import layout as L
from vellumspark.plans import reports as R
from vellumspark.queries.relational import NORM, dice_sql
from vellumspark.registry import query
from vellumspark.sources import adapters as A


def _blocks(spark, d):
    return A.segments(spark, d).select("doc_id", "ord", F.lit("paragraph").alias("type"), F.lit(0.0).alias("indent"), "text")


@query(
    "win4_merge_continuations",
    f"""WITH {A.SEGMENTS}, b AS (SELECT doc_id, ord, text, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM seg),
    f AS (SELECT *, p IS NULL OR regexp_matches(text, '^\\s*(?:[•◦▪●○■□–—*·]|\\(?(?:\\d{{1,3}}|[A-Za-z]|[ivxIVX]{{1,4}})[.)])\\s+') OR NOT (NOT regexp_matches(regexp_replace(p, '(\\s*\\[\\^[^\\]]+\\])+\\s*$', ''), '[.!?…:;؟۔»\"”'')\\]]\\s*$') OR regexp_matches(rtrim(p), '[A-Za-z]-\\s*$')) AS brk FROM b),
    g AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT doc_id, min(ord) AS ord, count(*)::INT AS parts FROM g GROUP BY doc_id, g""",
)
def continuations(spark, d):
    return L.merge_continuations(_blocks(spark, d), ["doc_id"], "ord").select("doc_id", "ord", "parts")


def _lines(spark, d):
    return A.lines(spark, d).withColumn("bold", F.lit(False)).withColumn("mono", F.lit(False)).withColumn("line_id", F.col("ord"))


def _two_columns(spark, d):
    """All lines; those of even documents are set left and right by turns, every tenth over both columns."""
    lines = A.lines(spark, d)
    w, x0 = F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc_id", "page")), F.col("x0")
    even, tenth, right = F.col("doc_id") % 2 == 0, F.col("ord") % 10 == 0, F.col("ord") % 2 == 1
    moved = lines.withColumn("_w", w + 20)
    shift = F.when(even & right, 1.1 * F.col("_w")).otherwise(0.0)
    start, end = x0 + shift, F.when(even & tenth, x0 + 2 * F.col("_w")).otherwise(F.col("x1") + shift)
    return moved.select("doc_id", "ord", "page", "y", start.alias("x0"), end.alias("x1"), "size", "text")


def order_sql(source: str) -> str:
    """Reading order of lines (doc_id, page, ord, y, x0, x1 and more) of the given table, as table od."""
    return f"""lm AS (SELECT *, (min(x0) OVER pg + max(x1) OVER pg) / 2 AS mid, (max(x1) OVER pg - min(x0) OVER pg) * 0.02 AS gut, count(*) OVER pg AS np FROM {source} WINDOW pg AS (PARTITION BY doc_id, page)),
    ls AS (SELECT *, x1 <= mid + gut AS l, x0 >= mid - gut AS r FROM lm), lt AS (SELECT *, np >= 6 AND sum(l::INT) OVER pg >= 0.25 * np AND sum(r::INT) OVER pg >= 0.25 * np AS two FROM ls WINDOW pg AS (PARTITION BY doc_id, page)),
    lc AS (SELECT *, two AND NOT l AND NOT r AS span, CASE WHEN NOT two OR (NOT l AND NOT r) THEN 0 WHEN l THEN 1 ELSE 2 END AS "column" FROM lt),
    lg AS (SELECT *, 2 * coalesce(sum(span::INT) OVER (PARTITION BY doc_id, page ORDER BY y, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + span::INT AS g FROM lc),
    od AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY g, "column", y, x0))::INT AS pos FROM lg)"""


TWO_COLUMNS = """w2 AS (SELECT *, max(x1 - x0) OVER (PARTITION BY doc_id, page) + 20 AS w FROM ln),
    c2 AS (SELECT * EXCLUDE (x0, x1), x0 + CASE WHEN doc_id % 2 = 0 AND ord % 2 = 1 THEN 1.1::DOUBLE * w ELSE 0 END AS x0, CASE WHEN doc_id % 2 = 0 AND ord % 10 = 0 THEN x0 + 2 * w WHEN doc_id % 2 = 0 AND ord % 2 = 1 THEN x1 + 1.1::DOUBLE * w ELSE x1 END AS x1 FROM w2)"""


@query("win10_reading_order", f'WITH {A.LINES}, {TWO_COLUMNS}, {order_sql("c2")} SELECT doc_id, ord, "column", pos FROM od')
def order(spark, d):
    return L.reading_order(_two_columns(spark, d)).select("doc_id", "ord", "column", "pos")


STATS = """bs AS (SELECT doc_id, max_by(s, (w, -p)) AS body_size FROM (SELECT doc_id, floor(size / 0.5 + 0.5) * 0.5 AS s, sum(length(text)) AS w, min(page * 100000 + y) AS p FROM ln GROUP BY 1, 2) GROUP BY 1),
    gp AS (SELECT doc_id, body_size, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS gap FROM ln JOIN bs USING (doc_id) WHERE abs(size - body_size) < 0.6),
    gk AS (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY gap) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM gp WHERE gap > body_size * 0.8 AND gap < body_size * 2.2),
    st AS (SELECT doc_id, body_size::DOUBLE AS body_size, coalesce(gap, body_size * 1.25)::DOUBLE AS line_gap FROM bs LEFT JOIN (SELECT * FROM gk WHERE k = floor((n - 1) * 0.5::DOUBLE + 0.5) + 1) USING (doc_id))"""


@query("agg6_document_stats", f"WITH {A.LINES}, {STATS} SELECT * FROM st")
def stats(spark, d):
    return L.document_stats(A.lines(spark, d)).select("doc_id", F.col("body_size").cast("double").alias("body_size"), F.col("line_gap").cast("double").alias("line_gap"))


MARK = L.MARKER.replace("'", "''")
ENDED = """regexp_matches(regexp_replace({}, '(\\s*\\[\\^[^\\]]+\\])+\\s*$', ''), '[.!?…:;؟۔»"”'')\\]]\\s*$')"""


@query(
    "win7_paragraph_blocks",
    f"""WITH {A.LINES}, {STATS}, {order_sql("ln")}, e AS (SELECT *, quantile_cont(x0, 0.1) OVER cl AS el, quantile_cont(x1, 0.9) OVER cl AS er FROM od JOIN st USING (doc_id) WINDOW cl AS (PARTITION BY doc_id, page, "column")),
    v AS (SELECT *, regexp_matches(text, '{MARK}') AS marker, lag("column") OVER w AS pc, lag(size) OVER w AS ps, lag(y) OVER w AS py, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(text) OVER w AS pt FROM e WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
    f AS (SELECT *, coalesce("column" <> pc OR y - py > CASE WHEN abs(ps - body_size) < 0.6 THEN line_gap ELSE ps * 1.2 END * 1.35 OR y - py < 0 OR abs(size - ps) > 0.6 OR marker, TRUE) AS hard,
      coalesce((x0 - el > size * 0.6 AND px0 - el < size * 0.3) OR ({ENDED.format("pt")} AND er - px1 > length(regexp_extract(text, '^\\S+')) * size * 0.5 + size * 0.5), FALSE) AS soft FROM v),
    h AS (SELECT *, sum(hard::INT) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM f),
    n AS (SELECT *, first_value(marker) OVER hw AND x0 - el > size * 0.3 AND abs(x0 - first_value(x0 + length(regexp_extract(text, '{MARK}')) * size * 0.5) OVER hw) < size AS hang FROM h WINDOW hw AS (PARTITION BY doc_id, page, h ORDER BY pos)),
    b AS (SELECT *, sum((hard OR (soft AND NOT hang))::INT) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM n)
    SELECT doc_id, page, block::BIGINT AS block, count(*) AS n_lines, coalesce(replace(regexp_replace(string_agg(trim(text), chr(10) ORDER BY pos) FILTER (WHERE trim(text) <> ''), '([A-Za-z])-\n([a-z])', '\\1\\2', 'g'), chr(10), ' '), '') AS text FROM b GROUP BY 1, 2, 3""",
)
def paragraphs(spark, d):
    lines = _lines(spark, d)
    return L.join_block_text(L.paragraph_blocks(L.reading_order(lines), L.document_stats(lines))).select("doc_id", "page", "block", "n_lines", F.trim("text").alias("text"))


@query("win8_group_baselines", f"WITH {A.LINES} SELECT doc_id, page, ord, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y))::INT + k * 0 AS line_id, k AS part FROM ln, (SELECT unnest([0, 1]) AS k) WHERE text <> ''")
def baselines(spark, d):
    """Every line as two halves that touch, the second a little raised."""
    n = F.floor(F.char_length("text") / 2)
    half = A.lines(spark, d).where("text <> ''").select("doc_id", "page", "ord", "y", "x0", "size", "text", F.posexplode(F.array(F.struct(F.lit(0.0).alias("at"), (5.0 * n).alias("w"), F.lit(0.0).alias("up")), F.struct((5.0 * n).alias("at"), (5.0 * (F.char_length("text") - n)).alias("w"), F.lit(1.0).alias("up")))).alias("part", "h"))
    items = half.select("doc_id", "page", "ord", "part", "text", (F.col("x0") + F.col("h.at")).alias("x"), (F.col("y") - F.col("h.up")).alias("y"), F.col("h.w").alias("width"), "size")
    return L.group_baselines(items).select("doc_id", "page", "ord", "line_id", "part")


@query("agg25_build_lines", f"WITH {A.LINES}, q AS (SELECT *, length(text) % 7 = 0 AND length(text) >= 14 AS s FROM ln WHERE text <> '') SELECT doc_id, page, y, size, x0, x1 + CASE WHEN s THEN 5 ELSE 0 END AS x1, trim(text || CASE WHEN s THEN '3' ELSE '' END) AS text, s::INT AS superscripts FROM q")
def lines(spark, d):
    """Lines in two halves, some with a small raised number behind."""
    half = A.lines(spark, d).where("text <> ''").withColumn("k", (F.char_length("text") / 2).cast("int"))
    part = lambda rows, x, t, size, up: rows.select("doc_id", "page", t.alias("text"), x.alias("x"), (F.col("y") - up).alias("y"), (F.char_length(t) * 5.0).alias("width"), size.alias("size"))
    a = part(half, F.col("x0"), F.substring("text", F.lit(1), F.col("k")), F.col("size"), 0.0)
    b = part(half, F.col("x0") + 5 * F.col("k"), F.substring("text", F.col("k") + 1, F.char_length("text")), F.col("size"), 0.0)
    c = part(half.where("char_length(text) % 7 = 0 and char_length(text) >= 14"), F.col("x1"), F.lit("3"), F.col("size") * 0.6, 0.25 * F.col("size"))
    return L.build_lines(L.group_baselines(a.unionByName(b).unionByName(c))).select("doc_id", "page", "y", "size", "x0", "x1", "text", "superscripts")


@query("win5_merge_across_pages")
def across(spark, d):
    b = A.lines(spark, d).withColumns({"type": F.lit("paragraph"), "column": F.lit(0), "indent": F.lit(0.0), "text_x": F.lit(None).cast("double")})
    return L.merge_across_pages(b, "doc_id", "ord")


@query(
    "txt11_classify_blocks",
    f"""WITH {A.BLOCKS}, w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM blk)
    SELECT page_id, ord, CASE WHEN regexp_matches(text, '(?i)^(?:figure|fig\\.|table|exhibit|chart|plate)\\s+[\\dIVX]+') AND n < 80 THEN 'caption' WHEN type = 'heading' AND n <= 30 THEN 'heading'
      WHEN regexp_matches(text, '^\\s*(?:[•◦▪●○■□–—*·]|\\(?(?:\\d{{1,3}}|[A-Za-z]|[ivxIVX]{{1,4}})[.)])\\s+') AND n > 1 THEN 'list_item' ELSE 'paragraph' END AS type FROM w""",
)
def types(spark, d):
    b = A.blocks(spark, d).select("page_id", "ord", "text", F.when(F.col("type") == "heading", 14.0).otherwise(10.0).alias("size"), F.lit(10.0).alias("body_size"), F.lit(False).alias("bold"), F.lit(False).alias("mono"), F.lit(2).alias("n_lines"), F.lit(50.0).alias("x0"), F.lit(300.0).alias("x1"), F.lit(50.0).alias("edge_left"), F.lit(300.0).alias("edge_right"), F.lit(100.0).alias("y"))
    return L.classify_blocks(b).select("page_id", "ord", "type")


TITLES = "CASE p_partkey % 8 WHEN 0 THEN 'Preface: ' WHEN 1 THEN 'Appendix ' WHEN 2 THEN 'Part ' WHEN 3 THEN 'Index of ' ELSE '' END || p_name"


@query(
    "txt12_classify_titles",
    f"""WITH e AS (SELECT p_size, p_partkey, lower({TITLES}) AS t, p_partkey % 3 AS depth FROM part), f AS (SELECT *, starts_with(t, 'preface') AS front, regexp_matches(t, '^(?:appendix|index)\\b') AS back FROM e),
    b AS (SELECT *, min(CASE WHEN NOT front AND NOT back THEN p_partkey END) OVER (PARTITION BY p_size) AS lo, max(CASE WHEN NOT front AND NOT back THEN p_partkey END) OVER (PARTITION BY p_size) AS hi FROM f)
    SELECT p_partkey, CASE WHEN front AND p_partkey < coalesce(lo, 1 << 30) THEN 'front' WHEN back AND p_partkey > coalesce(hi, -1) THEN 'back' WHEN regexp_matches(t, '^part\\b') THEN 'part' WHEN depth = 0 THEN 'chapter' WHEN depth = 1 THEN 'section' ELSE 'subsection' END AS kind, regexp_matches(t, '^index\\b') AS skip FROM b""",
)
def kinds(spark, d):
    """Parts of one size are a document, in the order of their keys."""
    lead = F.element_at(F.array(*(F.lit(x) for x in ("Preface: ", "Appendix ", "Part ", "Index of ", "", "", "", ""))), (F.col("p_partkey") % 8 + 1).cast("int"))
    h = A.table(spark, d, "part").select("p_size", "p_partkey", F.concat(lead, "p_name").alias("title"), (F.col("p_partkey") % 3).alias("depth"))
    return L.classify_titles(h, "p_size", "p_partkey").select("p_partkey", "kind", "skip")


@query(
    "tree10_build_structure",
    f"""WITH {A.BLOCKS}, en AS (SELECT page_id, ord, CASE WHEN page_id % 2 = 1 THEN level WHEN ord % 8 = 4 THEN 2 ELSE 1 END AS depth FROM blk WHERE CASE WHEN page_id % 2 = 0 THEN ord % 4 = 0 ELSE type = 'heading' END),
    pa AS (SELECT page_id, ord, depth, CASE WHEN depth > 1 THEN max(CASE WHEN depth = 1 THEN ord END) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS parent FROM en),
    kd AS (SELECT blk.page_id, blk.ord, blk.type, coalesce(max(en.ord), -1) AS key FROM blk LEFT JOIN en ON en.page_id = blk.page_id AND en.ord <= blk.ord GROUP BY 1, 2, 3),
    ow AS (SELECT *, ord <> key AND EXISTS (SELECT 1 FROM pa WHERE pa.page_id = kd.page_id AND pa.parent = kd.key) AS intro FROM kd)
    SELECT page_id AS doc_id, ord, key::INT AS pos, CASE WHEN key = -1 THEN 'front' WHEN intro THEN 'intro' ELSE 'section' END AS kind, (row_number() OVER (PARTITION BY page_id, key, intro ORDER BY ord) - 1)::INT AS seq,
      CASE WHEN intro THEN key WHEN key >= 0 THEN (SELECT parent FROM pa WHERE pa.page_id = ow.page_id AND pa.ord = ow.key) END::INT AS parent_pos FROM ow""",
)
def structure(spark, d):
    """Even pages have an outline at every fourth block, of two depths; the others have their headings."""
    b = A.blocks(spark, d).withColumnRenamed("page_id", "doc_id")
    outline = b.where("doc_id % 2 = 0 and ord % 4 = 0").select("doc_id", "ord", F.when(F.col("ord") % 8 == 4, 2).otherwise(1).alias("depth"), F.lit("t").alias("title"))
    nodes, segments = L.build_structure(b, outline)
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("pos").alias("parent_pos"))
    named = nodes.join(up, ["doc_id", "parent_id"], "left").select("doc_id", "node_id", "pos", "kind", "parent_pos")
    return segments.join(named, ["doc_id", "node_id"]).select("doc_id", "ord", "pos", "kind", "seq", "parent_pos")


@query(
    "join9_running_title_lines",
    f"""WITH {A.LINES}, x AS (SELECT doc_id, ord AS lid, {NORM.format("text")} AS title FROM ln WHERE (y <= 48 + size OR y >= 552) AND size <= 10.5),
    z AS (SELECT doc_id, ord AS rid, {NORM.format("text")} AS title FROM ln WHERE ord % 40 < 2), {dice_sql("x", "z", "doc_id")} SELECT DISTINCT doc_id, lid AS ord FROM dc WHERE score >= 0.9""",
)
def running(spark, d):
    """Titles are the first two lines of every page."""
    lines = A.lines(spark, d)
    t = lines.where("ord % 40 < 2").select("doc_id", F.col("ord").alias("rid"), F.col("text").alias("title"))
    return J.running_title_lines(lines, t, 600.0).select("doc_id", "ord")


@query(
    "agg17_extraction_report",
    f"""WITH {A.BLOCKS}, b AS (SELECT *, type = 'paragraph' AND NOT {ENDED.format("text")} AS broken FROM blk)
    SELECT page_id, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words, count(*) FILTER (WHERE type = 'heading') AS sections, count(*) FILTER (WHERE broken) AS broken, count(*) FILTER (WHERE type = 'paragraph') AS paragraphs,
      count(*) FILTER (WHERE type = 'list_item') AS list_items, round(count(*) FILTER (WHERE broken) / greatest(count(*) FILTER (WHERE type = 'paragraph'), 1), 4) AS break_ratio FROM b GROUP BY 1""",
)
def report(spark, d):
    r = R.extraction_report(A.blocks(spark, d), "page_id")
    return r.select("page_id", "words", "sections", "broken", "paragraphs", F.coalesce(F.try_element_at("by_type", F.lit("list_item")), F.lit(0)).alias("list_items"), "break_ratio")


@query(
    "agg21_estimate",
    f"""WITH RECURSIVE {A.TRANSLATIONS}, {A.SEGMENTS}, tk AS (SELECT doc_id, ord, len(regexp_extract_all(text, '\\S+'))::BIGINT AS w, CASE WHEN status IS NULL OR status IN ('pending', 'queued') THEN 'translate' WHEN status IN ('drafted', 'flagged') THEN 'edit' END AS task
      FROM seg LEFT JOIN (SELECT segment_id, status FROM tr) ON segment_id = doc_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, CASE task WHEN 'edit' THEN 90 ELSE 120 END AS budget FROM tk WHERE task IS NOT NULL),
    pk AS (SELECT doc_id, task, k, w, budget, w AS total, 0 AS chunk FROM rk WHERE k = 1 UNION ALL SELECT r.doc_id, r.task, r.k, r.w, r.budget, CASE WHEN p.total > 0 AND p.total + r.w > r.budget THEN r.w ELSE p.total + r.w END, p.chunk + (p.total > 0 AND p.total + r.w > r.budget)::INT
      FROM pk p JOIN rk r ON r.doc_id = p.doc_id AND r.k = p.k + 1),
    c AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{9,}}')) AS w FROM documents) GROUP BY 1)
    SELECT d.doc_id, coalesce(sum(w) FILTER (WHERE task = 'translate'), 0)::BIGINT AS words, count(*) FILTER (WHERE task = 'translate') AS segments, CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS brief,
      CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE ceil(coalesce(any_value(c.n), 0) / 40) END::BIGINT AS glossary, coalesce(max(chunk) FILTER (WHERE task = 'translate') + 1, 0)::BIGINT AS translate, coalesce(max(chunk) FILTER (WHERE task = 'edit') + 1, 0)::BIGINT AS edit
    FROM documents d LEFT JOIN pk ON pk.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
)
def estimate(spark, d):
    """Documents as books of one node; their candidates are their different long words, and every fourth has its brief."""
    s = A.segments(spark, d).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("node"), F.col("doc_id").alias("segment_id"), "ord", "text")
    words = A.table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).cast("long").alias("n"))
    briefed = words.where("doc_id % 4 = 0").select("doc_id")
    return R.estimate(s, A.translations(spark, d).select("segment_id", "status"), "doc_id", 120, 90, words, briefed)


PLAN = f"""{A.SEGMENTS}, {A.NODES.replace("nd AS (", "tn AS (")}, nx AS (SELECT node_id, (row_number() OVER (ORDER BY node_id)) AS idx FROM tn WHERE depth = 2), hid AS (SELECT c.node_id, c.skip OR n.skip AS hidden FROM tn c JOIN tn n ON n.node_id = c.parent_id WHERE c.depth = 2),
  sg AS (SELECT 'c' || (1 + doc_id % (SELECT count(*) FROM customer)) AS node, doc_id AS segment_id, doc_id * 10000 + ord AS o, len(regexp_extract_all(text, '\\S+'))::BIGINT AS w FROM seg),
  tk AS (SELECT sg.*, CASE WHEN status IS NULL OR status IN ('pending', 'queued') THEN 'translate' WHEN status IN ('drafted', 'flagged') THEN 'edit' END AS task FROM sg LEFT JOIN (SELECT segment_id, status FROM tr) USING (segment_id) JOIN hid ON hid.node_id = node WHERE NOT hidden),
  rk AS (SELECT *, row_number() OVER (PARTITION BY node, task ORDER BY o) AS k, CASE task WHEN 'edit' THEN 240 ELSE 120 END AS budget FROM tk WHERE task IS NOT NULL),
  pk AS (SELECT node, task, k, w, budget, w AS total, 0 AS chunk FROM rk WHERE k = 1 UNION ALL SELECT r.node, r.task, r.k, r.w, r.budget, CASE WHEN p.total > 0 AND p.total + r.w > r.budget THEN r.w ELSE p.total + r.w END, p.chunk + (p.total > 0 AND p.total + r.w > r.budget)::INT
    FROM pk p JOIN rk r ON r.node = p.node AND r.task = p.task AND r.k = p.k + 1),
  gk AS (SELECT node, task, chunk, sum(w)::BIGINT AS words, count(*) AS segments FROM pk GROUP BY 1, 2, 3)"""


@query(
    "agg23_plan_work",
    f"""WITH RECURSIVE {A.TRANSLATIONS}, {PLAN} SELECT node, task, chunk, words, segments, (100 * idx + row_number() OVER w - 1)::BIGINT AS seq, lag(node || ':' || task || ':' || chunk) OVER w AS depends_on FROM gk JOIN nx ON nx.node_id = node WINDOW w AS (PARTITION BY node ORDER BY task DESC, chunk)""",
)
def plan(spark, d):
    """Documents are dealt to the customers of the tree; skipped nodes and what lies under them have no work."""
    from vellumspark.operators.windows import numbered
    from vellumspark.plans.work import plan_work

    n = A.table(spark, d, "customer").count()
    s = A.segments(spark, d).select(F.concat(F.lit("c"), 1 + F.col("doc_id") % n).alias("node"), F.col("doc_id").alias("segment_id"), (F.col("doc_id") * 10000 + F.col("ord")).alias("ord"), "text")
    nodes = A.nodes(spark, d)
    index = numbered(nodes.where("depth = 2").select("node_id"), ["node_id"], "index")
    return plan_work(s, A.translations(spark, d).select("segment_id", "status"), 120, 240, nodes, index)


def laid_out(spark, d):
    items = A.lines(spark, d).select("doc_id", "page", T.clean_run_text(F.col("text")).alias("text"), F.col("x0").alias("x"), "y", (F.col("x1") - F.col("x0")).alias("width"), "size")
    outline = A.lines(spark, d).where("ord % 200 = 0 and trim(text) <> ''").select("doc_id", F.col("ord").alias("lid"), F.col("text").alias("title"), "page", F.lit(1).alias("depth"))
    return L.layout_pipeline(items, outline=outline)


@query("job11_layout_pipeline")
def pipeline(spark, d):
    """Every segment with its block, page label and node."""
    out = laid_out(spark, d)
    nodes = out.nodes.select("doc_id", "node_id", "title", "kind")
    s = out.segments.withColumn("page", F.floor(F.col("ord") / 100000).cast("int"))
    return s.join(nodes, ["doc_id", "node_id"]).join(out.labels, ["doc_id", "page"]).select("doc_id", "ord", "type", "text", "seq", "title", "kind", "label")


@query("job11_layout_report")
def layout_report(spark, d):
    return laid_out(spark, d).report.drop("by_type")


DASH = """it AS (SELECT o_custkey AS book, o_orderkey AS id, o_orderkey % 5 AS chapter, o_orderpriority AS stage, o_orderdate AS "at", CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'e' || o_orderkey % 13 END AS error FROM orders)"""


def _work(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(k % 7 == 0, "failed").otherwise("succeeded")
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("book"), k.alias("id"), (k % 5).alias("chapter"), F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("at"), status.alias("status"), F.when((k % 7 == 0) | (k % 11 == 0), F.concat(F.lit("e"), k % 13)).alias("error"))


@query(
    "job12_status_dashboard",
    f"""WITH {DASH}, s AS (SELECT book, stage, count(*) FILTER (WHERE status = 'succeeded') AS ok, count(*) AS n FROM it GROUP BY 1, 2), f AS (SELECT book, min(stage) FILTER (WHERE ok < n) AS open_stage FROM s GROUP BY 1)
    SELECT book, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) AS total, count(error) AS errors, any_value(open_stage) AS open_stage, round(count(*) FILTER (WHERE status = 'succeeded') / count(*), 6) AS share FROM it JOIN f USING (book) GROUP BY 1""",
)
def dashboard(spark, d):
    return R.status_dashboard(_work(spark, d), "book")[0]


@query("job12_chapters", f"WITH {DASH} SELECT book, chapter, count(*) FILTER (WHERE status = 'succeeded') AS done, count(*) AS total FROM it GROUP BY 1, 2")
def dashboard_chapters(spark, d):
    return R.status_dashboard(_work(spark, d), "book")[1]


@query("job12_errors", f"WITH {DASH} SELECT * FROM (SELECT book, id, error, (row_number() OVER (PARTITION BY book ORDER BY \"at\" DESC, id))::INT AS k FROM it WHERE error IS NOT NULL) WHERE k <= 20")
def dashboard_errors(spark, d):
    return R.status_dashboard(_work(spark, d), "book")[2]


FIRST = "CASE WHEN regexp_extract(text, '^\\s*(.+?[.!?…])(?:\\s|$)', 1) = '' THEN trim(text) ELSE regexp_extract(text, '^\\s*(.+?[.!?…])(?:\\s|$)', 1) END"


@query("job13_extractive_digest", f"WITH {A.SEGMENTS}, s AS (SELECT doc_id, ord, {FIRST} AS f, trim(regexp_extract(text, '([^.!?…]+[.!?…]*)\\s*$', 1)) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM seg WHERE trim(text) <> '') SELECT doc_id, min_by(f, k) AS opening, string_agg(f, '|' ORDER BY k) FILTER (WHERE k <= 7) AS points, max_by(l, k) AS closing FROM s GROUP BY 1")
def digest(spark, d):
    return R.extractive_digest(A.segments(spark, d), "doc_id", "ord").select("doc_id", "opening", F.array_join("points", "|").alias("points"), "closing")
