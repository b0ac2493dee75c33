"""Queries over the region, nation and customer tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import aggregates as G
from vellumspark.operators import packing
from vellumspark.operators import tree as R
from vellumspark.operators import windows as W
from vellumspark.plans.reports import library_summary
from vellumspark.queries.relational import NORM, dice_sql
from vellumspark.registry import query
from vellumspark.sources import adapters as A

TREE = f"""{A.NODES}, pt AS (SELECT n.*, [node_id] AS ids, [title] AS titles, lpad(ord::VARCHAR, 10, '0') AS path, skip AS hidden, node_id AS root FROM nd n WHERE depth = 0
  UNION ALL SELECT n.*, [p.node_id, n.node_id], [p.title, n.title], lpad(p.ord::VARCHAR, 10, '0') || '/' || lpad(n.ord::VARCHAR, 10, '0'), p.skip OR n.skip, p.node_id FROM nd n JOIN nd p ON p.node_id = n.parent_id WHERE n.depth = 1
  UNION ALL SELECT n.*, [g.node_id, p.node_id, n.node_id], [g.title, p.title, n.title], lpad(g.ord::VARCHAR, 10, '0') || '/' || lpad(p.ord::VARCHAR, 10, '0') || '/' || lpad(n.ord::VARCHAR, 10, '0'), g.skip OR p.skip OR n.skip, g.node_id
  FROM nd n JOIN nd p ON p.node_id = n.parent_id JOIN nd g ON g.node_id = p.parent_id WHERE n.depth = 2),
cl AS (SELECT node_id AS ancestor, node_id AS node, 0 AS distance FROM nd UNION ALL SELECT parent_id, node_id, 1 FROM nd WHERE parent_id IS NOT NULL AND NOT skip
  UNION ALL SELECT p.parent_id, n.node_id, 2 FROM nd n JOIN nd p ON p.node_id = n.parent_id WHERE p.parent_id IS NOT NULL AND NOT n.skip AND NOT p.skip),
rd AS (SELECT pt.* FROM pt LEFT JOIN (SELECT DISTINCT parent_id AS q FROM nd) ON q = node_id WHERE NOT skip AND (kind = 'section' OR q IS NULL))"""
STATE = """tx AS (SELECT o_orderkey AS segment_id, 'c' || o_custkey AS node_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'pending' ELSE 'final' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'agent' ELSE 'api' END AS engine FROM orders WHERE o_orderkey % 3 <> 0)"""


def nodes(spark, d):
    return A.nodes(spark, d)


def segments(spark, d):
    return A.table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("segment_id"), F.concat(F.lit("c"), "o_custkey").alias("node_id"))


def states(spark, d):
    o = A.table(spark, d, "orders").where("o_orderkey % 3 <> 0")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "pending").otherwise("final")
    return o.select(F.col("o_orderkey").alias("segment_id"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "agent").otherwise(F.lit("api")).alias("engine"))


@query("tree1_effective_skip", f"WITH {TREE} SELECT node_id, hidden AS skip FROM pt")
def skip(spark, d):
    return R.effective_skip(nodes(spark, d))


@query("tree2_closure", f"WITH {TREE} SELECT * FROM cl")
def closure(spark, d):
    return R.closure(nodes(spark, d))


@query("tree3_chapter_of", f"WITH {TREE} SELECT node_id, ids[2] AS chapter, root FROM pt")
def chapter(spark, d):
    return R.chapter_of(nodes(spark, d))


@query("tree4_document_order", f"WITH {TREE} SELECT node_id, (row_number() OVER (PARTITION BY root ORDER BY path))::INT AS pos FROM pt")
def order(spark, d):
    return R.document_order(nodes(spark, d)).select("node_id", "pos")


@query("tree5_location_path", f"WITH {TREE} SELECT node_id, array_to_string(titles, ' > ') AS location FROM pt")
def location(spark, d):
    return R.location_path(nodes(spark, d)).select("node_id", F.array_join("location", " > ").alias("location"))


@query("tree6_first_readable", f"WITH {TREE} SELECT a AS node_id, min_by(node_id, path) AS target FROM (SELECT node_id, path, unnest(ids) AS a FROM rd) GROUP BY 1")
def first(spark, d):
    return R.first_readable(nodes(spark, d))


STATUS = f"""WITH {TREE}, {STATE}, g AS (SELECT ancestor, count(*) AS n, count(*) FILTER (WHERE status = 'final') AS done, count(*) FILTER (WHERE status = 'queued' AND engine = 'agent') AS waiting, count(*) FILTER (WHERE status <> 'pending') AS started
  FROM cl JOIN tx ON tx.node_id = cl.node GROUP BY 1),
st AS (SELECT node_id, CASE WHEN n IS NULL OR done = n THEN 'final' WHEN waiting > 0 THEN 'waiting_agent' WHEN started = 0 THEN 'not_started' ELSE 'in_progress' END AS status FROM nd LEFT JOIN g ON ancestor = node_id)"""


@query("agg18_node_status", STATUS + " SELECT * FROM st")
def status(spark, d):
    return R.node_status(nodes(spark, d), segments(spark, d), states(spark, d))


@query("agg19_chapter_progress", f"WITH {TREE}, {STATE} SELECT root, count(*) FILTER (WHERE status = 'final') AS done, count(*) AS total, 0::BIGINT AS flagged FROM tx JOIN pt USING (node_id) WHERE NOT hidden GROUP BY 1")
def progress(spark, d):
    return R.chapter_progress(nodes(spark, d), segments(spark, d), states(spark, d))


@query("tree7_toc_rows", STATUS + ", f AS (SELECT a AS node_id, min_by(node_id, path) AS target FROM (SELECT node_id, path, unnest(ids) AS a FROM rd) GROUP BY 1) SELECT pt.node_id, title, status, target FROM pt JOIN st USING (node_id) LEFT JOIN f USING (node_id) WHERE NOT hidden")
def toc(spark, d):
    return R.toc_rows(nodes(spark, d), segments(spark, d), states(spark, d)).select("node_id", "title", "status", "target")


@query("top9_toc_sample", f"WITH {TREE} SELECT root, pos, repeat('  ', depth) || title AS line FROM (SELECT *, (row_number() OVER (PARTITION BY root ORDER BY path))::INT AS pos FROM pt) WHERE pos <= 120")
def sample(spark, d):
    return R.toc_sample(nodes(spark, d), 120)


@query(
    "tree8_section_rows",
    f"""WITH {TREE}, {STATE}, nav AS (SELECT node_id, lag(node_id) OVER w AS prev, lead(node_id) OVER w AS next FROM rd WINDOW w AS (PARTITION BY root ORDER BY path))
    SELECT segment_id, node_id, (row_number() OVER (PARTITION BY node_id ORDER BY segment_id))::BIGINT AS number, status, prev, next FROM tx JOIN nav USING (node_id)""",
)
def sections(spark, d):
    s = segments(spark, d).withColumn("ord", F.col("segment_id")).withColumn("type", F.lit("paragraph"))
    t = states(spark, d).withColumn("final", F.lit("x")).withColumn("draft", F.lit("x"))
    return R.section_rows(nodes(spark, d), s, t).select("segment_id", "node_id", "number", "status", "prev", "next")


@query("win3_prev_next", f"WITH {TREE} SELECT node_id, lag(node_id) OVER w AS prev, lead(node_id) OVER w AS next, coalesce(lead(ids[2]) OVER w <> ids[2], TRUE) AS last_of_chapter FROM pt WHERE depth = 2 WINDOW w AS (PARTITION BY root ORDER BY path)")
def neighbours(spark, d):
    p = R.with_paths(nodes(spark, d)).where("depth = 2").select("node_id", F.col("ids")[0].alias("root"), F.col("ids")[1].alias("chapter"), "path")
    return W.prev_next(p, "root", ["path"], "chapter").select("node_id", "prev", "next", "last_of_chapter")


@query("agg2_status_counts", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'X') AS rejected FROM orders GROUP BY 1")
def status_counts(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 100000, "e").alias("error"))
    return G.status_counts(o)


@query("agg3_task_status_pivot", 'SELECT o_custkey AS book, count(*) FILTER (WHERE o_orderstatus = \'O\') AS "O", count(*) FILTER (WHERE o_orderstatus = \'P\') AS "P", count(*) FILTER (WHERE o_orderstatus = \'F\') AS "F" FROM orders GROUP BY 1')
def pivot(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderstatus").alias("status"))
    return G.task_status_pivot(o, "book", ["O", "P", "F"])


@query("agg4_weighted_mode", f"WITH {A.LINES}, b AS (SELECT doc_id, floor((length(text) % 7) / 4.0 / 0.5 + 0.5) * 0.5 AS mode, sum(length(text)) AS w, min(ord) AS p FROM ln GROUP BY 1, 2) SELECT doc_id, max_by(mode, (w, -p))::DOUBLE AS mode FROM b GROUP BY 1")
def mode(spark, d):
    lines = A.lines(spark, d).withColumn("size", (F.char_length("text") % 7) / 4.0).withColumn("weight", F.char_length("text"))
    return G.weighted_mode(lines, ["doc_id"], "size", "weight", "ord").select("doc_id", F.col("mode").cast("double").alias("mode"))


@query("agg5_nearest_rank_percentile", f"WITH {A.LINES}, r AS (SELECT doc_id, x1, row_number() OVER (PARTITION BY doc_id ORDER BY x1) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM ln) SELECT doc_id, x1::DOUBLE AS value FROM r WHERE k = floor((n - 1) * 0.9::DOUBLE + 0.5) + 1")
def percentile(spark, d):
    return G.nearest_rank_percentile(A.lines(spark, d), ["doc_id"], "x1", 0.9)


@query(
    "agg10_length_outliers",
    f"""WITH {A.PAIRS}, r AS (SELECT conv_id, turn, conv_id % 5 AS g, ln(length(tgt) / length(src)) AS ratio FROM prs WHERE length(src) >= 40 AND length(tgt) > 0),
    m AS (SELECT g, median(ratio) AS med FROM r GROUP BY 1 HAVING count(*) >= 5), v AS (SELECT r.*, abs(ratio - med) AS dev FROM r JOIN m USING (g)), a AS (SELECT g, CASE WHEN median(dev) = 0 THEN 0.05 ELSE median(dev) END AS mad FROM v GROUP BY 1)
    SELECT conv_id, turn, round(0.6745 * dev / mad, 6) AS z FROM v JOIN a USING (g) WHERE 0.6745 * dev / mad > 3.5""",
)
def outliers(spark, d):
    p = A.pairs(spark, d).withColumn("g", F.col("conv_id") % 5)
    return G.length_outliers(p, ["g"]).select("conv_id", "turn", F.round("z", 6).alias("z"))


CHUNKS = f"""{A.SEGMENTS}, sw AS (SELECT doc_id, ord, len(regexp_extract_all(text, '\\S+'))::BIGINT AS w FROM seg),
  ck AS (SELECT doc_id, ord, w AS total, 0 AS chunk FROM sw WHERE ord = 0 UNION ALL SELECT s.doc_id, s.ord, CASE WHEN c.total > 0 AND c.total + s.w > 120 THEN s.w ELSE c.total + s.w END, c.chunk + (c.total > 0 AND c.total + s.w > 120)::INT
    FROM ck c JOIN sw s ON s.doc_id = c.doc_id AND s.ord = c.ord + 1)"""


@query("agg22_chunk_by_budget", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, ord, chunk FROM ck")
def chunks(spark, d):
    s = A.segments(spark, d).withColumn("w", F.regexp_count("text", F.lit(r"\S+")))
    return packing.chunk_by_budget(s, ["doc_id"], "ord", "w", 120)


@query(
    "agg27_repeated_phrases",
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' so it goes so it goes So it goes, end' WHEN doc_id % 3 = 1 THEN 'no no No, no. ' || text ELSE text END AS t FROM documents),
    r AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS w FROM (SELECT doc_id, string_split_regex(lower(t), '[\\s\u200c]+') AS l FROM m)), c AS (SELECT doc_id, k, regexp_replace(regexp_replace(w, '^[\\p{P}\\p{S}]+', ''), '[\\p{P}\\p{S}]+$', '') AS w FROM r),
    p AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM c WHERE w <> ''),
    e AS (SELECT doc_id, pos, w, n, lead(w, n) OVER (PARTITION BY doc_id, n ORDER BY pos) = w AS same FROM p, (SELECT unnest(range(1, 7))::INT AS n)),
    i AS (SELECT doc_id, n, pos, pos - row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS g FROM e WHERE same), u AS (SELECT doc_id, n, min(pos) AS pos, count(*) AS k FROM i GROUP BY doc_id, n, g),
    b AS (SELECT doc_id, min((n, pos)) AS b FROM u WHERE k >= n * CASE WHEN n = 1 THEN 3 ELSE 2 END GROUP BY 1)
    SELECT b.doc_id, string_agg(w, ' ' ORDER BY p.pos) AS phrase FROM b JOIN p ON p.doc_id = b.doc_id AND p.pos BETWEEN b.b[2] AND b.b[2] + b.b[1] - 1 GROUP BY 1""",
)
def phrases(spark, d):
    third = F.col("doc_id") % 3
    text = F.when(third == 0, F.concat("text", F.lit(" so it goes so it goes So it goes, end"))).when(third == 1, F.concat(F.lit("no no No, no. "), "text")).otherwise(F.col("text"))
    return G.repeated_phrases(A.table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query(
    "agg28_script_share",
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' `код` (слово) https://a.b/в' ELSE repeat('слово дело ', length(text) // 12) || text END AS t FROM documents),
    p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '`[^`]+`', ' ', 'g'), 'https?://[^\\s<>"''\\]\\)]*[^\\s<>"''\\]\\).,;:!?]', ' ', 'g'), '\\([^()]*\\)', ' ', 'g') AS p FROM m),
    n AS (SELECT doc_id, len(regexp_extract_all(p, '\\p{Cyrillic}')) AS target, len(regexp_extract_all(p, '\\p{Latin}')) AS latin FROM p)
    SELECT doc_id, target, latin, target + latin >= 3 AND target < 0.5 * (target + latin) AS issue FROM n""",
)
def script(spark, d):
    own = F.expr("repeat('слово дело ', cast(floor(char_length(text) / 12) as int))")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" `код` (слово) https://a.b/в"))).otherwise(F.concat(own, "text"))
    s = G.script_share(A.table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text", "ru")
    return s.select("doc_id", F.col("target").cast("long").alias("target"), F.col("latin").cast("long").alias("latin"), "issue")


@query("agg29_usage_totals", "SELECT user_id, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1")
def usage(spark, d):
    e = A.table(spark, d, "events").withColumn("n", F.lit(1).cast("long"))
    return G.usage_totals(e, ["user_id"], ["value", "n"]).withColumn("value", F.round("value", 4))


@query(
    "agg30_library_summary",
    f"""WITH {A.TRANSLATIONS}, n AS (SELECT source, count(*) AS segments, max(doc_id) AS newest, count(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN doc_id % 9 END) AS readable FROM documents GROUP BY 1),
    o AS (SELECT source, count(*) AS translated, count(*) FILTER (WHERE status IN ('final', 'user_edited')) AS done, count(*) FILTER (WHERE status = 'flagged') AS flagged FROM documents JOIN tr ON segment_id = doc_id GROUP BY 1),
    b AS (SELECT 'src' || user_id % 20 AS source, count(*) AS open_batches FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT source, segments, coalesce(done, 0) AS done, coalesce(flagged, 0) AS flagged, readable, coalesce(open_batches, 0) AS open_batches FROM n LEFT JOIN o USING (source) LEFT JOIN b USING (source)""",
)
def library(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("segment_id"), (F.col("doc_id") % 9).alias("node"), (F.col("doc_id") % 4 == 0).alias("skip"), F.col("doc_id").alias("created"))
    batches = A.table(spark, d, "events").select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("book"), F.when(F.col("event_type") == "error", "open").otherwise("done").alias("state"))
    s = library_summary(docs, A.translations(spark, d).select("segment_id", "status"), batches)
    return s.select(F.col("book").alias("source"), "segments", "done", "flagged", "readable", "open_batches")


@query("agg31_reading_ratio", "SELECT user_id, round(count(DISTINCT event_id % 50) / 50, 6) AS ratio FROM events WHERE event_type = 'view' GROUP BY 1")
def reading(spark, d):
    e = A.table(spark, d, "events").where("event_type = 'view'").withColumn("node", F.col("event_id") % 50)
    return G.reading_ratio(e, 50, "user_id", "node").withColumn("ratio", F.round("ratio", 6))


@query("agg32_quiz_score", "SELECT doc_id % 10 AS user, count(*) AS checked, count(*) FILTER (WHERE quality = toxic) AS correct FROM labels WHERE doc_id % 3 <> 0 GROUP BY 1")
def quiz(spark, d):
    lab = A.table(spark, d, "labels")
    q = lab.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "short").otherwise(F.lit("choice")).alias("kind"), F.col("toxic").alias("solution"))
    return G.quiz_score(lab.select(F.col("doc_id").alias("question_id"), (F.col("doc_id") % 10).alias("user"), F.col("quality").alias("answer")), q, "user")


# Running heads on all pages of even documents, and on the first two of every six of some others.
HEADED = A.LINES.replace("ln AS (", "l0 AS (") + """, ln AS (SELECT * REPLACE (CASE WHEN ord % 40 = 0 AND doc_id % 2 = 0 THEN 'Book iv — ' || (page + 1) WHEN ord % 40 = 1 AND doc_id % 4 = 1 AND page % 6 < 2 THEN 'Head of ' || (page // 6) ELSE text END AS text) FROM l0)"""


def headed(spark, d):
    even, some = (F.col("ord") % 40 == 0) & (F.col("doc_id") % 2 == 0), (F.col("ord") % 40 == 1) & (F.col("doc_id") % 4 == 1) & (F.col("page") % 6 < 2)
    text = F.when(even, F.concat(F.lit("Book iv — "), F.col("page") + 1)).when(some, F.concat(F.lit("Head of "), F.floor(F.col("page") / 6))).otherwise(F.col("text"))
    return A.lines(spark, d).withColumn("text", text)


MARGINS = f"""{HEADED}, m AS (SELECT doc_id, ord, page, y, size, CASE WHEN y <= 48 + size THEN 'top' WHEN y >= 552 THEN 'bottom' END AS zone, text, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\b[ivxlcdm]{{1,7}}\\b', '#', 'g'), '\\s+', ' ', 'g')) AS pattern FROM ln),
  t AS (SELECT doc_id, count(DISTINCT page) AS n, max(page) AS last FROM ln GROUP BY 1), h AS (SELECT doc_id, zone, pattern, count(DISTINCT page) AS pages FROM m WHERE zone IS NOT NULL AND pattern <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 2)"""
WHOLE = ", rp AS (SELECT h.* FROM h JOIN t USING (doc_id) WHERE pages >= 0.25 * n)"


@query("agg7_repeating_margin_lines", "WITH " + MARGINS + WHOLE + " SELECT * FROM rp")
def margins(spark, d):
    return G.repeating_margin_lines(headed(spark, d), 600.0)


@query(
    "agg7_in_chapters",
    "WITH " + MARGINS + """, r AS (SELECT doc_id, k * 6 AS a, least(k * 6 + 5, last) AS b FROM (SELECT doc_id, last, unnest(range(last // 6 + 1)) AS k FROM t)),
    i AS (SELECT DISTINCT doc_id, zone, pattern FROM (SELECT m.doc_id, zone, pattern, a, b, count(DISTINCT page) AS k FROM m JOIN r ON r.doc_id = m.doc_id AND page BETWEEN a AND b WHERE zone IS NOT NULL GROUP BY ALL) WHERE k >= 2 AND k >= ceil((b - a + 1) * 0.25))
    SELECT h.* FROM h JOIN t USING (doc_id) LEFT JOIN i USING (doc_id, zone, pattern) WHERE pages >= 0.25 * n OR i.doc_id IS NOT NULL""",
)
def chapter_margins(spark, d):
    lines = headed(spark, d)
    last = lines.groupBy("doc_id").agg(F.max("page").alias("last"))
    ranges = last.select("doc_id", "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 6).cast("int"))).alias("k")).select("doc_id", (F.col("k") * 6).alias("start"), F.least(F.col("k") * 6 + 5, "last").alias("end"))
    return G.repeating_margin_lines(lines, 600.0, ranges)


@query(
    "agg8_remove_headers_footers",
    "WITH " + MARGINS + WHOLE + f""", bs AS (SELECT doc_id, max_by(s, (w, -p)) AS body FROM (SELECT doc_id, floor(size / 0.5 + 0.5) * 0.5 AS s, sum(length(text)) AS w, min(page * 100000 + y) AS p FROM ln GROUP BY 1, 2) GROUP BY 1),
    lt AS (SELECT DISTINCT doc_id, text AS t FROM ln JOIN bs USING (doc_id) WHERE size >= 1.3 * body AND length(trim(text)) > 2), x AS (SELECT doc_id, ord AS lid, {NORM.format("text")} AS title FROM m JOIN bs USING (doc_id) WHERE zone IS NOT NULL AND size <= 1.05 * body),
    z AS (SELECT doc_id, t AS rid, {NORM.format("t")} AS title FROM lt), {dice_sql("x", "z", "doc_id")},
    dr AS (SELECT m.doc_id, m.page, ord, zone IS NOT NULL AND (regexp_matches(text, '(?i)^(?:page\\s+)?[-–—\\s]*(?:\\d{{1,4}}|[ivxlcdm]{{1,7}})[-–—\\s]*$') OR EXISTS (SELECT 1 FROM rp WHERE rp.doc_id = m.doc_id AND rp.zone = m.zone AND rp.pattern = m.pattern)
      OR EXISTS (SELECT 1 FROM dc WHERE dc.doc_id = m.doc_id AND dc.lid = m.ord AND score >= 0.9)) AS gone FROM m)
    SELECT doc_id, page, count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS removed FROM dr GROUP BY 1, 2""",
)
def headers(spark, d):
    lines = headed(spark, d)
    kept = G.remove_headers_footers(lines, 600.0)[0].groupBy("doc_id", "page").agg(F.count("*").alias("kept"))
    every = lines.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return every.join(kept, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


@query(
    "agg20_stage_progress",
    """WITH g AS (SELECT event_type AS stage, count(*) FILTER (WHERE user_id % 7 <> 3 AND user_id % 2 = 0) AS done, count(*) AS total, count(*) FILTER (WHERE user_id % 7 = 3 AND event_type <> 'view') AS failed FROM events GROUP BY 1)
    SELECT stage, done, total, CASE WHEN done = total THEN 'done' WHEN failed > 0 THEN 'failed' WHEN done = 0 THEN 'waiting' ELSE 'running' END AS state FROM g""",
)
def stages(spark, d):
    from vellumspark.plans.reports import stage_progress

    status = F.when((F.col("user_id") % 7 == 3) & (F.col("event_type") != "view"), "failed").when((F.col("user_id") % 7 != 3) & (F.col("user_id") % 2 == 0), "succeeded").otherwise("queued")
    return stage_progress(A.table(spark, d, "events").select(F.col("event_type").alias("stage"), status.alias("status")))


@query(
    "agg20_overall_stage",
    """WITH i AS (SELECT o_custkey AS book, CASE WHEN o_orderkey % 3 = 0 THEN 'glossary' WHEN o_orderkey % 3 = 1 THEN 'translate' ELSE 'edit' END AS stage, o_orderstatus = 'F' OR o_custkey % 3 = 0 OR (o_custkey % 3 = 1 AND o_orderkey % 3 = 0) AS ok FROM orders),
    t AS (SELECT book, count(*) FILTER (WHERE stage = 'glossary' AND NOT ok) AS g, count(*) FILTER (WHERE stage = 'translate' AND NOT ok) AS t, count(*) FILTER (WHERE stage = 'edit' AND NOT ok) AS e FROM i GROUP BY 1),
    s AS (SELECT book, CASE WHEN book % 11 = 0 THEN 'done' WHEN book % 13 = 0 THEN 'brief' WHEN book % 17 = 0 OR g > 0 THEN 'glossary' WHEN book % 5 = 0 THEN 'glossary_review' WHEN t > 0 THEN 'translate' WHEN e > 0 THEN 'edit' ELSE 'qa' END AS stage FROM t)
    SELECT book, stage, CASE WHEN book % 19 = 0 THEN 'cancelled' WHEN book % 23 = 0 THEN 'paused' WHEN book % 11 = 0 THEN 'done' WHEN book % 29 = 0 THEN 'idle' WHEN stage = 'glossary_review' THEN 'waiting_glossary_review' ELSE 'running' END AS state FROM s""",
)
def overall(spark, d):
    """Customers as books, their orders as work of three stages; the flags come from the customer's key."""
    from vellumspark.plans.reports import overall_stage, stage_totals

    k, c = F.col("o_orderkey") % 3, F.col("o_custkey") % 3
    ok = (F.col("o_orderstatus") == "F") | (c == 0) | ((c == 1) & (k == 0))
    items = A.table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.when(k == 0, "glossary").when(k == 1, "translate").otherwise("edit").alias("stage"), F.when(ok, "succeeded").otherwise("queued").alias("status"))
    every = lambda n: F.col("book") % n == 0
    flags = {"briefed": ~every(13), "planned": ~every(17), "approved": ~every(5), "finished": every(11), "started": ~every(29), "paused": every(23), "cancelled": every(19)}
    return overall_stage(stage_totals(items).withColumns(flags))
