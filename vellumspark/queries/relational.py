"""Queries of sources, filters, joins, windows, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.functions import text as T
from vellumspark.operators import filters as P
from vellumspark.operators import joins as J
from vellumspark.operators import sets as SE
from vellumspark.operators import topk as K
from vellumspark.operators import windows as W
from vellumspark.registry import query
from vellumspark.sources import adapters as A
from vellumspark.sources import tables as S


def documents(spark, d):
    return A.table(spark, d, "documents")


# --- sources and sinks


@query(
    "src1_ingest_files",
    """WITH f AS (SELECT doc_id, source AS owner, sha256(text) AS sha, octet_length(encode(text)) AS size FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY owner, sha ORDER BY doc_id::VARCHAR) AS n FROM f)
    SELECT doc_id::VARCHAR AS path, owner, sha, size::INT AS size FROM k WHERE n = 1""",
)
def ingest(spark, d):
    files = documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("owner"), F.col("text").cast("binary").alias("content"))
    return S.ingest_files(files)[0]


@query("src2_load_bundle", "SELECT doc_id, source, lang, n_chars FROM documents WHERE source IN ('src0', 'src3') ORDER BY doc_id")
def load(spark, d):
    return S.load_bundle({"documents": documents(spark, d).select("doc_id", "source", "lang", "n_chars")}, ["src0", "src3"], "source")["documents"].orderBy("doc_id")


@query(
    "src3_save_ingestion",
    f"""WITH {A.SEGMENTS}, o AS (SELECT *, (row_number() OVER (PARTITION BY source, doc_id ORDER BY ord) - 1)::INT AS k FROM seg)
    SELECT sha256(source || '|' || doc_id || '|' || k)[1:16] AS segment_id, doc_id, k AS ord, sha256(text)[1:16] AS src_hash, len(regexp_extract_all(text, '\\S+'))::INT AS word_count FROM o""",
)
def save(spark, d):
    return S.save_ingestion(A.segments(spark, d), "source", "doc_id", "ord").select("segment_id", "doc_id", "ord", "src_hash", "word_count")


def _incoming(spark, d):
    """New whole texts of all documents; every third one has a changed end."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" (new)"))).otherwise(F.col("text"))
    return documents(spark, d).select(F.col("doc_id").alias("segment_id"), "lang", F.lit("drafted").alias("status"), text.alias("text"))


def _current(spark, d):
    return A.translations(spark, d).select("segment_id", "lang", "status", F.coalesce("final", "draft").alias("text"), "version")


UPSERT = f"""WITH {A.TRANSLATIONS}, c AS (SELECT segment_id, lang, status AS s0, coalesce(final, draft) AS t0, version AS v0 FROM tr),
  i AS (SELECT doc_id AS segment_id, lang, 'drafted' AS s1, CASE WHEN doc_id % 3 = 0 THEN text || ' (new)' ELSE text END AS t1 FROM documents),
  j AS (SELECT *, coalesce(s0 = 'user_edited', FALSE) AS held FROM c FULL JOIN i USING (segment_id, lang)),
  m AS (SELECT segment_id, lang, CASE WHEN held OR t1 IS NULL THEN s0 ELSE s1 END AS status, CASE WHEN held OR t1 IS NULL THEN t0 ELSE t1 END AS text,
    CASE WHEN held AND t1 <> t0 THEN t1 END AS suggestion, coalesce(v0, 0) + (t1 IS NOT NULL)::INT AS version, t0 FROM j)"""


@query("src4_upsert_translations", UPSERT + " SELECT segment_id, lang, status, text, suggestion, version FROM m")
def upsert(spark, d):
    return S.upsert_translations(_current(spark, d), _incoming(spark, d))[0]


@query("src4_upsert_revisions", UPSERT + " SELECT segment_id, lang, t0 AS before, text AS after FROM m WHERE t0 IS NOT NULL AND text <> t0")
def revisions(spark, d):
    return S.upsert_translations(_current(spark, d), _incoming(spark, d))[1]


@query(
    "src5_mark_queued",
    f"WITH {A.TRANSLATIONS}, k AS (SELECT doc_id AS segment_id FROM documents WHERE doc_id % 3 = 0) SELECT segment_id, CASE WHEN k.segment_id IS NOT NULL AND (status IS NULL OR status IN ('pending', 'queued')) THEN 'queued' ELSE status END AS status FROM tr FULL JOIN k USING (segment_id)",
)
def queued(spark, d):
    keys = documents(spark, d).where("doc_id % 3 = 0").select(F.col("doc_id").alias("segment_id"))
    return S.mark_queued(A.translations(spark, d).select("segment_id", "status"), keys)


@query(
    "src6_write_batches",
    f"""WITH {A.SEGMENTS}, k AS (SELECT doc_id, lpad(row_number() OVER (PARTITION BY doc_id ORDER BY ord)::VARCHAR, greatest(2, length((count(*) OVER (PARTITION BY doc_id))::VARCHAR))::INT, '0') AS key, ord, text FROM seg)
    SELECT doc_id, key, text AS src, doc_id || ':' || ord AS segment_id FROM k""",
)
def batches(spark, d):
    s = A.segments(spark, d).withColumn("segment_id", F.concat_ws(":", "doc_id", "ord"))
    b = S.assemble_batches(s, ["doc_id"], "ord")
    return b.select("doc_id", "key_map", F.explode("items").alias("i")).select("doc_id", "i.key", "i.src", F.col("key_map")[F.col("i.key")].alias("segment_id"))


RESULTS = """r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'corrupt' WHEN event_id % 13 = 0 THEN 'missing_batch' WHEN event_type = 'signup' THEN 'unknown_batch' WHEN event_id % 17 = 0 THEN 'missing_items' END AS rule, user_id, event_type FROM events)"""


def _results(spark, d):
    e = A.table(spark, d, "events")
    head = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit('"batch_id":"'), "event_type", F.lit('",')))
    items = F.when(F.col("event_id") % 17 == 0, '"x":1').otherwise(F.concat(F.lit('"items":[{"key":"'), F.col("event_id"), F.lit('","tgt":"t"},{"key":"b'), F.col("event_id"), F.lit('"}]')))
    value = F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.concat(F.lit("﻿{"), head, items, F.lit("}")))
    return e.select(F.col("event_id").cast("string").alias("path"), value.alias("value"))


def _known_batches(spark):
    return spark.createDataFrame([("view",), ("click",), ("error",), ("purchase",)], "batch_id string")


@query("src7_read_results", f"WITH {RESULTS} SELECT event_type AS batch_id, event_id::VARCHAR AS key, 't' AS tgt FROM r WHERE rule IS NULL")
def results(spark, d):
    return S.read_results(_results(spark, d), _known_batches(spark))[0].select("batch_id", "key", "tgt")


@query(
    "src7_result_errors",
    f"""WITH {RESULTS} SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'missing_text', sum(least(n, 50))::BIGINT FROM (SELECT event_type, count(*) AS n FROM r WHERE rule IS NULL GROUP BY 1)""",
)
def errors(spark, d):
    return S.read_results(_results(spark, d), _known_batches(spark), cap=50)[1].groupBy("rule").agg(F.count("*").alias("n"))


@query("src8_export_bundle", f"WITH {A.BLOCKS} SELECT page_id % 50 AS book, page_id, ord, type, text AS src FROM blk")
def export(spark, d):
    b = A.blocks(spark, d).select((F.col("page_id") % 50).alias("book"), "page_id", "ord", "type", F.col("text").alias("src"), F.lit(None).cast("string").alias("tgt"))
    e = S.export_bundle(b, "book", "page_id", "ord").select("book", F.explode("sections").alias("s"))
    return e.select("book", F.col("s.section").alias("page_id"), F.explode("s.rows").alias("r")).select("book", "page_id", "r.ord", "r.type", "r.src")


@query(
    "src9_save_structure",
    f"""WITH {A.BLOCKS} SELECT page_id || ':' || ord AS segment_id, (page_id + (ord % 2 = 0)::INT)::BIGINT AS node, ord, type, CASE WHEN ord % 2 = 0 THEN upper(replace(text, 'ß', 'SS')) ELSE text END AS text,
    sha256(CASE WHEN ord % 2 = 0 THEN upper(replace(text, 'ß', 'SS')) ELSE text END)[1:16] AS src_hash FROM blk""",
)
def structure(spark, d):
    b = A.blocks(spark, d).select(F.concat_ws(":", "page_id", "ord").alias("segment_id"), F.col("page_id").alias("node"), "ord", "type", "text")
    e = b.where("ord % 2 = 0").select("segment_id", (F.col("node") + 1).alias("node"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("type"), F.upper("text").alias("text"))
    return S.save_structure(b, e).drop("word_count")


@query(
    "src11_structure_summary",
    f"""WITH {A.BLOCKS}, k AS (SELECT page_id, ord // 5 AS node, 'Part ' || (ord // 5) AS title, list({{'type': type, 'text': text}} ORDER BY ord) AS segments FROM blk GROUP BY 1, 2, 3)
    SELECT page_id AS doc_id, to_json(list({{'node': node, 'title': title, 'segments': segments}} ORDER BY node))::VARCHAR AS summary FROM k GROUP BY 1""",
)
def summary(spark, d):
    """Every page as a document of parts of five blocks: the whole summary."""
    b = A.blocks(spark, d).select(F.col("page_id").alias("doc_id"), F.floor(F.col("ord") / 5).cast("int").alias("node"), "ord", "type", "text")
    n = b.select("doc_id", "node", F.concat(F.lit("Part "), "node").alias("title")).distinct()
    return S.structure_summary(n, b)


@query("src12_delete_book", "SELECT doc_id, lang FROM documents WHERE source <> 'src0'")
def delete(spark, d):
    ids = spark.createDataFrame([("src0",)], "source string")
    return S.delete_books({"documents": documents(spark, d)}, ids, "source")["documents"].select("doc_id", "lang")


def _reviewed(spark, d):
    t = A.translations(spark, d).withColumn("suggestion", F.when(F.col("segment_id") % 7 == 0, F.lit("better")))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("edit", "approve", "reject", "accept", "dismiss"))), (F.col("doc_id") % 5 + 1).cast("int"))
    a = documents(spark, d).select(F.col("doc_id").alias("segment_id"), "lang", kind.alias("action"), F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.lit(" mine ")).alias("value"))
    return S.apply_review_actions(t, a)


REVIEW = f"""WITH {A.TRANSLATIONS}, t AS (SELECT *, CASE WHEN segment_id % 7 = 0 THEN 'better' END AS suggestion, coalesce(final, draft) AS old FROM tr),
  a AS (SELECT doc_id AS segment_id, ['edit', 'approve', 'reject', 'accept', 'dismiss'][doc_id % 5 + 1] AS action, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'mine' END AS value FROM documents),
  j AS (SELECT *, coalesce(CASE action WHEN 'edit' THEN value <> '' AND NOT (status = 'user_edited' AND old = value) WHEN 'approve' THEN status IN ('flagged', 'drafted')
    WHEN 'reject' THEN coalesce(final <> draft, FALSE) ELSE suggestion IS NOT NULL END, FALSE) AS ok FROM t JOIN a USING (segment_id)),
  m AS (SELECT segment_id, lang, CASE WHEN NOT ok THEN status WHEN action IN ('edit', 'accept') THEN 'user_edited' WHEN action = 'approve' THEN 'final' ELSE status END AS status, draft,
    CASE WHEN NOT ok THEN final WHEN action = 'edit' THEN value WHEN action = 'reject' THEN draft WHEN action = 'accept' THEN suggestion WHEN action = 'approve' THEN old ELSE final END AS final, version + ok::INT AS version, old, ok, action FROM j)"""


@query("src13_apply_review_actions", REVIEW + " SELECT segment_id, lang, status, final, version FROM m")
def review(spark, d):
    return _reviewed(spark, d)[0].select("segment_id", "lang", "status", "final", "version")


@query("src13_review_revisions", REVIEW + " SELECT segment_id, old AS before, coalesce(final, draft) AS after FROM m WHERE ok AND coalesce(final, draft) <> old")
def review_revisions(spark, d):
    return _reviewed(spark, d)[1].select("segment_id", "before", "after")


@query(
    "src14_patch_terms",
    """WITH t AS (SELECT p_partkey AS term_id, p_name || p_partkey AS src, p_brand AS tgt FROM part),
    p AS (SELECT p_partkey AS term_id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) || '0' ELSE 'new' || p_partkey END AS src, NULL AS tgt, p_partkey % 2 = 0 AS has_src, p_partkey % 3 = 0 AS has_tgt FROM part),
    c AS (SELECT DISTINCT p.term_id FROM p JOIN t ON lower(p.src) = lower(t.src) AND t.term_id <> p.term_id WHERE has_src)
    SELECT t.term_id, CASE WHEN g.has_src THEN g.src ELSE t.src END AS src, CASE WHEN g.has_tgt THEN g.tgt ELSE t.tgt END AS tgt FROM t LEFT JOIN (SELECT * FROM p WHERE term_id NOT IN (SELECT term_id FROM c)) g ON g.term_id = t.term_id""",
)
def patch(spark, d):
    part = A.table(spark, d, "part")
    t = part.select(F.col("p_partkey").alias("term_id"), F.concat("p_name", "p_partkey").alias("src"), F.col("p_brand").alias("tgt"))
    src = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.upper("p_name"), F.lit("0"))).otherwise(F.concat(F.lit("new"), "p_partkey"))
    p = part.select(F.col("p_partkey").alias("term_id"), src.alias("src"), F.lit(None).cast("string").alias("tgt"), (F.col("p_partkey") % 2 == 0).alias("has_src"), (F.col("p_partkey") % 3 == 0).alias("has_tgt"))
    return S.patch_terms(t, p, ["src", "tgt"])[0]


# --- filters


READ = f"WITH {A.NODES}, par AS (SELECT DISTINCT parent_id FROM nd) SELECT node_id FROM nd LEFT JOIN par ON par.parent_id = nd.node_id WHERE NOT skip AND (kind IN ('front', 'chapter_intro', 'section', 'subsection', 'back') OR par.parent_id IS NULL)"


@query("fil1_readable_nodes", READ)
def readable(spark, d):
    return P.readable_nodes(A.nodes(spark, d)).select("node_id")


@query("fil2_translatable_segments", f"WITH {A.BLOCKS} SELECT page_id, ord, CASE type WHEN 'heading' THEN 'h' WHEN 'paragraph' THEN 'p' ELSE 'li' END AS code FROM blk WHERE ord % 5 <> 0")
def translatable(spark, d):
    return P.translatable_segments(A.blocks(spark, d).withColumn("translatable", F.col("ord") % 5 != 0)).select("page_id", "ord", "code")


@query("fil3_visible_text", f"WITH {A.TRANSLATIONS} SELECT segment_id, coalesce(final, draft) AS text FROM tr WHERE status IN ('drafted', 'edited', 'final', 'flagged', 'user_edited')")
def visible(spark, d):
    return P.visible_text(A.translations(spark, d)).select("segment_id", "text")


@query("fil4_approved_terms", "SELECT p_partkey AS term_id FROM part WHERE p_size % 3 = 1 AND p_brand <> 'Brand#2'")
def approved(spark, d):
    t = A.table(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.when(F.col("p_size") % 3 == 1, "fa").otherwise(F.lit("de")).alias("lang"), F.when(F.col("p_brand") == "Brand#2", "proposed").otherwise(F.lit("approved")).alias("status"))
    return P.approved_terms(t, "fa").select("term_id")


FLAGGED = f"""{A.TRANSLATIONS}, {A.NODES.replace("nd AS (", "nt AS (")}, r AS (SELECT user_id AS segment_id, max_by(event_type, (ts, event_id)) AS last_change FROM events WHERE event_type <> 'view' GROUP BY 1),
    pl AS (SELECT tr.*, doc_id % 7 = 0 AND segment_id % 2 = 0 AS suggested, lpad(p.ord::VARCHAR, 10, '0') || '/' || lpad(n.ord::VARCHAR, 10, '0') AS path FROM tr JOIN documents ON doc_id = segment_id JOIN nt n ON n.node_id = 'n' || segment_id % 25 JOIN nt p ON p.node_id = n.parent_id)"""


def _queue(spark, d, mode):
    t = A.translations(spark, d).withColumn("suggestion", F.when((F.col("segment_id") % 7 == 0) & (F.col("segment_id") % 2 == 0), F.lit("better")))
    s = t.select("segment_id", F.concat(F.lit("n"), F.col("segment_id") % 25).alias("node_id"), F.col("segment_id").alias("ord"))
    changes = A.table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("segment_id"), F.col("event_type").alias("change"), F.struct("ts", "event_id").alias("at"))
    q = P.review_queue(t, s, A.nodes(spark, d), changes, mode)
    return W.numbered(q, ["path", "ord"]).select("segment_id", "status", "last_change", "place")


@query("fil5_review_queue", f"WITH {FLAGGED} SELECT segment_id, status, last_change, row_number() OVER (ORDER BY path, segment_id) AS place FROM pl LEFT JOIN r USING (segment_id) WHERE status = 'flagged'")
def review_queue(spark, d):
    return _queue(spark, d, "flagged")


@query("fil5_review_queue_all", f"WITH {FLAGGED} SELECT segment_id, status, last_change, row_number() OVER (ORDER BY path, segment_id) AS place FROM pl LEFT JOIN r USING (segment_id) WHERE status = 'flagged' OR n_flags > 0 OR suggested")
def review_queue_all(spark, d):
    return _queue(spark, d, "all")


@query("fil7_empty_pages", f"WITH {A.LINES} SELECT doc_id, page FROM (SELECT doc_id, page, sum(length(text)) AS n FROM ln GROUP BY 1, 2) WHERE n < 20")
def empty_pages(spark, d):
    lines = A.lines(spark, d)
    return P.empty_pages(lines.select("doc_id", "page").distinct(), lines)


@query("fil11_suspected_breaks", f"WITH {A.SEGMENTS} SELECT doc_id, ord FROM seg WHERE NOT regexp_matches(regexp_replace(text, '(\\s*\\[\\^[^\\]]+\\])+\\s*$', ''), '[.!?…:;؟۔»\"”'')\\]]\\s*$')")
def breaks(spark, d):
    s = A.segments(spark, d).withColumn("type", F.lit("paragraph")).withColumn("skip", F.lit(False))
    return P.suspected_breaks(s).select("doc_id", "ord")


@query("fil12_runnable_order_filter", f"WITH {A.WORK} SELECT id FROM wk WHERE status = 'queued' AND priority = 1")
def runnable(spark, d):
    return P.runnable(A.work_items(spark, d), priority=1, book=None).select("id")


@query(
    "fil13_extraction_warnings",
    f"""WITH {A.LINES}, e AS (SELECT doc_id, list(DISTINCT page) AS p FROM ln WHERE text = '' GROUP BY 1), n AS (SELECT doc_id, count(*) AS n, sum((NOT regexp_matches(text, '[.!?…:;؟۔»\"”'')\\]]\\s*$'))::INT) AS b FROM ln GROUP BY 1)
    SELECT doc_id, 'no_text' AS rule FROM e UNION ALL SELECT doc_id, 'breaks' FROM n WHERE b / n > 0.01 UNION ALL SELECT DISTINCT doc_id, 'not_from_outline' FROM ln WHERE doc_id % 9 = 0""",
)
def warnings(spark, d):
    lines = A.lines(spark, d)
    broken = P.lacks_ending(F.col("text"))
    r = lines.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("text") == "", F.col("page")))).alias("empty_pages"), F.sort_array(F.collect_set(F.when(broken, F.col("page")))).alias("break_pages"), (F.count_if(broken) / F.count("*")).alias("break_ratio")
    )
    return P.extraction_warnings(r.withColumn("ocr_pages", F.array().cast("array<int>")).withColumn("from_outline", F.col("doc_id") % 9 != 0)).select("doc_id", "rule")


# --- joins


@query("join1_segment_text", f"WITH {A.TRANSLATIONS} SELECT segment_id, coalesce(final, draft) AS tgt, n_chars FROM tr JOIN documents ON doc_id = segment_id WHERE status IN ('drafted', 'edited', 'final', 'flagged', 'user_edited')")
def segment_text(spark, d):
    s = documents(spark, d).select(F.col("doc_id").alias("segment_id"), "n_chars")
    return J.segment_text(A.translations(spark, d), s)


def _counted(spark, d):
    s = documents(spark, d).select(F.col("doc_id").alias("segment_id"), "source", F.concat(F.lit("n"), F.col("doc_id") % 25).alias("node_id"))
    return J.counter_join(s, A.nodes(spark, d).select("node_id", "skip"), A.translations(spark, d), "en")


COUNTED = f"WITH {A.TRANSLATIONS}, {A.NODES}, cj AS (SELECT doc_id AS segment_id, source, 'n' || (doc_id % 25) AS node_id, skip, status FROM documents JOIN nd ON node_id = 'n' || (doc_id % 25) LEFT JOIN (SELECT segment_id, status FROM tr WHERE lang = 'en') ON segment_id = doc_id)"


@query("join2_counter_join", COUNTED + " SELECT segment_id, node_id, skip, status FROM cj")
def counter_join(spark, d):
    return _counted(spark, d).select("segment_id", "node_id", "skip", "status")


@query("agg1_progress_counters", COUNTED + " SELECT source, count(*) AS total, count(*) FILTER (WHERE status IN ('final', 'user_edited')) AS done FROM cj WHERE NOT skip GROUP BY 1")
def progress(spark, d):
    from vellumspark.operators.aggregates import progress_counters

    return progress_counters(_counted(spark, d), ["source"])


@query("join3_ready_items", f"WITH {A.WORK} SELECT id FROM wk WHERE status = 'queued' AND id NOT IN (SELECT dep.id FROM dep JOIN wk u ON u.id = dep.needs WHERE u.status <> 'succeeded')")
def ready(spark, d):
    return J.ready_items(A.work_items(spark, d)).select("id")


@query("join4_restrict_to", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def restrict(spark, d):
    return J.restrict_to(documents(spark, d).select("doc_id", "lang"), A.table(spark, d, "labels").where("quality = 1"), "doc_id")


MEMORY = "d AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS k FROM documents), l AS (SELECT k, max(doc_id) AS m FROM d WHERE doc_id % 2 = 0 GROUP BY 1)"


def _memory(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("segment_id"), F.col("text").alias("src"))
    return J.translation_memory(docs, docs.where("segment_id % 2 = 0").withColumn("status", F.lit("final")).withColumn("tgt", F.concat(F.lit("t"), "segment_id")))


@query("join7_translation_memory", f"WITH {MEMORY} SELECT doc_id AS segment_id, m AS from_id, 't' || m AS tgt FROM d JOIN l USING (k) WHERE m <> doc_id")
def memory(spark, d):
    return _memory(spark, d)[0]


@query("join7_memory_remaining", f"WITH {MEMORY} SELECT doc_id AS segment_id FROM d LEFT JOIN l USING (k) WHERE m IS NULL OR m = doc_id")
def memory_rest(spark, d):
    return _memory(spark, d)[1]


def dice_sql(left: str, right: str, on: str) -> str:
    """Bigram Dice in SQL: tables of (on, lid, title) and (on, rid, title), a score for every pair with a common bigram."""
    grams = lambda t, i: f"SELECT {on}, {i}, g, count(*) AS n FROM (SELECT {on}, {i}, unnest(list_transform(range(1, length(z)), lambda k: z[k : k + 1])) AS g FROM (SELECT *, replace(title, ' ', '') AS z FROM {t})) GROUP BY ALL"
    return f"""ga AS ({grams(left, 'lid')}), gb AS ({grams(right, 'rid')}), sa AS (SELECT {on}, lid, sum(n) AS n FROM ga GROUP BY ALL), sb AS (SELECT {on}, rid, sum(n) AS n FROM gb GROUP BY ALL),
    dc AS (SELECT {on}, lid, rid, 2 * sum(least(ga.n, gb.n)) / (any_value(sa.n) + any_value(sb.n)) AS score FROM ga JOIN gb USING ({on}, g) JOIN sa USING ({on}, lid) JOIN sb USING ({on}, rid) GROUP BY {on}, lid, rid)"""


NORM = "trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    "join8_similar_titles",
    f"""WITH {A.BLOCKS}, n AS (SELECT page_id, ord, type, {NORM.format("text")} AS title, len(regexp_extract_all(text, '\\S+')) AS words FROM blk), nr AS (SELECT * FROM n WHERE type = 'heading' OR words <= 20),
    pr AS (SELECT page_id, ord, type, title || ' ' || lead(title) OVER (PARTITION BY page_id ORDER BY ord) AS title FROM nr), sp AS (SELECT page_id, ord * 2 AS rid, type, title FROM nr UNION ALL SELECT page_id, ord * 2 + 1, type, title FROM pr WHERE title IS NOT NULL),
    en AS (SELECT page_id, 0 AS lid, 'chapter 7 ' || {NORM.format("regexp_extract(html, '<title>([^<]*)', 1)")} AS t FROM pages), e2 AS (SELECT page_id, lid, t AS title FROM en UNION ALL SELECT page_id, 1, substring(t, 11) FROM en),
    x AS (SELECT page_id, lid, title FROM e2 UNION ALL SELECT page_id, lid + 10, regexp_replace(title, '^chapter 7 ', '') FROM e2), y AS (SELECT page_id, rid, title FROM sp UNION ALL SELECT page_id, rid + 1000000, {{bare}} FROM sp),
    {dice_sql("x", "y", "page_id")},
    m AS (SELECT page_id, lid % 10 AS lid, rid % 1000000 AS rid, max(score) AS score FROM dc WHERE (lid >= 10) = (rid >= 1000000) GROUP BY ALL),
    f AS (SELECT page_id, lid, m.rid // 2 AS rid, m.rid % 2 + 1 AS span, round(score - CASE WHEN type = 'heading' THEN 0 ELSE 0.1 END, 9) AS score FROM m JOIN sp USING (page_id, rid)),
    g AS (SELECT * FROM f WHERE score >= 0.85), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, rid, span) AS k FROM g WHERE lid = 0) WHERE k = 1),
    b AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY g.page_id ORDER BY g.score DESC, g.rid, g.span) AS k FROM g LEFT JOIN a USING (page_id) WHERE g.lid = 1 AND g.rid > coalesce(a.rid + a.span - 1, -1)) WHERE k = 1)
    SELECT page_id AS doc_id, lid::BIGINT AS lid, rid::BIGINT AS rid, round(score, 6) AS score FROM (SELECT page_id, lid, rid, score FROM a UNION ALL SELECT page_id, lid, rid, score FROM b)""".replace("{bare}", "trim(regexp_replace(title, '^(?:(?:chapter|part|section|appendix)\\s+)?(?:[0-9]+(?:\\s[0-9]+)*|[ivxlc]+)\\s+', ''))"),
)
def similar(spark, d):
    """Two entries a page: its title with a chapter number, and without."""
    title = T.normalize_title(F.regexp_extract("html", "<title>([^<]*)", 1))
    t = A.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("chapter 7 "), title), title)).alias("lid", "title"), F.lit(0).alias("page"))
    b = A.blocks(spark, d).select(F.col("page_id").alias("doc_id"), F.col("ord").cast("long").alias("rid"), T.normalize_title(F.col("text")).alias("title"), F.lit(0).alias("page"), "type", F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    return J.similar_titles(t, b).withColumn("score", F.round("score", 6))


@query(
    "join11_drop_subsumed",
    "WITH t AS (SELECT w AS key, 1 AS words, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 UNION ALL SELECT p_name, 2, count(*) FROM part GROUP BY 1) SELECT key, words, n FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.words > t.words AND contains(' ' || o.key || ' ', ' ' || t.key || ' ') AND o.n >= 0.8 * t.n)",
)
def subsumed(spark, d):
    from vellumspark.operators.terms import drop_subsumed

    p = A.table(spark, d, "part")
    one = p.select(F.explode(F.split("p_name", " ")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).withColumn("words", F.lit(1))
    two = p.groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n")).withColumn("words", F.lit(2))
    return drop_subsumed(one.unionByName(two)).select("key", "words", "n")


TOKENS = "SELECT conv_id, turn, unnest(regexp_extract_all({c}, 'https?://[^\\s<>\"''\\]\\)]*[^\\s<>\"''\\]\\).,;:!?]')) AS token FROM prs"


@query(
    "join12_markup_diff",
    f"""WITH {A.PAIRS}, a AS (SELECT conv_id, turn, 'url:' || token AS token, count(*) AS l FROM ({TOKENS.format(c="src")}) GROUP BY ALL), b AS (SELECT conv_id, turn, 'url:' || token AS token, count(*) AS r FROM ({TOKENS.format(c="tgt")}) GROUP BY ALL)
    SELECT conv_id, turn, token, greatest(coalesce(l, 0) - coalesce(r, 0), 0) AS missing, greatest(coalesce(r, 0) - coalesce(l, 0), 0) AS extra FROM a FULL JOIN b USING (conv_id, turn, token) WHERE coalesce(l, 0) <> coalesce(r, 0)""",
)
def markup(spark, d):
    return J.markup_diff(A.pairs(spark, d), ["conv_id", "turn"])


@query(
    "join13_missing_numbers",
    f"""WITH {A.PAIRS}, a AS (SELECT conv_id, turn, n AS number, count(*) AS l FROM (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(src, '(?i)\\b\\d+(?:st|nd|rd|th)\\b', ' ', 'g'), '[0-9]+')) AS n FROM prs) GROUP BY ALL),
    b AS (SELECT conv_id, turn, n AS number, count(*) AS r FROM (SELECT conv_id, turn, unnest(regexp_extract_all(tgt, '[0-9]+')) AS n FROM prs) GROUP BY ALL)
    SELECT conv_id, turn, number, l - coalesce(r, 0) AS missing FROM a LEFT JOIN b USING (conv_id, turn, number) WHERE l > coalesce(r, 0)""",
)
def numbers(spark, d):
    return J.missing_numbers(A.pairs(spark, d), ["conv_id", "turn"])


@query(
    "join14_key_integrity",
    """WITH r AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0 UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id % 50 = 0),
    g AS (SELECT doc_id, count(*) AS got FROM r GROUP BY 1)
    SELECT doc_id, CASE WHEN got IS NULL THEN 'missing' WHEN n_chars IS NULL THEN 'unknown' ELSE 'duplicate' END AS rule FROM documents FULL JOIN g USING (doc_id) WHERE got IS NULL OR n_chars IS NULL OR got > 1""",
)
def integrity(spark, d):
    lab = A.table(spark, d, "labels").select("doc_id")
    returned = lab.union(lab.where("doc_id % 10 = 0")).union(lab.where("doc_id % 50 = 0").select(-F.col("doc_id") - 1))
    return J.key_integrity(documents(spark, d), returned, ["doc_id"])


@query("join17_apply_overrides", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE quality END AS quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def overrides(spark, d):
    o = documents(spark, d).where("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality"))
    return J.apply_overrides(A.table(spark, d, "labels").select("doc_id", "quality"), o, ["doc_id"])


@query(
    "join19_resolve_citations",
    """WITH a AS (SELECT conv_id, turn, unnest([(conv_id + turn) % 5, conv_id % 5, 9, turn % 5]) AS p, unnest([0, 1, 2, 3]) AS place FROM conversations WHERE role = 'assistant'),
    f AS (SELECT conv_id, turn, 'P' || p AS label, min(place) AS place FROM a WHERE p < 5 GROUP BY ALL)
    SELECT conv_id, turn, label, 's' || label AS segment_id, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY place))::INT AS position FROM f""",
)
def citations(spark, d):
    c = A.table(spark, d, "conversations").where("role = 'assistant'")
    p = lambda x: F.concat(F.lit(" so [P"), x.cast("string"), F.lit("] "))
    a = c.select("conv_id", "turn", F.concat(p((F.col("conv_id") + F.col("turn")) % 5), p(F.col("conv_id") % 5), p(F.lit(9)), p(F.col("turn") % 5)).alias("answer"))
    labels = c.select("conv_id", "turn", F.explode(F.expr("transform(sequence(0, 4), i -> 'P' || i)")).alias("label")).withColumn("segment_id", F.concat(F.lit("s"), "label"))
    return J.resolve_citations(a, labels, ["conv_id", "turn"])


@query("join20_batch_status_join", "SELECT l_orderkey AS item_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY 1")
def batch_status(spark, d):
    return J.batch_status_join(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id")), A.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("state")), "P")


@query(
    "join21_dehyphenate",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents), v AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1),
    x AS (SELECT w, n FROM v UNION ALL SELECT w[1:3] || '-' || w[4:], n + 1 - n % 3 FROM v WHERE length(w) = 7),
    p AS (SELECT w, w[1:3] AS l, CASE WHEN length(w) = 8 AND regexp_matches(w[4:4], '[a-z]') THEN upper(w[4:4]) || w[5:] ELSE w[4:] END AS r FROM v WHERE length(w) BETWEEN 6 AND 9)
    SELECT l AS "left", r AS "right", CASE WHEN j.n > coalesce(h.n, 0) THEN l || r ELSE l || '-' || r END AS text FROM p JOIN x j ON j.w = lower(l || r) LEFT JOIN x h ON h.w = lower(l || '-' || r) WHERE j.n <> coalesce(h.n, 0)
    UNION ALL SELECT l, r, CASE WHEN regexp_matches(r, '^\\p{Ll}') THEN l || r ELSE l || '-' || r END FROM p JOIN x j ON j.w = lower(l || r) JOIN x h ON h.w = lower(l || '-' || r) WHERE j.n = h.n""",
)
def dehyphenate(spark, d):
    w = documents(spark, d).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    v = w.groupBy("word").agg(F.count("*").alias("n"))
    start, end = F.substring("word", 1, 3), F.expr("substring(word, 4)")
    # Some words also occur with the hyphen, in fewer, as many or more documents.
    both = v.union(v.where("char_length(word) = 7").select(F.concat(start, F.lit("-"), end), F.col("n") + 1 - F.col("n") % 3))
    right = F.when((F.char_length("word") == 8) & F.substring("word", 4, 1).rlike("[a-z]"), F.concat(F.upper(F.substring("word", 4, 1)), F.expr("substring(word, 5)"))).otherwise(end)
    p = v.where("char_length(word) between 6 and 9").select(start.alias("left"), right.alias("right"))
    return J.dehyphenate(p, both)


@query("join22_locate_cuts_fallback", f"WITH {A.BLOCKS}, e AS (SELECT page_id AS doc_id, ord + 0.5 AS pos, 'e' || ord AS entry FROM blk WHERE ord % 4 = 1) SELECT e.doc_id, entry, min(blk.ord)::BIGINT AS block FROM e LEFT JOIN blk ON page_id = e.doc_id AND blk.ord >= e.pos GROUP BY 1, 2")
def locate(spark, d):
    b = A.blocks(spark, d).select(F.col("page_id").alias("doc_id"), F.col("ord").cast("double").alias("pos"), F.col("ord").alias("block"))
    e = b.where("block % 4 = 1").select("doc_id", (F.col("pos") + 0.5).alias("pos"), F.concat(F.lit("e"), "block").alias("entry"))
    return J.first_block_after(e, b)


# --- windows


@query("win1_assign_ord", "SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS ord FROM customer")
def assign_ord(spark, d):
    return W.assign_ord(A.table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "c_nationkey", "ord")


@query("win2_paragraph_numbers", f"WITH {A.BLOCKS} SELECT page_id, ord, CASE WHEN type = 'heading' THEN 0 ELSE (sum((type <> 'heading')::INT) OVER (PARTITION BY page_id ORDER BY ord))::BIGINT END AS number FROM blk")
def paragraphs(spark, d):
    return W.paragraph_numbers(A.blocks(spark, d), "page_id", "ord").select("page_id", "ord", "number")


@query("win6_line_gaps", f"WITH {A.LINES}, g AS (SELECT doc_id, ord, (y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y))::DOUBLE AS gap FROM ln WHERE abs(size - 10) < 0.5) SELECT * FROM g WHERE gap IS NOT NULL")
def gaps(spark, d):
    return W.line_gaps(A.lines(spark, d), 10.0).select("doc_id", "ord", "gap")


@query("win9_assign_to_cut", f"WITH {A.BLOCKS} SELECT page_id, ord, last_value(CASE WHEN type = 'heading' THEN 'k' || ord END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS node_key FROM blk")
def cuts(spark, d):
    b = A.blocks(spark, d)
    return W.assign_to_cut(b, b.where("type = 'heading'").select("page_id", "ord", F.concat(F.lit("k"), "ord").alias("cut")), "page_id", "ord").select("page_id", "ord", "node_key")


@query("win12_latest_per_key", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest(spark, d):
    return W.latest_per_key(A.table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("win13_item_keys", "SELECT doc_id, lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id))::VARCHAR, greatest(2, length((count(*) OVER (PARTITION BY source))::VARCHAR))::INT, '0') AS key FROM documents")
def keys(spark, d):
    return W.item_keys(documents(spark, d), ["source"], ["doc_id"]).select("doc_id", "key")


@query("win14_context_rows", "SELECT conv_id, turn, lag(text, 2) OVER w AS before2, lag(text) OVER w AS before1, lead(text) OVER w AS after1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context(spark, d):
    return W.context_rows(A.table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "before2", "before1", "after1")


@query(
    "win15_chapter_ranges",
    f"""WITH {A.LINES}, s AS (SELECT DISTINCT doc_id, page AS start FROM ln WHERE ord % 60 = 50), a AS (SELECT * FROM s UNION SELECT doc_id, 0 FROM s GROUP BY doc_id HAVING min(start) > 0), n AS (SELECT doc_id, max(page) + 1 AS n FROM ln GROUP BY 1)
    SELECT doc_id, start, (coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) - 1)::INT AS "end" FROM a JOIN n USING (doc_id)""",
)
def ranges(spark, d):
    lines = A.lines(spark, d)
    return W.chapter_ranges(lines.where("ord % 60 = 50").select("doc_id", "page"), lines.groupBy("doc_id").agg((F.max("page") + 1).alias("page_count")))


@query(
    "win16_chapter_numbers",
    "WITH i AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 7 END AS label, count(CASE WHEN c_custkey % 10 = 0 THEN 1 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) SELECT c_custkey, (coalesce(first_value(label) OVER w, 1) + row_number() OVER w - 1)::BIGINT AS number FROM i WINDOW w AS (PARTITION BY c_nationkey, i ORDER BY c_custkey)",
)
def numbers_of_chapters(spark, d):
    c = A.table(spark, d, "customer").withColumn("label", F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") % 7))
    return W.chapter_numbers(c, "c_nationkey", ["c_custkey"], "label").select("c_custkey", F.col("number").cast("long").alias("number"))


@query("win17_parent_from_depth", "WITH e AS (SELECT conv_id, turn, (turn * 7 + conv_id) % 4 AS depth FROM conversations) SELECT conv_id, turn, (SELECT max(p.turn) FROM e p WHERE p.conv_id = e.conv_id AND p.turn < e.turn AND p.depth < e.depth) AS parent_pos FROM e")
def parents(spark, d):
    c = A.table(spark, d, "conversations").withColumn("depth", (F.col("turn") * 7 + F.col("conv_id")) % 4)
    return W.parent_from_depth(c, "conv_id", "turn", "depth").select("conv_id", "turn", "parent_pos")


@query("win18_heading_depth", f"WITH {A.BLOCKS} SELECT page_id, ord, least(dense_rank() OVER (PARTITION BY page_id ORDER BY 20 - level DESC) - 1, 2)::INT AS depth FROM blk WHERE type = 'heading'")
def depths(spark, d):
    h = A.blocks(spark, d).where("type = 'heading'").withColumn("size", F.lit(20.0) - F.col("level"))
    return W.heading_depth(h, "page_id", "size", "text").select("page_id", "ord", "depth")


@query("win19_budgeted_passages", f"WITH {A.SEGMENTS}, s AS (SELECT doc_id, ord, sum(length(text)) OVER w AS s, count(*) OVER w AS n FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY abs(ord - 3), ord ROWS UNBOUNDED PRECEDING)) SELECT doc_id, ord FROM s WHERE s <= 1000 OR n = 1")
def budgeted(spark, d):
    return W.budgeted_passages(A.segments(spark, d).withColumn("anchor", F.lit(3)), "anchor", max_chars=1000).select("doc_id", "ord")


@query("win20_dependency_chain", f"WITH {A.SEGMENTS} SELECT doc_id || ':' || ord AS id, lag(doc_id || ':' || ord) OVER (PARTITION BY doc_id ORDER BY ord) AS needs FROM seg")
def chain(spark, d):
    c = W.dependency_chain(A.segments(spark, d).withColumn("id", F.concat_ws(":", "doc_id", "ord")), "doc_id", "ord")
    return c.select("id", F.get("depends_on", F.lit(0)).alias("needs"))


@query("win21_history_tail", "SELECT conv_id, turn, count(*) OVER w AS n, first_value(text) OVER w AS oldest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
def history(spark, d):
    h = W.history_tail(A.table(spark, d, "conversations"), "conv_id", "turn")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n"), F.get("history", F.lit(0))["text"].alias("oldest"))


@query(
    "agg26_round_robin_sample",
    """WITH r AS (SELECT doc_id, source, len(regexp_extract_all(text, '\\S+')) AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents),
    b AS (SELECT *, coalesce(sum(words) OVER (ORDER BY round, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r WHERE round <= 6) SELECT doc_id, round::INT AS round FROM b WHERE b < 3000""",
)
def robin(spark, d):
    s = documents(spark, d).select("doc_id", "source", F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.lit(1).alias("book"))
    return W.round_robin_sample(s, "source", "doc_id", doc="book").select("doc_id", "round")


# --- top-k, sets


@query("top1_priority_order", f"WITH {A.WORK} SELECT id FROM wk WHERE status = 'queued' ORDER BY priority DESC, seq, created_at LIMIT 50")
def priority(spark, d):
    return K.priority_order(A.work_items(spark, d).where("status = 'queued'"), 50).select("id")


@query("top2_task_ranked_order", "SELECT event_id FROM events ORDER BY user_id % 3 DESC, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 99 END, event_id LIMIT 100")
def ranked(spark, d):
    e = A.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("priority"), F.col("event_type").alias("task"), F.col("event_id").alias("seq"))
    return K.task_ranked_order(e, {"error": 0, "click": 1}, 100).select("event_id")


@query("top6_group_limit", "SELECT user_id, n FROM (SELECT user_id, n, g, coalesce(sum(n) OVER (PARTITION BY g ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT user_id, user_id % 4 AS g, count(*) AS n FROM events GROUP BY 1, 2)) WHERE b < 100")
def grouped(spark, d):
    g = A.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("g", F.col("user_id") % 4)
    return K.group_limit(g, "user_id", "n", ["g"]).select("user_id", "n")


@query("top7_glossary_order", "WITH t AS (SELECT p_name || p_partkey AS src, count(l_orderkey) AS occurrences FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) SELECT *, row_number() OVER (ORDER BY occurrences DESC, src) AS place FROM t")
def glossary(spark, d):
    terms = A.table(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.concat("p_name", "p_partkey").alias("src"))
    g = K.glossary_order(terms, A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("term_id")))
    return W.numbered(g.select("src", "occurrences"), [F.desc("occurrences"), F.col("src")])


@query("top8_log_tail", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def tail(spark, d):
    return K.log_tail(A.table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("event_id")


@query("top10_boosted_priority", "SELECT event_id, (CASE event_type WHEN 'error' THEN 30 WHEN 'click' THEN 20 ELSE 0 END + CASE WHEN user_id % 10 = 0 THEN 500 ELSE 0 END + CASE WHEN event_type = 'view' THEN 100 ELSE 200 END)::INT AS priority FROM events")
def boosted(spark, d):
    e = A.table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("task"), F.when(F.col("event_type") == "view", "reader").otherwise(F.lit("rerun")).alias("origin"))
    return K.boosted_priority(e, {"error": 30, "click": 20}, e.where("user_id % 10 = 0").select("user_id"), "user_id").select("event_id", "priority")


@query("set2_title_union", f"WITH {A.BLOCKS} SELECT DISTINCT page_id AS doc_id, title FROM (SELECT page_id, text AS title FROM blk WHERE type = 'heading' UNION ALL SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) FROM pages UNION ALL SELECT page_id, url FROM pages) WHERE length(title) > 2")
def title_union(spark, d):
    p = A.table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")
    h = A.blocks(spark, d).where("type = 'heading'").select(F.col("page_id").alias("doc_id"), F.col("text").alias("title"))
    return SE.title_union(p.select("doc_id", F.col("url").alias("title")), p.select("doc_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title")), h)


@query("set4_exclude_known", "SELECT lower(p_name) AS key, count(*) AS n FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 30 = 0) GROUP BY 1")
def exclude(spark, d):
    p = A.table(spark, d, "part")
    return SE.exclude_known(p.groupBy(F.lower("p_name").alias("key")).agg(F.count("*").alias("n")), p.where("p_partkey % 30 = 0").select(F.upper("p_name").alias("src")))


@query(
    "set5_multiset_difference",
    f"""WITH {A.PAIRS}, a AS (SELECT conv_id, w, count(*) AS l FROM (SELECT conv_id, unnest(string_split(src, ' ')) AS w FROM prs) GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS r FROM (SELECT conv_id, unnest(string_split(tgt, ' ')) AS w FROM prs) GROUP BY ALL)
    SELECT conv_id, w, greatest(coalesce(l, 0) - coalesce(r, 0), 0) AS missing, greatest(coalesce(r, 0) - coalesce(l, 0), 0) AS extra FROM a FULL JOIN b USING (conv_id, w) WHERE coalesce(l, 0) <> coalesce(r, 0)""",
)
def bag(spark, d):
    p = A.pairs(spark, d)
    side = lambda c: p.select("conv_id", F.explode(F.split(c, " ")).alias("w"))
    return J.multiset_difference(side("src"), side("tgt"), ["conv_id"], "w")


@query("set6_insert_new_terms", "WITH t AS (SELECT p_partkey AS term_id, p_name AS src FROM part WHERE p_partkey % 40 = 0), i AS (SELECT p_partkey AS term_id, upper(p_name) AS src FROM part WHERE p_partkey % 7 = 0 AND lower(p_name) NOT IN (SELECT lower(src) FROM t)) SELECT * FROM t UNION ALL SELECT min(term_id), src FROM i GROUP BY src")
def insert(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("src"))
    return SE.insert_new_terms(p.where("term_id % 40 = 0"), p.where("term_id % 7 = 0").withColumn("src", F.upper("src")), "term_id")
