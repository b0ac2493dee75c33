"""Logical tables of the corpus model, made from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of a document: doc_id, ord, text, lang, source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).select("doc_id", "ord", "text", "lang", "source")


SEGMENTS = "seg AS (SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS text, lang, source FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned lines: doc_id, ord, page, y, x0, x1, size, text; 40 lines a page.

    Size, left edge and gap come from the text: a document's first line is large, its body is of 10 or 12, some lines are
    small, some indented, and some stand a little lower.
    """
    s = segments(spark, sf_dir)
    n = F.char_length("text")
    body = F.when(F.col("doc_id") % 3 == 1, 12.0).otherwise(10.0)
    size = F.when(F.col("ord") == 0, 16.0).when(n % 11 == 0, 8.0).otherwise(body)
    y = F.lit(14.0) * (F.col("ord") % 40) + F.when(n % 5 == 0, 1.5).otherwise(0.0)
    x0 = F.lit(50.0) + F.when(n % 4 == 1, 18.0).otherwise(0.0)
    return s.select("doc_id", "ord", F.floor(F.col("ord") / 40).cast("int").alias("page"), y.alias("y"), x0.alias("x0"), (x0 + 5 * n).alias("x1"), size.alias("size"), "text")


LINES = SEGMENTS + """, ln AS (SELECT doc_id, ord, (ord // 40)::INT AS page, (14.0 * (ord % 40) + CASE WHEN length(text) % 5 = 0 THEN 1.5 ELSE 0 END)::DOUBLE AS y, x0, x0 + 5 * length(text) AS x1,
  (CASE WHEN ord = 0 THEN 16 WHEN length(text) % 11 = 0 THEN 8 WHEN doc_id % 3 = 1 THEN 12 ELSE 10 END)::DOUBLE AS size, text
  FROM (SELECT *, (CASE WHEN length(text) % 4 = 1 THEN 68 ELSE 50 END)::DOUBLE AS x0 FROM seg))"""


# Elements whose content is no text, and tags that stand inside a line of text.
_RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\z)"
_ATTRIBUTES = r"""(?:\s(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)?/?>"""
_INLINE = r"(?i)</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|img|ins|kbd|label|mark|q|rp|rt|ruby|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)" + _ATTRIBUTES


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and list items of pages in order: page_id, ord, type, level, text.

    A block reaches from its opening tag to its closing tag or the next tag that is not inline; a division that opens a
    list item is part of it. Inline tags are taken out, a line break becomes a space; blocks without any text are none.
    """
    html = F.regexp_replace(F.regexp_replace("html", _RAW, ""), r"<(?![A-Za-z/!?])", "&lt;")
    html = F.regexp_replace(F.regexp_replace(html, _INLINE, ""), "(?i)<br" + _ATTRIBUTES, " ")
    html = F.regexp_replace(html, r"(?i)(<li\b[^>]*>)\s*(?:<div" + _ATTRIBUTES + r"\s*)+", "$1")
    found = F.regexp_extract_all(html, F.lit("(?i)<(?:h[1-6]|p|li)" + _ATTRIBUTES + "[^<]+"), F.lit(0))
    b = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ord", "m"))
    tag = F.lower(F.regexp_extract("m", r"^<(\w+)", 1))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "p", "paragraph").otherwise("list_item")
    return b.select("page_id", "ord", kind.alias("type"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("level"), F.regexp_replace("m", r"^<\w+" + _ATTRIBUTES, "").alias("text"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _stripped(html: str, *steps: tuple[str, str]) -> str:
    for pattern, value in steps:
        html = f"regexp_replace({html}, {_quoted(pattern)}, {_quoted(value)}, 'g')"
    return html


# The same rules in the pattern language of DuckDB, which has neither look-around nor back-references.
_SQL_ATTRIBUTES = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?/?>"""
_SQL_INLINE = _INLINE.replace(_ATTRIBUTES, _SQL_ATTRIBUTES)
_SQL_RAW = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "textarea", "title"))
_SQL_HTML = _stripped("html", (_SQL_RAW, ""), (r"<([^A-Za-z/!?]|\z)", r"&lt;\1"), (_SQL_INLINE, ""), ("(?i)<br" + _SQL_ATTRIBUTES, " "), (r"(?i)(<li\b[^>]*>)\s*(?:<div" + _SQL_ATTRIBUTES + r"\s*)+", r"\1"))
BLOCKS = f"""blk AS (SELECT page_id, ord, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'p' THEN 'paragraph' ELSE 'list_item' END AS type,
  CASE WHEN tag LIKE 'h%' THEN tag[2:2]::INT END AS level, regexp_replace(m, {_quoted("^<[A-Za-z0-9]+" + _SQL_ATTRIBUTES)}, '') AS text
  FROM (SELECT page_id, ord, m, lower(regexp_extract(m, '^<([A-Za-z0-9]+)', 1)) AS tag FROM
    (SELECT page_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS m FROM (SELECT page_id, regexp_extract_all({_SQL_HTML}, {_quoted("(?i)<(?:h[1-6]|p|li)" + _SQL_ATTRIBUTES + "[^<]+")}) AS l FROM pages))))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the next assistant turn: conv_id, turn, src, tgt."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("src"), F.lead("text").over(w).alias("tgt"), F.lead("role").over(w).alias("next"))
    return c.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", "src", "tgt")


PAIRS = """prs AS (SELECT conv_id, turn, text AS src, tgt FROM (SELECT *, lead(text) OVER w AS tgt, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nxt = 'assistant')"""


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation rows keyed by segment_id: status, engine confidence, draft and final text, flags, version.

    The draft is the whole text of a document; the final text, where there is one, has an edit after its last word.
    """
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    status = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 0, "queued").when(F.col("doc_id") % 5 == 0, "user_edited").when(F.col("doc_id") % 3 == 0, "drafted").otherwise("final")
    return joined.select(
        F.col("doc_id").alias("segment_id"), "lang", status.alias("status"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.col("text").alias("draft"),
        F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" (edited)"))).alias("final"), F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"))).alias("flags"), F.lit(1).alias("version"),
    )


TRANSLATIONS = """tr AS (SELECT doc_id AS segment_id, lang, CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 0 THEN 'queued' WHEN doc_id % 5 = 0 THEN 'user_edited' WHEN doc_id % 3 = 0 THEN 'drafted' ELSE 'final' END AS status,
  (doc_id % 10) / 10 AS confidence, text AS draft, CASE WHEN doc_id % 2 = 0 THEN text || ' (edited)' END AS final,
  CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n_flags, 1 AS version FROM labels JOIN documents USING (doc_id))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level tree of region, nation and customer: node_id, parent_id, ord, depth, kind, title, skip."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(0).alias("depth"), F.lit("part").alias("kind"), F.col("r_name").alias("title"), F.lit(False).alias("skip"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long"), F.lit(1), F.lit("chapter"), "n_name", F.col("n_nationkey") % 7 == 3)
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_custkey").cast("long"), F.lit(2), F.lit("section"), "c_name", F.col("c_acctbal") < 0)
    return r.union(n).union(c)


NODES = """nd AS (SELECT 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, r_regionkey::BIGINT AS ord, 0 AS depth, 'part' AS kind, r_name AS title, FALSE AS skip FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 1, 'chapter', n_name, n_nationkey % 7 = 3 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 2, 'section', c_name, c_acctbal < 0 FROM customer)"""


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work items that depend on others: id, status, priority, seq, created_at, depends_on."""
    deps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("o"), F.col("l_partkey") * 11))).alias("depends_on"))
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    joined = o.join(deps, o.o_orderkey == deps.l_orderkey, "left")
    return joined.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("created_at"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), F.col("o_custkey").alias("book"))


WORK = """wk AS (SELECT 'o' || o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status, o_orderpriority[1:1]::INT AS priority,
  o_orderkey AS seq, o_orderdate AS created_at, o_custkey AS book FROM orders),
dep AS (SELECT DISTINCT 'o' || l_orderkey AS id, 'o' || (l_partkey * 11) AS needs FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as keyed requests; event time as a timestamp with time zone."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "props")
