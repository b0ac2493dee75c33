"""Queries of operators whose inputs (items, images, fonts, contents lines) are derived from the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import persian
from vellumspark.functions import text as T
from vellumspark.operators import aggregates as G
from vellumspark.operators import filters as P
from vellumspark.operators import joins as J
from vellumspark.operators import layout as L
from vellumspark.operators import text_jobs as X
from vellumspark.operators import tree as R
from vellumspark.queries.search import EMPHASIS, MARKED, STRONG, marked, sql_steps
from vellumspark.registry import query
from vellumspark.sources import adapters as A


@query("fil6_scanned_pages", f"WITH {A.LINES}, t AS (SELECT doc_id, page, sum(length(text)) AS n FROM ln GROUP BY 1, 2) SELECT doc_id, page FROM t WHERE n < 30 AND doc_id % 2 = 0")
def scanned(spark, d):
    lines = A.lines(spark, d)
    pages = lines.select("doc_id", "page").distinct().withColumns({"width": F.lit(400.0), "height": F.lit(600.0)})
    images = pages.where("doc_id % 2 = 0").select("doc_id", "page", F.lit(400.0).alias("width"), F.lit(400.0).alias("height"))
    return P.scanned_pages(pages, lines, images)


@query("fil8_clean_recognised_words", f"WITH {A.LINES}, w AS (SELECT *, length(text) % 100 AS c FROM ln) SELECT count(*) AS n, round(sum(x0 / 3), 3)::DOUBLE AS x, greatest(floor(2 * (30 / 3.0) / 0.72 + 0.5) / 2, 4)::DOUBLE AS size FROM w WHERE c >= 20 OR regexp_matches(text, '[\\p{{L}}\\p{{N}}]')".replace("{{", "{").replace("}}", "}"))
def recognised(spark, d):
    w = A.lines(spark, d).select("text", "x0", "x1", F.col("y").alias("line_top"), (F.col("y") + 30).alias("baseline"), (F.char_length("text") % 100).alias("confidence"))
    return P.clean_recognised_words(w).groupBy("size").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x")).select("n", "x", "size")


@query("fil9_upright_items", "SELECT p_partkey, sqrt((p_partkey % 3 = 0)::INT * 0.0 + p_size * p_size)::DOUBLE AS size FROM part WHERE p_partkey % 3 = 0")
def upright(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.lit(1.0).alias("a"), F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(0.5).alias("b"), F.lit(0.0).alias("c"), F.col("p_size").cast("double").alias("d"))
    return P.upright_items(p).select("p_partkey", "size")


@query("fil10_large_images", "SELECT p_partkey FROM part WHERE p_size * 2 > 30 AND p_retailprice / 40 > 30")
def large(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2.0).alias("width"), (F.col("p_retailprice") / 40).alias("height"))
    return P.large_images(p).select("p_partkey")


@query(
    "agg9_infer_page_labels",
    f"""WITH {A.LINES}, p AS (SELECT doc_id, page, min_by(length(text), ord) AS c FROM ln GROUP BY 1, 2),
    pr AS (SELECT doc_id, page, CASE WHEN c % 7 = 0 THEN 'iv' WHEN c % 5 = 0 THEN (page + 9)::VARCHAR ELSE (page - doc_id % 3)::VARCHAR END AS printed FROM p WHERE page >= doc_id % 3 AND c % 11 <> 0),
    v AS (SELECT doc_id, printed::INT - page AS off, count(*) AS v FROM pr WHERE regexp_matches(printed, '^\\d+$') GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT doc_id, max_by(off, (v, -off)) AS off FROM v GROUP BY 1)
    SELECT doc_id, page, CASE WHEN off IS NULL THEN (page + 1)::VARCHAR WHEN page + off >= 1 THEN (page + off)::VARCHAR ELSE coalesce(printed, repeat('i', page + 1)) END AS label FROM p LEFT JOIN pr USING (doc_id, page) LEFT JOIN b USING (doc_id)""",
)
def labels(spark, d):
    pages = A.lines(spark, d).groupBy("doc_id", "page").agg(F.min_by(F.char_length("text"), "ord").alias("c"))
    offset = F.col("doc_id") % 3
    number = F.when(F.col("c") % 7 == 0, "iv").when(F.col("c") % 5 == 0, (F.col("page") + 9).cast("string")).otherwise((F.col("page") - offset).cast("string"))
    printed = pages.where((F.col("page") >= offset) & (F.col("c") % 11 != 0)).select("doc_id", "page", number.alias("printed"))
    return L.infer_page_labels(pages.select("doc_id", "page"), printed)


@query("agg24_style_share", f"WITH {A.SEGMENTS} SELECT doc_id, sum(CASE WHEN ord % 2 = 0 THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1) > 0.8 AS bold FROM seg WHERE ord % 5 <> 4 GROUP BY 1")
def styles(spark, d):
    r = A.segments(spark, d).withColumns({"superscript": F.col("ord") % 5 == 4, "bold": F.col("ord") % 2 == 0, "italic": F.lit(False), "mono": F.lit(False)})
    return G.style_share(r, ["doc_id"]).select("doc_id", "bold")


@query("join10_label_to_page", f"WITH {A.LINES}, p AS (SELECT DISTINCT doc_id, page FROM ln) SELECT doc_id, 'T' || k AS title, min(page) AS page FROM p, (SELECT unnest(range(5)) AS k) WHERE page % 5 = k AND page > 1 GROUP BY ALL")
def label_pages(spark, d):
    p = A.lines(spark, d).select("doc_id", "page").distinct().withColumn("label", F.concat(F.lit("p"), F.col("page") % 5))
    e = p.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("doc_id", F.concat(F.lit("T"), "k").alias("title"), F.concat(F.lit("P"), "k").alias("label"), F.lit(1).alias("contents_page"))
    return J.label_to_page(e, p)


@query("join18_superscript_hosts", f"WITH {A.LINES} SELECT doc_id, page, 's' || ord AS item, 'l' || ord AS host FROM ln")
def superscripts(spark, d):
    lines = A.lines(spark, d)
    big = lines.select("doc_id", "page", F.concat(F.lit("l"), "ord").alias("id"), "y", "x0", "x1", "size")
    small = lines.select("doc_id", "page", F.concat(F.lit("s"), "ord").alias("id"), (F.col("y") - 4).alias("y"), (F.col("x1") - 5).alias("x0"), F.col("x1"), F.lit(6.0).alias("size"))
    return J.superscript_hosts(big.unionByName(small))


@query("txt5_normalize_persian")
def orthography(spark, d):
    return A.segments(spark, d).select("doc_id", "ord", persian.normalize_persian(F.concat(F.lit("میشود, "), "text", F.lit(" ها"))).alias("text"))


@query("txt13_chapter_label", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 50)::VARCHAR WHEN c_custkey % 3 = 1 THEN '2' END AS number, c_name AS rest FROM customer")
def chapter_labels(spark, d):
    c = A.table(spark, d, "customer")
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Chapter "), F.col("c_custkey") % 50, F.lit(": "), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Part Two — "), "c_name")).otherwise(F.col("c_name"))
    return L.chapter_label(c.select("c_custkey", title.alias("title"))).select("c_custkey", "number", "rest")


@query("txt14_parse_contents_lines", "SELECT p_partkey AS doc_id, p_name AS title, p_size::VARCHAR AS label FROM part")
def contents(spark, d):
    p = A.table(spark, d, "part")
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" . . . . "), "p_size")).otherwise(F.concat("p_name", F.lit("    "), "p_size"))
    noise = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(1.0).alias("y"), F.lit(50.0).alias("x0"), F.col("p_name").alias("text"))
    return L.parse_contents_lines(noise.withColumn("text", F.col("text")).unionByName(p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0.0).alias("y"), F.lit(50.0).alias("x0"), line.alias("text")))).select("doc_id", "title", "label")


@query(
    "txt15_render_block_text",
    f"""WITH {A.SEGMENTS}, r AS (SELECT *, length(text) % 3 = 0 AS bold, length(text) % 3 = 1 AS italic FROM seg WHERE text <> ''),
    w AS (SELECT doc_id, sum(CASE WHEN bold THEN length(text) ELSE 0 END) / sum(length(text)) > 0.8 AS b, sum(CASE WHEN italic THEN length(text) ELSE 0 END) / sum(length(text)) > 0.8 AS i FROM r WHERE NOT regexp_matches(text, '^\\s*\\d{{1,3}}\\s*$') GROUP BY 1),
    k AS (SELECT doc_id, ord, text, CASE WHEN bold AND NOT coalesce(b, FALSE) THEN '**' WHEN italic AND NOT coalesce(i, FALSE) THEN '*' ELSE '' END AS k, regexp_replace(text, '([*`])', '\\\\\\1', 'g') AS safe FROM r LEFT JOIN w USING (doc_id)),
    p AS (SELECT doc_id, ord, CASE WHEN regexp_matches(text, '^\\s*\\d{{1,3}}\\s*$') THEN '[^' || trim(text) || ']' WHEN trim(safe) = '' THEN text
      ELSE regexp_extract(text, '^\\s*') || k || trim(safe) || k || regexp_extract(text, '\\s*$') END AS piece FROM k)
    SELECT doc_id, replace(string_agg(piece, '' ORDER BY ord), '****', '') AS text FROM p GROUP BY 1""",
)
def rendered(spark, d):
    n = F.char_length("text")
    runs = A.segments(spark, d).where("text <> ''").select("doc_id", "ord", "text", (n % 3 == 0).alias("bold"), (n % 3 == 1).alias("italic"), F.col("text").rlike(r"^\s*\d{1,3}\s*$").alias("sup"))
    return L.render_block_text(runs, ["doc_id"], "ord")


@query(
    "txt17_font_flags",
    """SELECT c_custkey, regexp_matches(n, 'bold|black|heavy|demi') AS bold, regexp_matches(n, 'italic|oblique') AS italic, regexp_matches(n, 'mono|courier|consol|typewriter|code') AS mono
    FROM (SELECT c_custkey, lower(c_mktsegment || '+' || ['Times-Bold', 'CourierNew', 'Lato-BlackItalic', 'Georgia', 'DejaVuSansMono-Oblique', 'Inter-DemiBold', 'SourceCodePro'][c_custkey % 7 + 1]) AS n FROM customer)""",
)
def fonts(spark, d):
    names = ("Times-Bold", "CourierNew", "Lato-BlackItalic", "Georgia", "DejaVuSansMono-Oblique", "Inter-DemiBold", "SourceCodePro")
    c = A.table(spark, d, "customer").withColumn("font", F.concat("c_mktsegment", F.lit("+"), F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("c_custkey") % 7 + 1).cast("int"))))
    bold, italic, mono = T.font_flags(F.col("font"))
    return c.select("c_custkey", bold.alias("bold"), italic.alias("italic"), mono.alias("mono"))


HTML = sql_steps("m", ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (r"`([^`]+)`", r"<code>\1</code>"), (STRONG, r"<strong>\1</strong>"), (EMPHASIS, r"<em>\1</em>"), (r"\[\^([^\]\s]+)\]", r"<sup>\1</sup>"), (r"\[\[(fig|tab):([^\]\s]+)\]\]", r"<span>\1 \2</span>"))


@query("txt18_markup_to_html", f"SELECT doc_id, {HTML} AS html FROM (SELECT doc_id, {MARKED} || ' <b> & \"x\"' AS m FROM documents)")
def markup(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.markup_to_html(F.concat(marked("text"), F.lit(' <b> & "x"'))).alias("html"))


EXPORT = f"""{A.SEGMENTS}, nd AS (SELECT source AS book, doc_id, doc_id % 2 AS depth, CASE WHEN doc_id % 2 = 0 THEN 'chapter' ELSE 'section' END AS kind, lang || ' <' || doc_id || '>' AS ts, CASE WHEN doc_id % 3 = 0 THEN 'T & ' || doc_id END AS tt, doc_id % 11 = 0 AS skip, doc_id - doc_id % 2 AS chapter FROM documents),
  tl AS (SELECT *, replace(replace(replace(coalesce(tt, ts), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title, replace(replace(ts, '<', '&lt;'), '>', '&gt;') AS st FROM nd),
  rw AS (SELECT doc_id, ord, {MARKED} AS m FROM seg),
  hr AS (SELECT doc_id, string_agg(h || '|' || CASE WHEN ord % 2 = 0 THEN '«' || h || '»' ELSE '' END, chr(10) ORDER BY ord) AS rows FROM (SELECT doc_id, ord, {HTML} AS h FROM rw) GROUP BY 1),
  ct AS (SELECT source AS book, count(*) FILTER (WHERE ord % 4 = 0) AS done, count(*) AS total FROM seg GROUP BY 1),
  gl AS (SELECT 'src' || p_partkey % 20 AS book, string_agg(p_name || '=' || p_brand || '=' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END, ';' ORDER BY p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END) AS glossary FROM part GROUP BY 1)"""


@query(
    "src8_reading_export",
    f"""WITH {EXPORT} SELECT t.book, t.doc_id AS id, t.depth, CASE WHEN t.kind = 'chapter' THEN t.doc_id % 10 || '. ' ELSE '' END || t.title AS label, CASE WHEN t.tt IS NOT NULL THEN t.st END AS sub,
      t.title, CASE WHEN t.chapter <> t.doc_id THEN c.title END AS chapter, rows, done, total, glossary
    FROM tl t JOIN hr ON hr.doc_id = t.doc_id LEFT JOIN tl c ON c.book = t.book AND c.doc_id = t.chapter LEFT JOIN ct ON ct.book = t.book LEFT JOIN gl ON gl.book = t.book WHERE NOT t.skip""",
)
def reading_export(spark, d):
    """Sources as books, documents as chapters and sections; every contents entry with its section, the glossary and the counters."""
    from vellumspark.sources import tables as S

    docs, n = A.table(spark, d, "documents"), F.col("doc_id")
    nodes = docs.select(
        F.col("source").alias("book"), n.alias("node_id"), n.alias("pos"), (n % 2).alias("depth"), F.when(n % 2 == 0, "chapter").otherwise("section").alias("kind"), (n % 10).alias("number"),
        F.concat("lang", F.lit(" <"), n, F.lit(">")).alias("title_src"), F.when(n % 3 == 0, F.concat(F.lit("T & "), n)).alias("title_tgt"), (n % 11 == 0).alias("skip"), (n - n % 2).alias("chapter"),
    )
    text = A.segments(spark, d).select(F.col("source").alias("book"), n.alias("node_id"), "ord", F.lit("paragraph").alias("type"), marked("text").alias("src"))
    rows = text.withColumn("tgt", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("«"), "src", F.lit("»"))))
    k = F.col("p_partkey")
    terms = A.table(spark, d, "part").select(F.concat(F.lit("src"), k % 20).alias("book"), F.col("p_name").alias("src"), F.col("p_brand").alias("tgt"), F.when(k % 2 == 0, F.col("p_type")).alias("definition"))
    counts = text.groupBy("book").agg(F.count_if(F.col("ord") % 4 == 0).alias("done"), F.count("*").alias("total"))
    entries, books = S.reading_export(nodes, rows, terms, counts)
    glossary = F.array_join(F.transform("glossary", lambda t: F.concat_ws("=", t["src"], t["tgt"], t["definition"])), ";").alias("glossary")
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws("|", r["src"], r["tgt"])), "\n").alias("rows")
    sections = entries.where("rows is not null").select("book", "id", "depth", "label", "sub", "title", "chapter", text)
    return sections.join(books.select("book", "done", "total", glossary), "book", "left")


@query("txt21_split_authors", "SELECT p_partkey, len(string_split(p_name, ' '))::INT AS n FROM part")
def authors(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", " and ").alias("a"))
    return p.select("p_partkey", F.size(T.split_authors(F.col("a"))).alias("n"))


@query("txt22_untranslated_runs", f"WITH {A.PAIRS} SELECT conv_id, turn FROM prs WHERE regexp_matches(regexp_replace(regexp_replace(regexp_replace(tgt, '`[^`]+`', ' ', 'g'), 'https?://[^\\s<>\"''\\]\\)]*[^\\s<>\"''\\]\\).,;:!?]', ' ', 'g'), '\\([^()]*\\)', ' ', 'g'), '(?:\\p{{Latin}}[\\p{{Latin}}''’-]*[\\s,;:]+){{3,}}\\p{{Latin}}')")
def untranslated(spark, d):
    return X.untranslated_runs(A.pairs(spark, d), ["conv_id", "turn"]).select("conv_id", "turn")


@query("tree9_apply_structure_ops")
def edits(spark, d):
    n = A.nodes(spark, d).where("depth > 0").withColumn("book", F.coalesce(F.when(F.col("depth") == 1, F.col("node_id")), F.col("parent_id"))).withColumn("parent_id", F.when(F.col("depth") == 2, F.col("parent_id"))).withColumn("depth", F.col("depth") - 1)
    s = n.where("depth = 1").select("book", F.concat(F.lit("s"), "node_id").alias("segment_id"), "node_id", F.lit(0).alias("ord"))
    ops = n.where("depth = 1").groupBy("book").agg(F.min("node_id").alias("node_id")).select("book", "node_id", F.element_at(F.array(*(F.lit(x) for x in ("rename", "skip", "promote", "demote", "merge_next"))), (F.abs(F.xxhash64("book")) % 5 + 1).cast("int")).alias("op"), F.lit("new").alias("value"))
    return R.apply_structure_ops(n, s, ops)[0]
