"""Queries of terminology."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions.lang import TERM_STOP
from vellumspark.operators import terms as M
from vellumspark.registry import query
from vellumspark.sources import adapters as A

STOP = ", ".join("'" + w + "'" for w in TERM_STOP)
WORD = "\\p{L}[\\p{L}\\p{N}''’-]*"
GRAMS = f"""cl AS (SELECT doc_id, unnest(range(len(l)))::INT AS c, unnest(l) AS clause FROM (SELECT doc_id, string_split_regex(text, '[,;:()\\[\\]{{}}«»"“”—–?!.]') AS l FROM documents WHERE lang = 'en')),
ew AS (SELECT doc_id, c, unnest(range(len(w)))::INT AS i, unnest(w) AS w1 FROM (SELECT doc_id, c, regexp_extract_all(clause, '{WORD}') AS w FROM cl)),
ld AS (SELECT *, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM ew WINDOW o AS (PARTITION BY doc_id, c ORDER BY i)),
gr AS (SELECT lower(w1) AS key, 1 AS words FROM ld WHERE length(w1) >= 4 AND lower(w1) NOT IN ({STOP})
  UNION ALL SELECT lower(w1 || ' ' || w2), 2 FROM ld WHERE length(w1) >= 2 AND length(w2) >= 2 AND lower(w1) NOT IN ({STOP}) AND lower(w2) NOT IN ({STOP})
  UNION ALL SELECT lower(w1 || ' ' || w2 || ' ' || w3), 3 FROM ld WHERE length(w1) >= 2 AND length(w2) >= 2 AND length(w3) >= 2 AND lower(w1) NOT IN ({STOP}) AND lower(w3) NOT IN ({STOP})
  UNION ALL SELECT lower(w1 || ' ' || w2 || ' ' || w3 || ' ' || w4), 4 FROM ld WHERE length(w1) >= 2 AND length(w2) >= 2 AND length(w3) >= 2 AND length(w4) >= 2 AND lower(w1) NOT IN ({STOP}) AND lower(w4) NOT IN ({STOP}))"""
ISLANDS = f"""{GRAMS}, ic AS (SELECT *, regexp_matches(w1, '^\\p{{Lu}}\\p{{Ll}}') AND lower(w1) NOT IN ({STOP}) AS cap FROM ew),
im AS (SELECT *, sum((NOT cap)::INT) OVER (PARTITION BY doc_id, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM ic),
ir AS (SELECT string_agg(w1, ' ' ORDER BY i) AS form, count(*)::INT AS words, min(i) AS i FROM im WHERE cap GROUP BY doc_id, c, g HAVING count(*) >= 2 OR min(i) > 0),
tl AS (SELECT key, words, 0 AS bonus FROM gr UNION ALL SELECT lower(form), words, 2 FROM ir UNION ALL SELECT lower(w1), 1, 2 FROM ew WHERE regexp_matches(w1, '^\\p{{Lu}}{{2,}}\\p{{N}}*$')),
tm AS (SELECT key, max(words) AS words, count(*) AS n, max(bonus) AS bonus FROM tl GROUP BY 1)"""
PLURALS = f"""{ISLANDS}, pl AS (SELECT *, regexp_extract(key, '(\\S+)$', 1) AS last, regexp_replace(key, '\\S+$', '') AS head FROM tm),
sg AS (SELECT *, head || CASE WHEN length(last) > 4 AND last LIKE '%ies' THEN last[:-4] || 'y' WHEN regexp_matches(last, '(?:ses|xes|zes|ches|shes)$') THEN last[:-3] WHEN last LIKE '%s' AND NOT regexp_matches(last, '(?:ss|us|is)$') THEN last[:-2] END AS target FROM pl),
mg AS (SELECT coalesce(k.key, sg.key) AS key, max(sg.words) AS words, sum(sg.n)::BIGINT AS n, max(sg.bonus) AS bonus FROM sg LEFT JOIN tm k ON k.key = sg.target GROUP BY 1),
sc AS (SELECT *, round(n * words ** 1.5 + bonus, 6) AS score FROM mg WHERE CASE WHEN bonus >= 2 THEN n >= 2 WHEN words = 1 THEN n >= 4 ELSE n >= 3 END)"""


def english(spark, d):
    return A.table(spark, d, "documents").where("lang = 'en'")


def dictionary(spark, d):
    p = A.table(spark, d, "documents").where("lang = 'en'").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("src")).where("char_length(src) between 5 and 8")
    n = p.groupBy("src").agg(F.count("*").alias("n")).where("n >= 20")
    return n.select(F.col("src").alias("term_id"), "src")


@query("agg12_term_candidates", f"WITH {ISLANDS} SELECT * FROM tm")
def candidates(spark, d):
    return M.surface_form(M.term_candidates(english(spark, d))).select("key", "words", "n", "bonus")


@query("agg13_merge_plurals", f"WITH {PLURALS} SELECT * FROM mg")
def plurals(spark, d):
    return M.merge_plurals(M.surface_form(M.term_candidates(english(spark, d)))).select("key", "words", "n", "bonus")


@query("agg14_candidate_scores", f"WITH {PLURALS} SELECT * FROM sc")
def scores(spark, d):
    return M.candidate_scores(M.merge_plurals(M.surface_form(M.term_candidates(english(spark, d))))).select("key", "words", "n", "bonus", "score")


@query("agg15_surface_form", "WITH w AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS form FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)), f AS (SELECT lower(form) AS key, form, count(*) AS n, min(lpad(doc_id::VARCHAR, 12, '0') || lpad(i::VARCHAR, 9, '0')) AS p FROM w GROUP BY ALL), t AS (SELECT key, max(n) AS top FROM f GROUP BY 1) SELECT key, min_by(form, p) AS form FROM f JOIN t USING (key) WHERE n = top GROUP BY 1")
def forms(spark, d):
    w = A.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "form"))
    place = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("i").cast("string"), 9, "0"))
    t = w.groupBy(F.lower("form").alias("key"), "form").agg(F.count("*").alias("n"), F.min(place).alias("place")).withColumn("words", F.lit(1)).withColumn("bonus", F.lit(0))
    return M.surface_form(t).select("key", "form")


MATCHES = """dt AS (SELECT src FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS src FROM documents WHERE lang = 'en') WHERE length(src) BETWEEN 5 AND 8 GROUP BY 1 HAVING count(*) >= 20),
cn AS (SELECT src, CASE WHEN src LIKE '%ies' THEN src[:-4] || 'y' ELSE regexp_replace(src, '(es|s|e)$', '') END AS g FROM dt),
dg AS (SELECT g, max_by(src, (length(src), src)) AS term_id FROM cn GROUP BY 1),
tw AS (SELECT doc_id, unnest(range(len(l)))::INT AS start, lower(unnest(l)) AS w FROM (SELECT doc_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}''’-]+'), lambda x: x <> '') AS l FROM documents WHERE lang = 'en')),
tg AS (SELECT doc_id, start, regexp_replace(w, '[''’]s?$', '') AS x FROM tw),
mt AS (SELECT doc_id, term_id, start FROM (SELECT doc_id, start, CASE WHEN x LIKE '%ies' AND length(x) > 3 THEN x[:-4] || 'y' ELSE regexp_replace(x, '(es|s|e)$', '') END AS g FROM tg) JOIN dg USING (g))"""


@query(
    "agg16_example_sentences",
    f"""WITH {MATCHES}, {A.SEGMENTS}, sw AS (SELECT doc_id, ord, text, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}''’-]+'), lambda x: x <> '')) AS l FROM seg WHERE lang = 'en'),
    ex AS (SELECT src AS key, CASE WHEN length(text) > 240 THEN text[1:237] || '…' ELSE text END AS sentence, row_number() OVER (PARTITION BY src ORDER BY doc_id, ord) AS k FROM (SELECT doc_id, ord, text, unnest(l) AS src FROM sw) JOIN dt USING (src))
    SELECT key, string_agg(sentence, '|' ORDER BY k) AS examples FROM ex WHERE k <= 2 GROUP BY 1""",
)
def examples(spark, d):
    s = A.segments(spark, d).where("lang = 'en'").select(F.struct("doc_id", "ord").alias("place"), F.col("text").alias("sentence"))
    return M.example_sentences(dictionary(spark, d).select(F.col("src").alias("key")), s).select("key", F.array_join("examples", "|").alias("examples"))


@query(
    "top5_candidate_topk",
    f"WITH {PLURALS} SELECT key, score FROM sc ORDER BY score DESC, key LIMIT 120",
)
def topk(spark, d):
    s = M.candidate_scores(M.merge_plurals(M.surface_form(M.term_candidates(english(spark, d)))))
    return s.orderBy(F.desc("score"), "key").limit(120).select("key", "score")


@query("join5_match_terms", f"WITH {MATCHES} SELECT doc_id, term_id, start FROM mt")
def matches(spark, d):
    return M.match_terms(english(spark, d), dictionary(spark, d)).select("doc_id", "term_id", "start")


@query("join6_terms_in_texts", f"WITH {MATCHES} SELECT DISTINCT term_id FROM mt")
def present(spark, d):
    return M.terms_in_texts(english(spark, d), dictionary(spark, d)).select("term_id")


@query("join15_affected_segments", f"WITH {MATCHES}, {A.TRANSLATIONS} SELECT DISTINCT doc_id AS segment_id FROM mt JOIN tr ON segment_id = doc_id WHERE status NOT IN ('pending', 'queued')")
def affected(spark, d):
    s = english(spark, d).withColumnRenamed("doc_id", "segment_id")
    return M.affected_segments(s, A.translations(spark, d), dictionary(spark, d))


@query(
    "join16_earlier_terms",
    f"""WITH {MATCHES}, f AS (SELECT doc_id % 10 AS book, term_id, min(doc_id) AS pos FROM mt GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos, term_id) AS k FROM f) WHERE k <= 60)
    SELECT p.book, p.pos, k.term_id FROM (SELECT DISTINCT doc_id % 10 AS book, doc_id AS pos FROM documents WHERE lang = 'en') p JOIN k ON k.book = p.book AND k.pos < p.pos""",
)
def earlier(spark, d):
    m = M.match_terms(english(spark, d), dictionary(spark, d)).select((F.col("doc_id") % 10).alias("book"), "term_id", F.col("doc_id").alias("pos"))
    return M.earlier_terms(m, english(spark, d).select((F.col("doc_id") % 10).alias("book"), F.col("doc_id").alias("pos")), "book")


@query(
    "win11_first_mentions",
    f"""WITH {MATCHES}, m AS (SELECT doc_id % 10 AS chapter, doc_id AS ord, start, term_id, start % 3 = 0 AS note, CASE WHEN term_id < 'e' THEN 'never' WHEN term_id < 'h' THEN 'always' ELSE 'first' END AS policy FROM mt),
    r AS (SELECT *, row_number() OVER (PARTITION BY chapter, term_id ORDER BY ord, start) = 1 AND policy <> 'never' AS f FROM m WHERE policy <> 'always')
    SELECT chapter, ord, start, term_id, CASE WHEN f AND note THEN 'keep' WHEN f THEN 'add' WHEN note THEN 'remove' ELSE 'none' END AS edit FROM r""",
)
def mentions(spark, d):
    t = dictionary(spark, d)
    m = M.match_terms(english(spark, d), t).select((F.col("doc_id") % 10).alias("chapter"), F.col("doc_id").alias("ord"), "start", "term_id", (F.col("start") % 3 == 0).alias("has_note"))
    return M.first_mentions(m, t.withColumn("policy", F.when(F.col("src") < "e", "never").when(F.col("src") < "h", "always").otherwise("first"))).drop("has_note")


@query("set3_terms_either_side", f"WITH {MATCHES} SELECT DISTINCT term_id FROM mt WHERE doc_id % 2 = 0 UNION SELECT DISTINCT term_id FROM mt WHERE doc_id % 3 = 0")
def either(spark, d):
    t = dictionary(spark, d)
    one = M.match_terms(english(spark, d).where("doc_id % 2 = 0"), t).select("term_id")
    two = M.match_terms(english(spark, d).where("doc_id % 3 = 0"), t).select("term_id")
    return t.join(one.union(two).distinct(), "term_id", "left_semi").select("term_id")


MINED = f"""{PLURALS}, gf AS (SELECT doc_id::VARCHAR AS d, c, i, 1 AS n, lower(w1) AS form FROM ld WHERE length(w1) >= 4 AND lower(w1) NOT IN ({STOP})
  UNION ALL SELECT doc_id::VARCHAR, c, i, 2, lower(w1 || ' ' || w2) FROM ld WHERE length(w1) >= 2 AND length(w2) >= 2 AND lower(w1) NOT IN ({STOP}) AND lower(w2) NOT IN ({STOP})
  UNION ALL SELECT doc_id::VARCHAR, c, i, 3, lower(w1 || ' ' || w2 || ' ' || w3) FROM ld WHERE length(w1) >= 2 AND length(w2) >= 2 AND length(w3) >= 2 AND lower(w1) NOT IN ({STOP}) AND lower(w3) NOT IN ({STOP})
  UNION ALL SELECT doc_id::VARCHAR, c, i, 4, lower(w1 || ' ' || w2 || ' ' || w3 || ' ' || w4) FROM ld WHERE length(w1) >= 2 AND length(w2) >= 2 AND length(w3) >= 2 AND length(w4) >= 2 AND lower(w1) NOT IN ({STOP}) AND lower(w4) NOT IN ({STOP})
  UNION ALL SELECT doc_id::VARCHAR, c, min(i), 0, string_agg(w1, ' ' ORDER BY i) FROM im WHERE cap GROUP BY doc_id, c, g HAVING count(*) >= 2 OR min(i) > 0
  UNION ALL SELECT doc_id::VARCHAR, c, i, 0, w1 FROM ew WHERE regexp_matches(w1, '^\\p{{Lu}}{{2,}}\\p{{N}}*$')),
fm AS (SELECT key, form FROM (SELECT lower(form) AS key, form, row_number() OVER (PARTITION BY lower(form) ORDER BY count(*) DESC, min((d, c, i)), min(n)) AS k FROM gf GROUP BY form) WHERE k = 1),
mf AS (SELECT coalesce(k.key, sg.key) AS key, arg_max(fm.form, (sg.key = coalesce(k.key, sg.key), sg.n, fm.form)) AS form FROM sg LEFT JOIN tm k ON k.key = sg.target JOIN fm ON fm.key = sg.key GROUP BY 1),
lr AS (SELECT words, n, string_split(key, ' ') AS l FROM sc WHERE words > 1),
rn AS (SELECT array_to_string(l[i : i + k - 1], ' ') AS key, max(n) AS big FROM lr, (SELECT unnest(range(1, 4)) AS k), (SELECT unnest(range(1, 5)) AS i) WHERE k < words AND i + k - 1 <= words GROUP BY 1),
bt AS (SELECT sc.* FROM sc LEFT JOIN rn USING (key) WHERE big IS NULL OR big < 0.8 * n ORDER BY score DESC, key LIMIT 120)"""


def mined(spark, d):
    from vellumspark.plans.mining import term_mining

    return term_mining(english(spark, d))


@query("job3_term_mining", f"WITH {MINED} SELECT form AS src, key, n, score FROM bt JOIN mf USING (key)")
def mining(spark, d):
    return mined(spark, d).select("src", "key", "n", "score")


@query("job3_examples")
def mining_examples(spark, d):
    return mined(spark, d).select("key", "examples")


@query("win11_first_mention_texts")
def mention_texts(spark, d):
    """Every document with its own matches as equivalents; words with an e already have their note."""
    return M.first_mention_texts(*noted(spark, d))[0].select("segment_id", "text")


def noted(spark, d):
    """Segments and managed terms of the query above."""
    t = dictionary(spark, d).select("term_id", F.concat(F.lit("src "), "src").alias("src"), F.col("src").alias("tgt"), F.when(F.col("src") < "e", "never").otherwise(F.lit("first_in_chapter")).alias("policy"))
    s = english(spark, d).select(F.col("doc_id").alias("segment_id"), (F.col("doc_id") % 10).alias("chapter"), F.col("doc_id").alias("ord"), F.lit("p").alias("type"), F.regexp_replace("text", r"(?i)\b(\w*e\w*)\b", "$1 (src $1)").alias("text"))
    return s, t
