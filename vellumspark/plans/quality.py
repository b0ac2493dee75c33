"""Quality checks of translated pairs, validation and import of results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import lang, persian
from vellumspark.functions import text as T
from vellumspark.operators import joins as J
from vellumspark.operators import terms as M
from vellumspark.operators.search import build_postings
from vellumspark.sources.tables import upsert_translations
from vellumspark.staging import staged
from vellumspark.streaming.jobs import incremental_index

SEVERITY = {"empty": "high", "markup": "high", "numbers": "medium", "target_script": "high", "untranslated": "medium", "repetition": "high", "glossary": "medium", "name": "medium", "leftover_chars": "low", "latin_punctuation": "low"}
BLOCKING = ("empty", "markup", "numbers", "target_script", "repetition", "missing", "unknown", "duplicate")
LATIN_RUN = r"(?:\p{IsLatin}[\p{IsLatin}'’-]*[\s,;:]+){3,}\p{IsLatin}[\p{IsLatin}'’-]*"


def prose(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"`[^`]+`", " "), T.URL, " "), r"\([^()]*\)", " ")


def quality_check(pairs: DataFrame, keys: list[str], target: str, terms: DataFrame | None = None) -> DataFrame:
    """One row an issue of a pair (src, tgt): keys, code, severity. An empty target has that issue only.

    A pair is judged in place, so neither its words nor its texts are shuffled. terms (term_id, src, tgt, kind) adds glossary
    and name issues: a term in the source whose equivalent the target lacks.
    """
    src, tgt = F.col("src"), F.col("tgt")
    is_empty = F.regexp_replace(T.strip_markup(F.coalesce(tgt, F.lit(""))), r"[\s*]+", "") == ""
    none = F.array().cast("array<string>")
    # Texts without these signs hold no tokens.
    tokens = lambda c: F.when(c.contains("`") | c.contains("[") | c.contains("://"), F.sort_array(T.markup_tokens(c))).otherwise(none)
    repeated = lambda c: T.repeated_phrase(T.strip_markup(c))
    codes = [F.when(tokens(src) != tokens(tgt), "markup"), F.when(T.lacks_some(*J.numbers_of(src, tgt)), "numbers"), F.when(repeated(tgt).isNotNull() & repeated(src).isNull(), "repetition")]
    if lang.SCRIPTS.get(target, "IsLatin") != "IsLatin":
        script = lang.SCRIPTS[target]
        t = F.regexp_count(prose(tgt), F.lit(f"[\\p{{{script}}}&&\\p{{L}}]"))
        latin = F.regexp_count(prose(tgt), F.lit(r"\p{IsLatin}"))
        letters = F.regexp_count(prose(src), F.lit(r"\p{L}"))
        wrong = (letters >= 3) & (t + latin >= 3) & (t < 0.5 * (t + latin))
        codes.append(F.when(wrong, "target_script").when(prose(tgt).rlike(LATIN_RUN), "untranslated"))
    found = F.array_compact(F.concat(F.array(*codes), F.coalesce(T.leftover_characters(tgt, target), none)))
    issues = pairs.select(*keys, F.explode(F.when(is_empty, F.array(F.lit("empty"))).otherwise(found)).alias("code"))
    if terms is not None:
        full = pairs.where(~is_empty).select(*keys, "src", "tgt", F.concat_ws("\u0001", *keys).alias("_id"))
        here = M.match_terms(full, terms, "_id", "src").select("_id", "term_id").distinct()
        there = M.match_terms(full, terms.select("term_id", F.col("tgt").alias("src")), "_id", "tgt").select("_id", "term_id").distinct()
        kind = terms.select("term_id", F.when(F.col("kind").isin("person", "org", "place", "work"), "name").otherwise("glossary").alias("code"))
        lost = here.join(there, ["_id", "term_id"], "left_anti").join(kind, "term_id").select("_id", "code").distinct()
        issues = issues.unionByName(lost.join(full.select(*keys, "_id"), "_id").select(*keys, "code"))
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return issues.select(*keys, "code", severity[F.col("code")].alias("severity"))


def length_suspicious(pairs: DataFrame, low: float = 0.4, high: float = 2.5, least: int = 60) -> DataFrame:
    ratio = F.char_length("tgt") / F.char_length("src")
    return pairs.where((F.char_length("src") >= least) & ((ratio < low) | (ratio > high)))


def validate_results(batches: DataFrame, results: DataFrame, target: str) -> DataFrame:
    """Errors and warnings of returned items against the batch items asked for: batch_id, key, code, blocking.

    Of a key returned more than once the smallest text is checked; that it is repeated is an error of its own.
    """
    k = ["batch_id", "key"]
    integrity = J.key_integrity(batches, results, k).withColumnRenamed("rule", "code")
    pairs = batches.select(*k, "src").join(results.groupBy(*k).agg(F.min("tgt").alias("tgt")), k)
    checked = quality_check(pairs, k, target).select(*k, "code")
    lengths = length_suspicious(pairs).select(*k, F.lit("length").alias("code"))
    return integrity.unionByName(checked).unionByName(lengths).withColumn("blocking", F.col("code").isin(*BLOCKING))


def _in_script(c, target: str):
    script = lang.SCRIPTS.get(target, "IsLatin")
    return F.lit(True) if script == "IsLatin" else c.rlike(f"[\\p{{{script}}}&&\\p{{L}}]")


def term_issues(items: DataFrame, target: str) -> DataFrame:
    """Kept terms without equivalent, kind or note policy, and equivalents in another script: batch_id, key, code, blocking.

    items hold batch_id, key, keep, tgt, kind and parenthetical; terms that are not kept need nothing, acronyms any script.
    """
    fields = [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"kept_term_incomplete:{c}")) for c in ("tgt", "kind", "parenthetical")]
    foreign = (F.coalesce("tgt", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != "acronym") & ~_in_script(F.col("tgt"), target)
    codes = F.array_compact(F.array(*fields, F.when(foreign, F.lit("target_script"))))
    each = items.where("keep").select("batch_id", "key", F.explode(codes).alias("code"))
    return each.withColumn("blocking", F.col("code") != "target_script")


def brief_issues(briefs: DataFrame, target: str) -> DataFrame:
    """Briefs of unusual length or in another script: batch_id, code, blocking."""
    words = F.size(F.split(F.trim("brief"), r"\s+"))
    codes = F.array_compact(F.array(F.when((words < 60) | (words > 320), F.lit("brief_length")), F.when(~_in_script(F.col("brief"), target), F.lit("target_script"))))
    return briefs.select("batch_id", F.explode(codes).alias("code")).withColumn("blocking", F.col("code") == "target_script")


def quiz_issues(questions: DataFrame) -> DataFrame:
    """Questions that cannot be answered or graded: batch_id, n, code.

    questions hold batch_id, n, type (mcq, tf, short), question, options (array) and answer as JSON text.
    """
    options = F.coalesce(F.size("options"), F.lit(0))
    number = F.when(F.col("answer").rlike(r"^[0-9]{1,9}$"), F.col("answer").try_cast("int"))
    text = F.from_json(F.concat(F.lit('{"a":'), F.coalesce("answer", F.lit("null")), F.lit("}")), "a string")["a"]
    codes = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit("empty_question")),
        F.when((F.col("type") == "mcq") & (options < 2), F.lit("mcq_options")),
        F.when((F.col("type") == "mcq") & ~F.coalesce(number < options, F.lit(False)), F.lit("mcq_answer")),
        F.when((F.col("type") == "tf") & ~F.coalesce(F.col("answer").isin("true", "false"), F.lit(False)), F.lit("tf_answer")),
        F.when((F.col("type") == "short") & (~F.coalesce(F.col("answer").startswith('"'), F.lit(False)) | (F.trim(F.coalesce(text, F.lit(""))) == "")), F.lit("short_answer")),
    ))
    return questions.select("batch_id", "n", F.explode(codes).alias("code"))


def label_issues(used: DataFrame, given: DataFrame, rule: str = "unknown_citation") -> DataFrame:
    """Cited labels (batch_id, label) that the batch did not give: batch_id, label, code."""
    return used.select("batch_id", "label").distinct().join(given.select("batch_id", "label"), ["batch_id", "label"], "left_anti").withColumn("code", F.lit(rule))


# Checks by task: what a task's results have to pass.
CHECKS = {"translate": validate_results, "edit": validate_results, "glossary": term_issues, "brief": brief_issues, "quiz": quiz_issues, "answer": label_issues}
# Clean-up of returned texts by language; others have runs of blanks made one.
CLEAN = {"fa": persian.normalize_persian}
# Confidence below which a text is looked at again, by profile.
LOW_CONFIDENCE = {"economy": 0.7, "balanced": 0.7, "best": 0.85}


class Imported(NamedTuple):
    """Merged translations, their revisions, the flags of the imported texts, the index with them, and counts by status."""

    translations: DataFrame
    revisions: DataFrame
    flags: DataFrame
    postings: DataFrame | None
    counters: DataFrame


def import_results(current: DataFrame, results: DataFrame, sources: DataFrame, target: str, profile: str = "balanced", task: str = "edit", terms: DataFrame | None = None, postings: DataFrame | None = None) -> Imported:
    """Imports results: cleaned, first mentions noted, checked, given a status, merged with revisions, indexed and counted.

    results hold segment_id, lang, text, confidence and flag (an editor's severity or null), each segment and language once
    (streaming.jobs.import_once); sources segment_id, chapter, ord, type and src; current as for upsert_translations().
    A text is flagged by an editor's flag, confidence below the profile's bound, or an issue of medium or high severity,
    and final otherwise; translated texts are only drafts, except in the economy profile, where issues alone decide.
    Results imported again change nothing but the version.
    """
    clean = CLEAN.get(target, lambda c: F.trim(F.regexp_replace(c, r"[ \t]+", " ")))
    rows = results.withColumn("text", clean(F.col("text")))
    if terms is not None:
        placed = rows.join(sources.select("segment_id", "chapter", "ord", "type"), "segment_id")
        rows = M.first_mention_texts(placed, terms, target)[0].select(*rows.columns)
    rows = staged(rows, "imported")
    found = quality_check(rows.select("segment_id", F.col("text").alias("tgt")).join(sources.select("segment_id", "src"), "segment_id"), ["segment_id"], target, terms)
    threshold = LOW_CONFIDENCE[profile]
    own = [F.when(F.col("flag").isNotNull(), F.struct(F.lit("editor").alias("code"), F.col("flag").alias("severity"))), F.when(F.col("confidence") < threshold, F.struct(F.lit("low_confidence").alias("code"), F.lit("low").alias("severity")))]
    edited = task == "edit"
    flags = found
    if edited:
        flags = flags.unionByName(rows.select("segment_id", F.explode(F.array_compact(F.array(*own))).alias("f")).select("segment_id", "f.*"))
    flags = staged(flags, "flags")
    bad = flags.where("severity in ('medium', 'high') or code in ('editor', 'low_confidence')").select("segment_id").distinct().withColumn("_bad", F.lit(True))
    good = "drafted" if not edited and profile != "economy" else "final"
    status = F.lit(good) if good == "drafted" else F.when(F.col("_bad"), "flagged").otherwise(good)
    merged, revisions = upsert_translations(current, rows.join(bad, "segment_id", "left").select("segment_id", "lang", status.alias("status"), "text"))
    index = None
    if postings is not None:
        fresh = build_postings(rows.select(F.col("segment_id").alias("seg_id"), "text"), side="tgt")
        index = incremental_index(postings, rows.select(F.col("segment_id").alias("seg_id")), fresh)
    counters = merged.groupBy("status").agg(F.count("*").alias("n"))
    return Imported(merged, revisions, flags, index, counters)
