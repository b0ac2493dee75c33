"""Text normalisation and token expressions. All are built-in expressions but the Unicode forms, which Spark lacks."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions import lang


@functools.cache
def _class(form: str) -> str:
    """A pattern class of the characters that a Unicode form may change, as ranges, by the rule of the form itself."""
    composing = form in ("NFC", "NFKC")
    jamo = lambda k: 0x1161 <= k <= 0x1175 or 0x11A8 <= k <= 0x11C2
    changed = [k for k in range(0x80, 0x30000) if not 0xD800 <= k < 0xE000 and (unicodedata.normalize(form, chr(k)) != chr(k) or unicodedata.combining(chr(k)) or composing and jamo(k))]
    return _ranges(changed)


def _holds(c: Column, characters: str) -> Column:
    """Whether a text holds a character of the class; one range tells most texts apart before the many are tried."""
    first = re.match(r"\[(\\x\{[0-9a-f]+\})", characters)[1]
    return c.rlike(f"[{first}-\\x{{10ffff}}]") & c.rlike(characters)


def _ranges(codes: list[int]) -> str:
    out, start = [], None
    for k, after in zip(codes, [*codes[1:], -1]):
        start = k if start is None else start
        if after != k + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{k:x}}}")
            start = None
    return "[" + "".join(out) + "]"


def _form(name: str):
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(name, x))

    def of(c: Column) -> Column:
        # Only texts that the form may change go to Python; of the others it gets nulls.
        touched = _holds(c, _class(name))
        return F.when(touched, normal(F.when(touched, c))).otherwise(c)

    return of


MARKS = r"[\u064B-\u065F\u0670\u0640\u0300-\u036F]"


@functools.cache
def _folding() -> tuple[str, str, str]:
    """Letters that lose nothing but MARKS when taken apart, the letters left, and the class of all others that change."""
    marks, source, target, other = re.compile(MARKS), [], [], []
    for k in range(0x80, 0x30000):
        if 0xD800 <= k < 0xE000:
            continue
        apart = unicodedata.normalize("NFD", chr(k))
        left = marks.sub("", apart)
        if apart != chr(k):
            if len(left) == 1 and ord(left) < 0x10000 and k < 0x10000:
                source.append(chr(k))
                target.append(left)
            else:
                other.append(k)
        elif unicodedata.combining(chr(k)) and not marks.match(chr(k)):
            other.append(k)
    return "".join(source), "".join(target), _ranges(other)


@functools.cache
def _search_folding() -> tuple[str, str, str]:
    """One translation for all that without_marks, FOLD_FROM and fold_digits do one after another to texts of one-to-one
    letters, marks last as they go; and the class of the letters that need NFD."""
    source, target, other = _folding()
    folds = str.maketrans(lang.FOLD_FROM + lang.PERSIAN_DIGITS + lang.ARABIC_DIGITS, lang.FOLD_TO + lang.LATIN_DIGITS * 2)
    more = "".join(x for x in map(chr, folds) if x not in source)
    gone = "".join(chr(k) for k in range(0x300, 0x700) if re.match(MARKS, chr(k)) and chr(k) not in source)
    return source + more + gone, (target + more).translate(folds), other


def without_marks(c: Column) -> Column:
    """A text taken apart by NFD, without MARKS. Texts of one-to-one letters stay in the JVM; ASCII texts are left alone."""
    source, target, other = _folding()
    hard = _holds(c, other)
    whole = F.regexp_replace(nfd(F.when(hard, c)), MARKS, "")
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(hard, whole).otherwise(F.regexp_replace(F.translate(c, source, target), MARKS, ""))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def nfd(c: Column) -> Column:
    return _form("NFD")(c)


def nfc(c: Column) -> Column:
    return _form("NFC")(c)


def nfkd(c: Column) -> Column:
    return _form("NFKD")(c)


def fold_digits(c: Column) -> Column:
    """Persian and Arabic-Indic digits to 0-9."""
    folded = F.translate(c, lang.PERSIAN_DIGITS + lang.ARABIC_DIGITS, lang.LATIN_DIGITS * 2)
    return F.when(c.rlike(r"[\x{660}-\x{6f9}]"), folded).otherwise(c)


def localize_digits(c: Column, language: str) -> Column:
    digits = {"fa": lang.PERSIAN_DIGITS, "ar": lang.ARABIC_DIGITS}.get(language)
    return F.translate(fold_digits(c), lang.LATIN_DIGITS, digits) if digits else fold_digits(c)


# What stands between words: white space and the zero-width non-joiner.
GAP = "[‌\\s ]"


def _search_letters(c: Column) -> Column:
    """A text without marks, in folded letters and digits and lower case, with Persian affixes joined; its spaces are as they were."""
    source, target, other = _search_folding()
    hard = _holds(c, other)
    whole = fold_digits(F.translate(F.regexp_replace(nfd(F.when(hard, c)), MARKS, ""), lang.FOLD_FROM, lang.FOLD_TO))
    x = F.lower(F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(hard, whole).otherwise(F.translate(c, source, target)))
    # What stands before the rules is worked out once; they are tried only on texts with letters of theirs.
    plural = lambda y: F.when(y.contains("ها") | y.contains("تر"), F.regexp_replace(y, f"(?<=[؀-ۿ]){GAP}+(?=(?:هایی|های|ها|ترین|تر)(?!\\p{{L}}))", "")).otherwise(y)
    prefix = lambda y: F.when(y.contains("می"), F.regexp_replace(y, f"(?<=(?<!\\p{{L}})(?:نمی|می)){GAP}+", "")).otherwise(y)
    return bind(bind(x, plural), prefix)


def normalize_for_search(c: Column) -> Column:
    """One form for all spellings of a text: no marks, folded letters and digits, lower case, joined affixes, single spaces."""
    return F.trim(F.regexp_replace(_search_letters(c), f"{GAP}+", " "))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) > 1)


def keywords(c: Column) -> Column:
    """Search words of a text: normalised, longer than one letter, no stop words. Gaps split words, single or not."""
    return F.filter(words_of(_search_letters(c)), lambda w: ~w.isin(*lang.SEARCH_STOP))


REFERENCE = r"\[\^([^\]\s]+)\]|\[\[(?:fig|tab):([^\]\s]+)\]\]"
URL = r"https?://[^\s<>\"'\]\)]*[^\s<>\"'\]\).,;:!?]"


def strip_markup(c: Column) -> Column:
    """Plain text: footnote and figure references go, emphasis and code marks go, escaped marks stay as characters."""
    # Texts that hold none of the signs below are plain as they are.
    signs = [c.contains(sign) for sign in ("*", "`", "[", "\u0002", "\u0003")]
    return F.when(functools.reduce(Column.__or__, signs), _without_signs(c)).otherwise(c)


def _without_signs(c: Column) -> Column:
    x = F.regexp_replace(c, r"\\([*`])", "\u0001$1")
    x = F.regexp_replace(x, "\u0001\\*", "\u0002")
    x = F.regexp_replace(x, "\u0001`", "\u0003")
    x = F.regexp_replace(x, r"`([^`]+)`", "$1")
    x = F.regexp_replace(x, REFERENCE, "")
    x = F.regexp_replace(x, r"\*\*(?!\s)(.+?)(?<!\s)\*\*", "$1")
    x = F.regexp_replace(x, r"\*(?![\s*])([^*]+?)(?<!\s)\*", "$1")
    return F.translate(x, "\u0002\u0003", "*`")


def markup_tokens(c: Column) -> Column:
    """Code spans, footnote and figure references and URLs as kind:value strings, with multiplicity."""
    every = lambda pattern, prefix, group, of=c: F.transform(F.regexp_extract_all(of, F.lit(pattern), F.lit(group)), lambda v: F.concat(F.lit(prefix), v))
    prose = F.regexp_replace(c, r"`[^`]+`", " ")
    return F.concat(
        every(r"`([^`]+)`", "code:", 1),
        every(r"\[\^([^\]\s]+)\]", "fn:", 1, prose),
        F.transform(F.regexp_extract_all(prose, F.lit(r"\[\[((?:fig|tab):[^\]\s]+)\]\]"), F.lit(1)), lambda v: v),
        every(URL, "url:", 0, prose),
    )


def clean_run_text(c: Column) -> Column:
    """Composed letters, ligatures opened, soft hyphens and zero-width characters removed, odd spaces made plain."""
    x = nfc(c)
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "[­​⁠﻿]", "")
    return F.regexp_replace(x, "[  -   　]", " ")


def header_pattern(c: Column) -> Column:
    """A running line's shape: lower case, digits and roman numbers as #, single spaces; words are of ASCII letters."""
    x = F.regexp_replace(F.lower(c), r"[0-9]+", "#")
    x = F.regexp_replace(x, r"(?<![A-Za-z0-9_])[ivxlcdm]{1,7}(?![A-Za-z0-9_])", "#")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_title(c: Column) -> Column:
    x = F.lower(F.regexp_replace(nfkd(c), r"\p{M}", ""))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def strip_title_number(c: Column) -> Column:
    """A normalised title without a leading chapter word or number."""
    return F.trim(F.regexp_replace(c, r"^(?:(?:chapter|part|section|appendix)\s+)?(?:[0-9]+(?:\s[0-9]+)*|[ivxlc]+)\s+", ""))


def bigrams(c: Column) -> Column:
    """Two-character runs of a text, with multiplicity."""
    n = F.char_length(c)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Sentences of a text, each with its end marks: split after them, and closing quotes, before white space; at newlines too."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?…؟][»\"”’')\]]{0,3})\s+|\n+", -1), lambda x: F.trim(x)), lambda x: x != "")


# Character classes of the Unicode sentence boundary rules (UAX 29); Greek alone adds to them.
FULL_STOPS = r".\u2024\uFE52\uFF0E"
SENTENCE_ENDS = r"!?\u0589\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0964\u0965\u104A\u104B\u1362\u1367\u1368\u166E\u1803\u1809\u203C\u203D\u2047-\u2049\u2E2E\u2E3C\u3002\uFE56\uFE57\uFF01\uFF1F\uFF61"
SENTENCE_GOES_ON = r",\-:;\u055D\u060C\u060D\u07F8\u1802\u1808\u2013\u2014\u3001\uFE10\uFE11\uFE13\uFE31\uFE32\uFE50\uFE51\uFE55\uFE58\uFE63\uFF0C\uFF0D\uFF1A\uFF64"
LOCAL_ENDS = {"el": ";\u037E"}
PARAGRAPH_ENDS = r"\r\n\u0085\u2028\u2029"


def sentence_segments(c: Column, language: str = "en") -> Column:
    """Trimmed sentences of a text by the Unicode sentence boundary rules, with the language's own end marks; blank ones left out.

    A sentence ends after an end mark with its closing quotes, brackets and spaces, and at paragraph ends. A full stop ends
    none before a digit (3.5), between letters before a capital (U.S.A), or where the next letter is a small one (approx. five);
    no mark ends one before a comma, colon, dash or another mark. Marks that combine with letters do not count as characters
    between, other than in the rules.
    """
    ends = SENTENCE_ENDS + LOCAL_ENDS.get(language, "")
    on = SENTENCE_GOES_ON.replace(";", "") if ";" in LOCAL_ENDS.get(language, "") else SENTENCE_GOES_ON
    marks, close, space = FULL_STOPS + ends, r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"']*+", r"[\p{Zs}\t\x0B\x0C]*+"
    after = rf"(?![{on}{marks}])"
    stop = rf"[{FULL_STOPS}](?!\p{{Nd}})(?!(?<=[\p{{Lu}}\p{{Lt}}\p{{Ll}}].)[\p{{Lu}}\p{{Lt}}]){close}{space}{after}(?![^\p{{L}}{PARAGRAPH_ENDS}{marks}]*+\p{{Ll}})"
    broken = F.regexp_replace(c, rf"((?:{stop})|[{ends}]{close}{space}{after}|\r\n|[{PARAGRAPH_ENDS}])", "$1\u0001")
    return F.filter(F.transform(F.split(broken, "\u0001", -1), lambda x: F.regexp_replace(x, r"^[\p{Z}\s\x{85}\x{feff}]+|[\p{Z}\s\x{85}\x{feff}]+$", "")), lambda x: x != "")


def text_direction(c: Column, fallback: str = "ltr") -> Column:
    first = F.regexp_extract(c, r"[\p{L}]", 0)
    return F.when(first == "", fallback).when(first.rlike(r"[\p{IsArabic}\p{IsHebrew}]"), "rtl").otherwise("ltr")


def leftover_characters(c: Column, language: str) -> Column:
    """Codes of characters that a text of the language should not hold, outside code and URLs."""
    if language != "fa":
        return F.array().cast("array<string>")
    prose = F.regexp_replace(F.regexp_replace(c, r"`[^`]+`", " "), URL, " ")
    return F.array_compact(F.array(F.when(c.rlike("[يك]"), "leftover_chars"), F.when(prose.rlike('[,;?"]'), "latin_punctuation")))


# What stands at an edge of a word and is no part of it. A line separator at a word's end does not hide the marks before it.
WORD_EDGES = r"(?=[\p{P}\p{S}])(?:(?<![^\s\x{200c}])[\p{P}\p{S}]++|(?<![\p{P}\p{S}])[\p{P}\p{S}]++(?=[\x{85}\x{2028}\x{2029}]?(?:[\s\x{200c}]|\z)))"
SAID_AGAIN = r" ([^ ]++(?: [^ ]++){0,5}?) \1 \1(?![^ ])"


def repeated_phrase(c: Column) -> Column:
    """The first phrase said back to back, one word four times or two to six words three times: shortest, then earliest; else null.

    Words are in lower case and without marks at their edges. A phrase of n words repeats where words equal those n places
    on, over a run of n (times - 1) places: in texts where a pattern finds some phrase, places are written as signs of a
    string, and the run is looked for in it.
    """

    def first(w: Column) -> Column:
        def phrase(n: int) -> Column:
            same = F.array_join(F.zip_with(w, F.slice(w, F.lit(n + 1), F.size(w)), lambda a, b: F.when(a == b, "1").otherwise("0")), "")
            return bind(F.instr(same, F.lit("1" * max(3, 2 * n))), lambda at: F.when(at > 0, F.array_join(F.slice(w, at, F.lit(n)), " ")))

        return F.coalesce(*map(phrase, range(1, 7)))

    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), WORD_EDGES, ""), "[\\s\u200c]+", " "))
    return bind(plain, lambda x: F.when(F.concat(F.lit(" "), x).rlike(SAID_AGAIN), bind(F.split(x, " "), first)))


def lacks_some(need: Column, have: Column) -> Column:
    """Whether an array needs a value more often than the other has it; the two meet in one sorted pass."""
    side = lambda c, k: F.transform(c, lambda v: F.struct(v.alias("v"), F.lit(k).alias("need")))
    full = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("left"), F.lit(False).alias("lacks"))

    def step(a: Column, x: Column) -> Column:
        # Of one value those that are there come first.
        left = F.when(a["v"] == x["v"], a["left"]).otherwise(0) + F.when(x["need"] == 0, 1).otherwise(-1)
        return F.struct(x["v"].alias("v"), left.alias("left"), (a["lacks"] | (left < 0)).alias("lacks"))

    merged = lambda n, h: F.aggregate(F.sort_array(F.concat(side(h, 0), side(n, 1))), start, step, lambda a: a["lacks"])
    return bind(full(need), lambda n: F.when(F.size(n) == 0, False).otherwise(bind(full(have), lambda h: F.when(n == h, False).otherwise(merged(n, h)))))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\s*(?:[,;&]|\band\b)\s*"), lambda x: F.trim(x)), lambda a: a != "")


def font_flags(c: Column) -> tuple[Column, Column, Column]:
    """Bold, italic and monospace by font name."""
    name = F.lower(c)
    return name.rlike("bold|black|heavy|semibold|demi"), name.rlike("italic|oblique"), name.rlike("mono|courier|consol|typewriter|code")


def extract_json(c: Column, schema: str) -> Column:
    """The first braces-to-braces part of a free answer, parsed; null when there is none or it is broken."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def contains_ranges(c: Column, query: Column) -> Column:
    """Start and end (exclusive, from 0) of every occurrence of a lower-case query, without overlaps."""
    parts = F.transform(F.split(F.lower(c), F.concat(F.lit("\\Q"), query, F.lit("\\E")), -1), F.char_length)
    n = F.char_length(query)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a, size):
        s = a["at"] + size
        return F.struct((s + n).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), (s + n).alias("end")))).alias("out"))

    # Every part but the last is followed by a hit.
    return F.aggregate(parts, start, step, lambda a: F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1))


def escape_html(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")


def markup_to_html(c: Column) -> Column:
    """Escaped static HTML of inline markup."""
    x = F.regexp_replace(escape_html(c), r"`([^`]+)`", "<code>$1</code>")
    x = F.regexp_replace(x, r"\*\*(?!\s)(.+?)(?<!\s)\*\*", "<strong>$1</strong>")
    x = F.regexp_replace(x, r"\*(?![\s*])([^*]+?)(?<!\s)\*", "<em>$1</em>")
    x = F.regexp_replace(x, r"\[\^([^\]\s]+)\]", "<sup>$1</sup>")
    return F.regexp_replace(x, r"\[\[(fig|tab):([^\]\s]+)\]\]", "<span>$1 $2</span>")
