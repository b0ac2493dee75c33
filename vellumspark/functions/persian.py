"""Persian orthography as one column expression: characters, joiners, ezafe, digits, punctuation.

Code, URLs, references and Latin runs are taken out first and put back in order, so no rule sees them.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellumspark.functions import lang
from vellumspark.functions import text as T

J = "‌"
# Verb stems and endings that take the prefix, plural suffixes, words that a figure number follows.
PRESENT = "شو کن توان ده گیر رو آی بین دان گوی گو خواه ساز مان یاب رس گرد دار نویس خوان پرداز کوش بخش آموز شناس سنج گذار گذر پذیر افت آور بر زن کش نگر".split()
PRESENT_ENDS = "م ی د یم ید ند".split()
PAST = "شد کرد توانست داد گرفت رفت آمد دید دانست گفت خواست ساخت یافت رسید داشت نوشت خواند پرداخت کوشید آموخت شناخت آورد برد زد کشید نگریست".split()
PAST_ENDS = "م ی یم ید ند".split()
PLURALS = "هایشان هایتان هایمان هایش هایت هایم هایی های ها".split()
LABELS = "شکل جدول فصل بخش بند نمودار تصویر معادله پیوست صفحه قسمت".split()
LETTER = "[ء-غف-يپچژکگیۀ]"
AFTER, BEFORE = r"(?![\p{L}\p{M}])", rf"(?<![\p{{L}}\p{{M}}{J}])"
HELD, NOTE = "\ue000", "\uf000"
WORD = rf"[\p{{L}}\p{{M}}{HELD}]"
# Possessive, so that Latin texts of any length neither backtrack nor nest deeply.
LATIN = r"(?=[0-9]*+\p{IsLatin})[\p{IsLatin}0-9]++(?:['’.\-][\p{IsLatin}0-9]++)*+"
RUN = rf"{LATIN}(?:[ ,.:/&+\-]++(?:{LATIN}|[0-9]++(?:[.,][0-9]++)*+))*+[+#]*"
FOOTNOTE = r"\[\^[A-Za-z0-9_-]+\]"
PROTECTED = rf"`[^`\n]+`|{FOOTNOTE}|\[\[(?:fig|tab):[^\]\s]+\]\]|https?://[^\s<>«»\"]*[^\s<>«»\".,;:!?)”’؟،؛]|{RUN}"
PRESENTATION = re.compile("[ﭐ-﷿ﹰ-﻿]")


@F.pandas_udf(StringType())
def _plain_forms(s: pd.Series) -> pd.Series:
    """Presentation forms to plain letters; Spark has no compatibility normalisation."""
    return s.map(lambda x: None if x is None else PRESENTATION.sub(lambda m: unicodedata.normalize("NFKC", m[0]), x))


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def _rules(ezafe: str, digits: str, segment_type: str) -> list[tuple[str, str]]:
    verb = f"(?:{'|'.join(PRESENT)})(?:{'|'.join(PRESENT_ENDS)})|(?:{'|'.join(PAST)})(?:{'|'.join(PAST_ENDS)})?"
    out = [
        ("[يى]", "ی"), ("ك", "ک"), ("ە", "ه"), ("ـ", ""), ("ۀ", "هٔ"),
        (f"{J}{{2,}}", J), (f" +{J}+ *| *{J}+ +", " "), (rf"{J}+(?=[\p{{P}}\p{{S}}\n]|$)", ""), (rf"(^|[\p{{P}}\p{{S}}\n]){J}+", "$1"),
        (rf"{BEFORE}(?!میدانی{AFTER})(ن?می)({verb}){AFTER}", f"$1{J}$2"), (rf"(?<!ماه ){BEFORE}(ن?می) +(?={LETTER})", f"$1{J}"),
        (rf"({LETTER}) +({'|'.join(PLURALS)}){AFTER}", f"$1{J}$2"), (rf"({LETTER}) +(ترین){AFTER}", f"$1{J}$2"), (rf"({LETTER}) +(تر)(?= از{AFTER})", f"$1{J}$2"),
        (rf"{BEFORE}(آن|این)ها{AFTER}", f"$1{J}ها"),
    ]
    if ezafe == "yeh":
        out += [("هٔ", f"ه{J}ی"), (rf"ه +ی{AFTER}", f"ه{J}ی")]
    else:
        out += [(rf"ه(?:{J}| +)ی{AFTER}", "هٔ")]
    if digits != "latin":
        out += [(r"(\G(?!^)\d{3}|(?<![\d.,٫٬])\d{1,3}),(?=\d{3}(?:,\d{3})*+(?!\d|[.,]\d))", "$1٬")]
        if segment_type not in ("heading", "caption"):
            out += [(rf"(?<![\d.])(?<!(?:{'|'.join(LABELS)})[ {J}]{{0,3}})(\d+)\.(\d+)(?![.\d])", "$1٫$2")]
        out += [(r"(\d)\s?%", "$1٪")]
    return out


def _punctuation() -> list[tuple[str, str]]:
    return [
        (r"(?<!\d),|,(?!\d)", "،"), (";", "؛"), (r"\?", "؟"),
        (r" +(?=[،؛؟!.:»)\]])", ""), (r"([«(\[]) +", "$1"), (rf"([،؛؟!])(?={WORD}|[«(*])", "$1 "), (rf"([.:])(?={LETTER})", "$1 "), (rf"([»)])(?={WORD})", "$1 "), (rf"({WORD})(?=[«(])", "$1 "), (" {2,}", " "),
    ]


def _paired_quotes(c: Column) -> Column:
    """Straight double quotes as guillemets when their number is even."""
    mark = lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "«").otherwise("»"), p)
    return T.bind(F.split(c, '"', -1), lambda parts: F.when(F.size(parts) % 2 == 1, F.array_join(F.transform(parts, mark), "")).otherwise(F.array_join(parts, '"')))


def normalize_persian(c: Column, ezafe: str = "yeh", digits: str = "native", segment_type: str = "paragraph") -> Column:
    """The text in Persian orthography; a second pass changes nothing. Code segments stay as they are.

    ezafe after silent heh is written with yeh or hamza; digits are native or latin; headings and captions keep dotted
    numbers. Null stays null.
    """
    if segment_type == "code":
        return c
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \t  -  　]+", " ")))
    clean = F.trim(F.array_join(lines, "\n"))
    kept = F.regexp_extract_all(clean, F.lit(PROTECTED), F.lit(0))
    place = lambda p, k: F.concat(F.coalesce(p, F.lit("")), F.when(k.isNull(), "").when(k.startswith("[^"), NOTE).otherwise(HELD))
    masked = F.array_join(F.zip_with(F.split(clean, PROTECTED, -1), kept, place), "")
    s = _chain(_plain_forms(masked), _rules(ezafe, digits, segment_type)[:9])
    s = T.fold_digits(_chain(s, _rules(ezafe, digits, segment_type)[9:15]))
    s = _chain(s, _rules(ezafe, digits, segment_type)[15:])
    s = F.translate(s, "٬٫", ",.") if digits == "latin" else F.translate(s, lang.LATIN_DIGITS, lang.PERSIAN_DIGITS)
    s = _chain(s, _punctuation()[:3])
    s = _chain(_paired_quotes(s), _punctuation()[3:])
    pieces = F.split(s, f"[{HELD}{NOTE}]", -1)
    return F.array_join(F.zip_with(pieces, kept, lambda p, k: F.concat(F.coalesce(p, F.lit("")), F.coalesce(k, F.lit("")))), "")
