"""Persian orthography: ~ stands for the zero-width non-joiner."""

import pytest
from pyspark.sql import functions as F

from vellumspark.functions.persian import normalize_persian

PLAIN = [
    ("كتاب", "کتاب"), ("يك روز", "یک روز"), ("موسى و عيسى", "موسی و عیسی"), ("بـــزرگ", "بزرگ"), ("ﻛﺘﺎﺏ", "کتاب"), ("  فاصله~های   اضافه  ", "فاصله~های اضافه"),
    ("کتاب~~ها", "کتاب~ها"), ("کتاب~ ها", "کتاب~ها"), ("کتاب ~ها", "کتاب~ها"), ("~کتاب", "کتاب"), ("کتاب~، دفتر", "کتاب، دفتر"), ("«~کتاب»", "«کتاب»"),
    ("این روش کار می کند.", "این روش کار می~کند."), ("نمی توان گفت.", "نمی~توان گفت."), ("میشود", "می~شود"), ("نمیدانست", "نمی~دانست"), ("میدان شهر", "میدان شهر"), ("میدانی بزرگ", "میدانی بزرگ"), ("ماه می امسال", "ماه می امسال"),
    ("کتاب های تازه", "کتاب~های تازه"), ("ایده هایمان", "ایده~هایمان"), ("آنها", "آن~ها"), ("تنها راه", "تنها راه"), ("ساده ترین روش", "ساده~ترین روش"), ("بزرگ تر از", "بزرگ~تر از"), ("خاک تر بود", "خاک تر بود"), ("Python ها", "Python ها"),
    ("ایده ی اصلی", "ایده~ی اصلی"), ("ایدهٔ اصلی", "ایده~ی اصلی"), ("ایدۀ اصلی", "ایده~ی اصلی"),
    ("کتاب, دفتر و قلم", "کتاب، دفتر و قلم"), ("اول; دوم", "اول؛ دوم"), ("چرا این کار را کردیم?", "چرا این کار را کردیم؟"), ('او گفت "سلام" و رفت.', "او گفت «سلام» و رفت."), ('او گفت "سلام و رفت.', 'او گفت "سلام و رفت.'),
    ("کتاب،دفتر", "کتاب، دفتر"), ("پایان.آغاز", "پایان. آغاز"), ("« متن »", "«متن»"), ("متن(توضیح)", "متن (توضیح)"), ("«نقل»قول", "«نقل» قول"), ("واقعاً؟!", "واقعاً؟!"),
    ("در سال 1950", "در سال ۱۹۵۰"), ("3.5 درصد", "۳٫۵ درصد"), ("1,200 صفحه", "۱٬۲۰۰ صفحه"), ("2,500,000 نفر", "۲٬۵۰۰٬۰۰۰ نفر"), ("50 %", "۵۰٪"), ("شکل 3.1 نشان می~دهد", "شکل ۳.۱ نشان می~دهد"), ("1950s", "1950s"), ("Python 3.11 را نصب کنید", "Python 3.11 را نصب کنید"),
    ('تابع `print("a, b")` را ببینید', 'تابع `print("a, b")` را ببینید'), ("به https://example.org/page. سر بزنید", "به https://example.org/page. سر بزنید"), ("انتزاع (Abstraction) مهم است", "انتزاع (Abstraction) مهم است"), ("زبان~های C++ و C# و Java", "زبان~های C++ و C# و Java"),
    ("متن[^1] ادامه", "متن[^1] ادامه"), ("(پانویس)[^2] ادامه", "(پانویس)[^2] ادامه"), ("در [[fig:3.1]] آمده", "در [[fig:3.1]] آمده"), ('گفت: "Hello world"', "گفت: «Hello world»"), ("خط اول  \n  خط دوم", "خط اول\nخط دوم"),
]
OTHER = [
    (dict(ezafe="hamza"), "ایده ی اصلی", "ایدهٔ اصلی"), (dict(ezafe="hamza"), "خانه~ای کوچک", "خانه~ای کوچک"), (dict(segment_type="heading"), "1.2 اهرم~ها", "۱.۲ اهرم~ها"), (dict(digits="latin"), "۲۵ میلیون و ۳٫۵ درصد", "25 میلیون و 3.5 درصد"),
    (dict(digits="latin"), "۱٬۲۰۰ صفحه", "1,200 صفحه"), (dict(segment_type="code"), 'print(i, "done?")', 'print(i, "done?")'),
]
J = "‌"


def run(spark, texts, **options):
    rows = spark.createDataFrame([(k, t.replace("~", J)) for k, t in enumerate(texts)], "k int, t string")
    once = rows.select("k", normalize_persian(F.col("t"), **options).alias("t"))
    twice = once.select("k", normalize_persian(F.col("t"), **options).alias("t"))
    return [r.t.replace(J, "~") for r in once.orderBy("k").collect()], [r.t.replace(J, "~") for r in twice.orderBy("k").collect()]


def test_no_run_is_too_long(spark):
    latin = "word, " * 2999 + "word"
    text = f"متن {latin} متن, و 1,200,300,400,500,600,700,800,900 تا"
    once, twice = run(spark, [text])
    assert once == [f"متن {latin} متن، و ۱٬۲۰۰٬۳۰۰٬۴۰۰٬۵۰۰٬۶۰۰٬۷۰۰٬۸۰۰٬۹۰۰ تا"] and twice == once


def test_rules_and_second_pass(spark):
    once, twice = run(spark, [a for a, _ in PLAIN])
    assert [(a, g) for (a, w), g in zip(PLAIN, once) if g != w] == []
    assert twice == once


@pytest.mark.parametrize("options,text,want", OTHER)
def test_options(spark, options, text, want):
    assert run(spark, [text], **options)[0] == [want]
