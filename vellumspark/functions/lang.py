"""Fixed language tables."""

# Words that carry no search meaning, English and Persian.
SEARCH_STOP = (
    "the a an and or of to in on is are was be it this that what why how for with as by at from we you can does do not its than".split()
    + "و در به از که این ان را با است برای یک چه چرا هم یا اما ما تو من می شود کند بخش یعنی چیست چیه توضیح بده برایم تکه".split()
)

# Words that neither start nor end an English term.
TERM_STOP = (
    "a about above after again against all almost also although always am among an and another any are around as at "
    "be because been before being below between both but by can cannot could did do does doing done down during each "
    "either else enough even ever every few first for from further get gets getting given gives go goes going got had "
    "has have having he her here hers herself him himself his how however i if in instead into is it its itself just "
    "last least less let like made make makes making many may me might more most much must my myself near need never "
    "new next no nor not now of off often on once one only onto or other others our ours ourselves out over own per "
    "perhaps quite rather really same second see seen several shall she should since so some something sometimes such "
    "than that the their theirs them themselves then there these they thing things this those though three through "
    "thus to too two under until up upon us use used uses using very via was way ways we well were what when where "
    "whether which while who whom whose why will with within without would yet you your yours yourself"
).split()

# Digits that stand for 0-9, and letters that search folds.
PERSIAN_DIGITS, ARABIC_DIGITS, LATIN_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
FOLD_FROM, FOLD_TO = "يىكةأإٱ", "ییکهااا"

# Script of a language, and its reading direction.
SCRIPTS = {"en": "IsLatin", "de": "IsLatin", "es": "IsLatin", "fr": "IsLatin", "ru": "IsCyrillic", "he": "IsHebrew", "ar": "IsArabic", "fa": "IsArabic"}

# Segment types that are translated, and their short codes.
TYPE_CODES = {"heading": "h", "paragraph": "p", "list_item": "li", "quote": "q", "caption": "cap", "footnote": "fn"}

# Statuses of a translation whose text a reader sees, and those that are done.
VISIBLE = ("drafted", "edited", "final", "flagged", "user_edited")
DONE = ("final", "user_edited")
