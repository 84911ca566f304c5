"""Lines that open a reading in fixed words, rendered from a table and never by a model: a dated title, the series' name
before it, and the announcement that the text is read again.

Everything is an expression over one row; the tables have a dozen entries and are known at plan time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The lines by target language, their stop when alone and what stands before the rest.
TITLES = {"zh": "{month}月{day}日的吗哪", "he": "מן ל-{day} ב{month_name}", "ar": "المنّ ليوم {day} {month_name}"}
AGAINS = {"zh": "再读一遍经文", "he": "הטקסט שוב", "ar": "النص مجددًا"}
SERIES_NAMES = {"ar": "المنّ السماوي اليومي"}
ALONE = {"zh": "。", "he": ".", "ar": "."}
BEFORE_REST = {"zh": "：", "he": ": ", "ar": ": "}
# Months in order.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "he": "ינואר פברואר מרץ אפריל מאי יוני יולי אוגוסט ספטמבר אוקטובר נובמבר דצמבר".split(),
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر".split(),
}
# The lines as they are heard in English and Chinese.
TITLE = r"(?isU)^\s*Manna\s+for\s+(" + "|".join(MONTHS["en"]) + r")\s+([0-9]{1,2})(?:st|nd|rd|th)?\b\s*[.,:;!]?\s*(.*)$"
AGAIN = r"(?isU)^\s*(?:The\s+)?text\s+again\s*(?:[.,:;]\s*|$)(.*)$"
SERIES = r"(?isU)^((?:\s*Daily\s+Heavenly\s+Manna\s*(?:[.,:;!]\s*|$))+)"
ZH_NUMBER = r"[0-9]{1,2}|[一二三四五六七八九十]{1,3}"
ZH_TITLE = rf"(?sU)^\s*({ZH_NUMBER})\s*月\s*({ZH_NUMBER})\s*日的?\s*(?:[吗玛妈马][哪纳娜懒])\s*[。.,，:：;；!！]?\s*(.*)$"
ZH_AGAIN = r"(?sU)^\s*再[读讀度]一遍[经經]文\s*(?:[。.,，:：;；]\s*|$)(.*)$"
# The title's words in heard Arabic, folded, and the numbers of a day.
AR_MANNA, AR_DAY_WORD, AR_STOPS = "^المن[يو]?$", "^(?:ل|ال)يوم[ي]?$", ".,:;!،؛"
AR_FOLD = ("أإآةى", "اااهي")
AR_UNITS = {"واحد": 1, "احد": 1, "اثنان": 2, "اثنين": 2, "اثنا": 2, "اثني": 2, "ثلاثه": 3, "اربعه": 4, "خمسه": 5, "سته": 6, "سبعه": 7, "ثمانيه": 8, "تسعه": 9}
AR_TENS = {"عشره": 10, "عشرون": 20, "عشرين": 20, "ثلاثون": 30, "ثلاثين": 30}
AR_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _in(c: Column, low: int, high: int) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def _month(names: list[str], number: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in names]), number)


def _zh_number(c: Column) -> Column:
    """Of digits, or of up to three characters around a ten; 0 where it is no number."""
    digit = lambda x, other: F.when(F.length(x) == 1, F.coalesce(F.nullif(F.instr(F.lit("一二三四五六七八九"), x), F.lit(0)), F.lit(other))).otherwise(other)
    tens, ones = F.regexp_extract(c, "^(.*)十", 1), F.regexp_extract(c, "([^十]*)$", 1)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).when(F.contains(c, F.lit("十")), F.when(tens == "", 1).otherwise(digit(tens, 1)) * 10 + digit(ones, 0)).otherwise(digit(c, 0))


def _ar_day(words: Column) -> Column:
    """The day that one or two folded words say, else null."""
    bare = lambda w: F.when(w.startswith("ال") & (F.length(w) > 4), F.substr(w, F.lit(3))).otherwise(w)
    a, b = bare(F.get(words, F.lit(0))), bare(F.get(words, F.lit(1)))
    unit = F.try_element_at(_map(AR_UNITS), a)
    tens = F.try_element_at(_map(AR_TENS), F.regexp_replace(F.substr(b, F.lit(2)), "^ال", ""))
    one = F.coalesce(F.when(F.get(words, F.lit(0)).rlike("^[0-9]+$"), F.get(words, F.lit(0)).try_cast("int")), unit, F.try_element_at(_map(AR_TENS), a))
    two = F.when(b == "عشر", unit + 10).when(b.startswith("و") & (tens >= 20), unit + tens)
    return F.when(F.size(words) == 1, one).when(F.size(words) == 2, two)


def _template(values: dict[str, str], target: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), target)


def fixed_lines(df: DataFrame, source: str = "source", target: str = "target", col: str = "text") -> DataFrame:
    """df with rendered and rest: a fixed line at the head of a text in the target language, with the stop or colon that
    fits what follows, and the remainder, still to translate (empty if none).

    Both are null where a text opens with no such line, names a day that no month has, is null, or the pair of languages
    has no table (English to zh, he, ar; zh and ar to English; a null source is English). Series names may be said
    several times over before another line. Days are in ASCII digits, in Arabic in either kind.
    """
    said, to = F.coalesce(F.col(source), F.lit("en")), F.col(target)
    pair = F.when((said == "en") & to.isin(*TITLES), "en").when((to == "en") & said.isin("zh", "ar"), said)
    head = F.when((said == "en") & to.isin(*SERIES_NAMES), F.regexp_extract(col, SERIES, 1)).otherwise("")
    opened = F.struct(pair.alias("s"), F.col(col).alias("text"), to.alias("to"), head.alias("head"), F.when(said == "ar", text.words(F.col(col))).alias("words"))
    line = _let(opened, lambda x: _let(_cut(x), lambda y: _let(_parts(y), lambda z: _let(_numbers(z), _rendered))))
    return df.withColumn("_line", line).select(*df.columns, "_line.rendered", "_line.rest")


def _let(value: Column, fn) -> Column:
    """fn of a value that stands in the plan once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _grown(x: Column, names: str, **more: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in names.split()], *[c.alias(n) for n, c in more.items()])


def _cut(x: Column) -> Column:
    """The text without series names, and the first words folded."""
    fold = lambda w: F.btrim(F.translate(F.translate(F.regexp_replace(w, "[ً-ْـ]", ""), *AR_FOLD), *AR_DIGITS), F.lit(AR_STOPS))
    t = F.when(x["head"] == "", x["text"]).otherwise(_trim(F.substr(x["text"], F.length(x["head"]) + 1)))
    return _grown(x, "s to head words", t=t, w=F.transform(F.slice(x["words"], 1, 5), fold))


def _at(x: Column, k: int) -> Column:
    return F.coalesce(F.get(x["w"], F.lit(k)), F.lit(""))


def _parts(x: Column) -> Column:
    """Which line it is, and the month and day as they are written."""
    en, zh, ar = (x["s"] == lang for lang in ("en", "zh", "ar"))
    t = x["t"]
    title = F.when(en, t.rlike(TITLE)).when(zh, t.rlike(ZH_TITLE)).when(ar, _at(x, 0).rlike(AR_MANNA) & _at(x, 1).rlike(AR_DAY_WORD))
    again = F.when(en, t.rlike(AGAIN)).when(zh, t.rlike(ZH_AGAIN)).when(ar, (_at(x, 0) == "النص") & (_at(x, 1) == "مجددا"))
    part = lambda k: F.when(en, F.regexp_extract(t, TITLE, k)).when(zh, F.regexp_extract(t, ZH_TITLE, k))
    end = F.when(ar, F.when(F.try_element_at(_ar_months(), _at(x, 3)).isNotNull(), 3).when(F.try_element_at(_ar_months(), _at(x, 4)).isNotNull(), 4))
    return _grown(x, "s to head words t w", title=title, again=F.coalesce(again, F.lit(False)), m=part(1), d=part(2), tail=part(3), end=end)


def _ar_months() -> Column:
    return _map({m.translate(str.maketrans(*AR_FOLD)): k for k, m in enumerate(MONTHS["ar"], 1)})


def _numbers(x: Column) -> Column:
    """Month and day as numbers, and what follows the line."""
    en, zh, ar = (x["s"] == lang for lang in ("en", "zh", "ar"))
    month = F.when(en, F.try_element_at(_map({m.lower(): k for k, m in enumerate(MONTHS["en"], 1)}), F.lower(x["m"]))).when(zh, _zh_number(x["m"])).when(ar, F.try_element_at(_ar_months(), F.get(x["w"], x["end"])))
    day = F.when(en, x["d"].try_cast("int")).when(zh, _zh_number(x["d"])).when(ar, _ar_day(F.slice(x["w"], F.lit(3), x["end"] - 2)))
    skip = F.when(x["again"], F.lit(2)).otherwise(x["end"] + 1)
    rest = F.when(ar, F.array_join(F.slice(x["words"], skip + 1, F.size(x["words"])), " "))
    rest = rest.when(x["again"], _trim(F.when(en, F.regexp_extract(x["t"], AGAIN, 1)).otherwise(F.regexp_extract(x["t"], ZH_AGAIN, 1)))).otherwise(_trim(x["tail"]))
    return _grown(x, "to head t title again", month=month, day=day, rest=rest)


def _rendered(x: Column) -> Column:
    """The line in the target language, and what is still to translate."""
    to, alone = x["to"], x["rest"] == ""
    name = F.when(to == "en", _month(MONTHS["en"], x["month"])).when(to == "he", _month(MONTHS["he"], x["month"])).when(to == "ar", _month(MONTHS["ar"], x["month"])).otherwise("")
    words = _template(TITLES | {"en": "Manna for {month_name} {day}"}, to)
    for key, value in (("{month_name}", name), ("{month}", x["month"].cast("string")), ("{day}", x["day"].cast("string"))):
        words = F.replace(words, F.lit(key), value)
    titled = F.concat(words, F.when(alone, _template(ALONE | {"en": "."}, to)).otherwise(_template(BEFORE_REST | {"en": ". "}, to)))
    colon = _template(BEFORE_REST | {"en": ": "}, to)
    announced = F.concat(_template(AGAINS | {"en": "The text again"}, to), F.when(alone, F.rtrim(colon)).otherwise(colon))
    line = F.when(x["title"] & _in(x["month"], 1, 12) & _in(x["day"], 1, 31), titled).when(x["again"], announced)
    series = F.array_join(F.array_repeat(F.concat(_template(SERIES_NAMES, to), _template(ALONE, to)), F.regexp_count(x["head"], F.lit("(?i)Manna"))), " ")
    said = lambda v: F.concat(series, F.when(v.isNotNull(), F.concat(F.lit(" "), v)).when(x["t"] == "", "").otherwise(" "))
    both = lambda v: F.struct(F.when(x["head"] != "", said(v)).otherwise(v).alias("rendered"), F.when(v.isNotNull(), x["rest"]).when(x["head"] != "", x["t"]).alias("rest"))
    return _let(line, both)


def set_apart(df: DataFrame, source: str = "source", target: str = "target", col: str = "text") -> DataFrame:
    """df with opened (the rendered line, or null) and the text without it, for restoring.translate_segments(opened=...)."""
    cut = fixed_lines(df, source, target, col)
    return cut.withColumn(col, F.when(F.col("rendered").isNotNull(), F.col("rest")).otherwise(F.col(col))).withColumnRenamed("rendered", "opened").drop("rest")
