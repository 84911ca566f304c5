"""Numbers in words, from a lexicon relation (lang, value, words) of at most ten thousand rows a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text

# A chapter and verses in digits, the signs between verses, and what is said for them.
CHAPTER_VERSE = r"(\d+)\s*([:：.．])\s*(\d+(?:\s*[-–—~～,，、]\s*\d+)*)"
RANGE, LIST = r"\s*[-–—~～]\s*", r"\s*[,，、]\s*"
PSALMS = ("詩篇", "诗篇")
OCLOCK = "बजे"
HE_MONTHS = "ינואר פברואר מרץ אפריל מאי יוני יולי אוגוסט ספטמבר אוקטובר נובמבר דצמבר".split()
HE_DATE = r"(?<![א-ת])ל-(\d{1,2})(?=\s+ב(?:" + "|".join(HE_MONTHS) + "))"
HE_ARTICLE = ("האיגרת", "הבשורה")


def number_lexicon(spark: SparkSession, lang: str) -> DataFrame:
    """lang, value, words of 0 to 9999 in zh or hi; rows of other languages are the user's."""
    v = spark.range(rules.LARGEST_NUMBER + 1).withColumnRenamed("id", "value")
    place = lambda n: F.floor(F.col("value") / n) % 10
    if lang == "zh":
        digit = lambda n: F.substring(F.lit(rules.ZH_DIGITS), (place(n) + 1).cast("int"), F.lit(1))
        units = [F.when(place(n) == 0, "零").otherwise(F.concat(digit(n), F.lit(u))) for n, u in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))]
        words = F.regexp_replace(F.regexp_replace(F.concat(*units), "零+", "零"), "^零|零$", "")
        words = F.when(F.col("value") == 0, "零").otherwise(F.regexp_replace(words, "^一十", "十"))
    elif lang == "hi":
        under = lambda c: F.element_at(F.array(*[F.lit(w) for w in rules.HI_UNDER_100]), (c + 1).cast("int"))
        rest = F.col("value") % 100
        parts = [
            F.when(F.col("value") >= 1000, F.concat(under(place(1000)), F.lit(" " + rules.HI_THOUSAND))),
            F.when(place(100) > 0, F.concat(under(place(100)), F.lit(" " + rules.HI_HUNDRED))),
            F.when((rest > 0) | (F.col("value") == 0), under(rest)),
        ]
        words = F.concat_ws(" ", *parts)
    else:
        raise ValueError(f"no number words for {lang}")
    return v.select(F.lit(lang).alias("lang"), "value", words.alias("words"))


def spell_numbers(df: DataFrame, lexicon: DataFrame, key: str = "id", col: str = "text", lang: str = "lang") -> DataFrame:
    """key, text, changed: each run of digits in its language's words. Larger numbers, and languages that the lexicon
    lacks, stay; so do null texts. Keys are unique. Texts without a digit skip the exchange."""
    has = F.coalesce(F.col(col).rlike("[0-9]"), F.lit(False))
    plain = df.where(~has).select(key, F.col(col).alias("text"), F.lit(False).alias("changed"))
    runs = df.where(has).select(key, F.col(lang).alias("lang"), F.posexplode(F.regexp_extract_all(col, F.lit("[0-9]+|[^0-9]+"), F.lit(0))).alias("_at", "_run"))
    said = runs.withColumn("value", F.col("_run").try_cast("long")).join(lexicon, ["lang", "value"], "left")
    joined = said.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.when(F.col("_run").rlike("^[0-9]"), F.col("words")), "_run").alias("w")))), lambda x: x["w"]), "").alias("text"), (F.count("words") > 0).alias("changed"))
    return joined.unionByName(plain)


def _around(col: Column, pattern: str) -> Column:
    """The text cut around matches: odd places are the matches."""
    return F.split(F.regexp_replace(col, pattern, text.MARK + "$0" + text.MARK), text.MARK, -1)


def speak_citations(df: DataFrame, lang: str, books: list[str], masculine: dict[int, str] | None = None, col: str = "text") -> DataFrame:
    """df with said: chapter and verse after a book's name (books: those of `lang`, some hundred at most, known at plan
    time) as a reader says them; numbers stay digits for spell_numbers to spell.

    zh, he, ar and hi have a wording; ranges of verses stay as they are but in zh. Hindi takes a colon without a name
    too, unless it is a time of day. Hebrew says these numbers, and days of months, in `masculine` words (value to
    words); a citation or date with a number that they lack stays. Null texts stay null.
    """
    if lang not in ("zh", "he", "ar", "hi"):
        return df.withColumn("said", F.col(col))
    names = [*books, *(b[1:] for b in books if lang == "he" and b.startswith(HE_ARTICLE))]
    after = lambda p, of: F.coalesce(p.rlike("(?:" + "|".join(rf"\Q{n}\E" for n in of) + r")\s*$"), F.lit(False)) if of else F.lit(False)
    words = F.create_map(*[F.lit(x) for k, w in (masculine or {}).items() for x in (k, w)]) if masculine else F.expr("cast(map() as map<int,string>)")
    he = lambda n: F.try_element_at(words, n.try_cast("int"))
    t = F.col(col)
    if lang == "he":
        day = lambda p: F.regexp_extract(p, r"(\d+)", 1)
        date = lambda p: F.coalesce(F.when(day(p).try_cast("int") == 1, "לראשון").otherwise(F.concat(F.lit("ל"), he(day(p)))), p)
        t = F.array_join(F.transform(_around(t, HE_DATE), lambda p, i: F.when(i % 2 == 1, date(p)).otherwise(p)), "")

    def say(before, p, behind):
        chapter, sign, verses = (F.regexp_extract(p, CHAPTER_VERSE, k) for k in (1, 2, 3))
        each, named = F.split(verses, LIST), after(before, names)
        n, ranged = F.size(each), verses.rlike("[-–—~～]")
        if lang == "zh":
            unit = F.when(after(before, list(PSALMS)), "篇").otherwise("章")
            joined = F.regexp_replace(F.regexp_replace(verses, RANGE, "至"), LIST, "和第")
            return F.when(named, F.concat(F.lit("第"), chapter, unit, F.lit("第"), joined, F.lit("节"))).otherwise(p)
        if lang == "ar":
            lead = F.when(n == 1, "الآية ").when(n == 2, "الآيتان ").otherwise("الآيات ")
            return F.when(named & ~ranged, F.concat(F.lit("، الإصحاح "), chapter, F.lit("، "), lead, F.array_join(each, " و"))).otherwise(p)
        if lang == "hi":
            counts = named | sign.isin(":", "：")
            clock = F.coalesce(behind.rlike(rf"^\s*{OCLOCK}"), F.lit(False))
            return F.when(counts & ~ranged & ~clock, F.concat(F.lit("अध्याय "), chapter, F.lit(", वचन "), F.array_join(each, " और "))).otherwise(p)
        spelled = F.transform(each, he)
        many = F.concat(F.lit("פסוקים "), F.array_join(F.slice(spelled, F.lit(1), n - 1), " "), F.lit(" ו"), F.element_at(spelled, F.lit(-1)))
        known = he(chapter).isNotNull() & ~F.exists(spelled, lambda w: w.isNull())
        return F.when(named & ~ranged & known, F.concat(F.lit(", פרק "), he(chapter), F.lit(", "), F.when(n == 1, F.concat(F.lit("פסוק "), F.get(spelled, F.lit(0)))).otherwise(many))).otherwise(p)

    cut = df.withColumn("_p", _around(t, CHAPTER_VERSE))
    said = F.array_join(F.transform("_p", lambda p, i: F.when(i % 2 == 1, say(F.get("_p", i - 1), p, F.get("_p", i + 1))).otherwise(p)), "")
    for mark in {"he": [", פרק "], "ar": ["، الإصحاح "]}.get(lang, []):
        said = F.regexp_replace(said, r"\s+" + mark, mark)
    return cut.withColumn("said", said).drop("_p")
