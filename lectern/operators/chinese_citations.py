"""Citations in Chinese: a book by the sound of the characters before it, chapter and verses in digits or characters.

The sounds of characters are a relation of the user (char, sound). Only the few characters before a chapter meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .labels import label_by_sound

# How numbers, chapters and verses are written, and what may stand between.
NUMBER = r"(?:\d{1,3}|[〇零一二两三四五六七八九十百]{1,5})"
GAP = r"[\s,，、》」]*"
VERSES = rf"{NUMBER}(?:\s*(?:节|節)?\s*(?:和|至|到|[-–、,，])\s*第?\s*{NUMBER})*"
REFERENCE = rf"([一-鿿]{{2,10}}?){GAP}第?\s*({NUMBER})\s*(?:[章张張篇]{GAP}|[:：,，]\s*)第?\s*({VERSES})\s*(?:节|節)?"
DIGITS = "零一二三四五六七八九"


def read_number(col: Column) -> Column:
    """12 of 十二 or 12; null for two digits in a row, which is a number that lost a character."""
    chars = F.split(F.translate(col, "〇两", "零二"), "")
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("digit"), F.lit(False).alias("bad"))

    def step(acc, c):
        value = F.position(c, F.lit(DIGITS)) - 1
        unit = F.when(c == "十", 10).when(c == "百", 100)
        return F.struct(
            F.when(unit.isNotNull(), acc["total"] + F.when(acc["digit"] < 0, 1).otherwise(acc["digit"]) * unit).otherwise(acc["total"]).alias("total"),
            F.when(unit.isNotNull(), -1).otherwise(value).alias("digit"),
            (acc["bad"] | (unit.isNull() & ((acc["digit"] >= 0) | (value < 0)))).alias("bad"),
        )

    said = F.aggregate(F.filter(chars, lambda c: c != ""), start, step, lambda a: F.when(~a["bad"], a["total"] + F.greatest(a["digit"], F.lit(0))))
    return F.when(col.rlike("^[0-9]+$"), col.try_cast("int")).otherwise(said)


def read_verses(col: Column) -> Column:
    """8,9 of 第八和第九, 10-12 of 十至十二; null if a number cannot be read."""
    parts = F.regexp_extract_all(col, F.lit(rf"{NUMBER}|至|到|[-–]|和|[、,，]"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("bad"))

    def step(acc, p):
        number = read_number(p)
        mark = F.when(p.rlike("^(至|到|[-–])$"), "-").when(p.rlike("^(和|[、,，])$"), ",")
        put = F.when(mark.isNull(), F.coalesce(number.cast("string"), F.lit(""))).when(acc["out"].rlike("[0-9]$"), mark).otherwise("")
        return F.struct(F.concat(acc["out"], put).alias("out"), (acc["bad"] | (mark.isNull() & number.isNull())).alias("bad"))

    return F.aggregate(parts, start, step, lambda a: F.when(~a["bad"], F.nullif(F.regexp_replace(a["out"], "^[,-]+|[,-]+$", ""), F.lit(""))))


def sounds_of(df: DataFrame, char_sounds: DataFrame, key: str, col: str) -> DataFrame:
    """key, sounds: a sound for each character of a text (its own name where the relation has none)."""
    chars = df.select(F.col(key), F.posexplode(F.filter(F.split(col, ""), lambda c: c != "")).alias("_place", "char"))
    own = char_sounds.groupBy("char").agg(F.min("sound").alias("sound"))
    said = chars.join(own, "char", "left").select(key, F.struct("_place", F.coalesce("sound", "char").alias("s")).alias("x"))
    return said.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("sounds"))


def chinese_citations(df: DataFrame, labels: DataFrame, char_sounds: DataFrame, key: str = "id", col: str = "text") -> DataFrame:
    """key, begin, end, reference (English book, chapter:verses) of the citations in Chinese texts.

    labels (book, label) are the Chinese names. Where what looks like a citation names no book, or has a number that cannot
    be read, the search goes on at the next character; citations don't overlap. A bracket that opens a title belongs to
    it. Null texts have none; keys are unique.
    """
    t = F.coalesce(F.col(col), F.lit(""))
    cut = df.where(t.rlike(REFERENCE)).select(key, t.alias("_t"), F.split(F.regexp_replace(t, f"(?={REFERENCE})", text.MARK), text.MARK, -1).alias("_p"))
    ends = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out")), lambda a, p: F.struct((a["n"] + F.length(p)).alias("n"), F.array_append(a["out"], a["n"] + F.length(p)).alias("out")), lambda a: a["out"])
    groups = f"(?s)^({REFERENCE}).*$", text.MARK.join(("$1", "$2", "$3", "$4"))

    def read(start):
        told = lambda g: F.struct(start.alias("start"), F.get(g, F.lit(0)).alias("whole"), F.get(g, F.lit(1)).alias("named"), read_number(F.get(g, F.lit(2))).alias("chapter"), read_verses(F.get(g, F.lit(3))).alias("verses"))
        return text.let(F.split(F.regexp_replace(F.substr(F.col("_t"), start + 1), *groups), text.MARK, -1), told)

    starts = F.slice(ends, F.lit(1), F.size("_p") - 1)
    known = F.filter(F.transform(starts, read), lambda x: x["chapter"].isNotNull() & x["verses"].isNotNull())
    tried = cut.select(key, "_t", F.explode(known).alias("x")).select(key, "_t", "x.*")
    own = sounds_of(labels, char_sounds, "book", "label")
    # equal characters before a chapter are looked up once; texts don't go along
    books = label_by_sound(sounds_of(tried.select("named").distinct(), char_sounds, "named", "named"), own, key="named")
    valid = tried.join(books, "named")
    first = F.col("start") + F.length("named") - F.col("length")
    opened = F.when((first > 0) & F.substr(F.col("_t"), first, F.lit(1)).isin("《", "「"), 1).otherwise(0)
    book = F.when(F.col("book") == "Psalms", "Psalm").otherwise(F.col("book"))
    made = F.struct("start", (F.col("start") + F.length("whole")).alias("end"), (first - opened).alias("begin"), F.concat(book, F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), "verses").alias("reference"))
    listed = valid.groupBy(key).agg(F.array_sort(F.collect_list(made)).alias("all"))
    empty = F.struct(F.lit(0).alias("at"), F.slice("all", 1, 0).alias("out"))
    kept = F.aggregate("all", empty, lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.array_append(a["out"], x).alias("out"))).otherwise(a), lambda a: a["out"])
    return listed.select(key, F.explode(kept).alias("c")).select(key, "c.begin", "c.end", "c.reference")
