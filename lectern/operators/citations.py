"""Citations of books in sentences: found, named, set aside before a model sees the text, and put back.

Rows are sentences: the text goes with its spans through one exchange by key. The book tables are relations of the
user (a row for each token); Spark broadcasts them where their size allows it. Null texts have no citation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text

_HEAD = r"\b(?:(?:[123]|first|second|third|1st|2nd|3rd)\s+)?[a-z]{2,}"
WRITTEN = r"(?i)(" + _HEAD + r"\.?\s*\d{1,3}(?:\s*:\s*|\.)\d{1,3}(?:\s*[-,–]\s*\d{1,3})*(?:\s*;\s*\d{1,3}\s*:\s*\d{1,3}(?:\s*[-,–]\s*\d{1,3})*)*)"
SPOKEN = r"(?i)(" + _HEAD + r"\s*,?\s*(?:chapter\s+)?\d{1,3}\s*,?\s*(?:verses?|vs\.?|v\.)\s*\d{1,3}(?:\s*(?:and|through|to|-|–|,)\s*\d{1,3})*)"
PLACEHOLDER = r"([@＠]\s*\d+\s*[@＠])"
PIECES = r"[A-Za-z]+|\d+|[^A-Za-z\d]+"


def book_tokens(spark: SparkSession) -> DataFrame:
    """token, plain, family: the book that a token names alone, and the family that it names after an ordinal."""
    plain = spark.createDataFrame(rules.book_rows(rules.BOOKS), "token string, plain string")
    family = spark.createDataFrame(rules.book_rows(rules.NUMBERED_BOOKS), "token string, family string")
    return plain.join(family, "token", "full_outer")


def _alternating(col: Column, pattern: str) -> Column:
    """The text cut around matches: even places stand between them, odd ones are the matches."""
    return F.split(F.regexp_replace(col, pattern, text.MARK + "$1" + text.MARK), text.MARK, -1)


def _spans(pieces: Column) -> Column:
    """begin, end of the odd pieces."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("out"))

    def step(acc, p):
        end = acc["at"] + F.length(p)
        hit = F.struct(acc["at"].alias("begin"), end.alias("end"))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def merge_spans(spans: DataFrame, key: str = "id") -> DataFrame:
    """key, begin, end: overlapping spans as one, from the first begin to the last end; touching ones stay two, and so do
    equal ones that are empty or lack an end. Spans without a begin come last."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("begin"), F.desc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col("begin") < before, 0).otherwise(1))
    # by rows: equal spans that both open a group would count as one in a range
    return opened.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_group").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_group")


def find_citations(df: DataFrame, tokens: DataFrame, key: str = "id", col: str = "text") -> DataFrame:
    """key, begin, end, surface of written (4:17,18) and spoken (chapter 4, verse 17) citations with a word that names
    a book; overlaps are one citation. Equal keys count as one text, so keys are unique."""
    t = F.coalesce(F.col(col), F.lit(""))
    found = df.select(key, t.alias("_t")).where(F.col("_t").rlike(r"\d"))
    found = found.select(key, "_t", F.explode(F.concat(*[_spans(_alternating(F.col("_t"), p)) for p in (WRITTEN, SPOKEN)])).alias("s")).select(key, "_t", "s.*")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.expr("substring(_t, begin + 1, end - begin)")), F.lit("[a-z]+"), F.lit(0)))
    named = found.withColumn("_w", F.explode(words)).join(tokens.select(F.col("token").alias("_w")).distinct(), "_w", "left_semi")
    w = Window.partitionBy(key).orderBy("begin", F.desc("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = named.withColumn("_new", F.when(F.col("begin") < before, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(w))
    merged = grouped.groupBy(key, "_group").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("_t").alias("_t"))
    return merged.select(key, "begin", "end", F.expr("substring(_t, begin + 1, end - begin)").alias("surface"))


def _numbers(tail: Column) -> Column:
    """Chapter and verses in the written form 4:17,18 or 4:17-19."""
    parts = F.regexp_extract_all(tail, F.lit(r"(\D*)(\d{1,3})"), F.lit(0))
    number = lambda p: F.regexp_extract(p, r"(\d{1,3})$", 1)
    sep = lambda p, i: F.when(i == 0, "").when(i == 1, ":").when(p.rlike(r"(?i)through|to|[-–]"), "-").otherwise(",")
    spoken = F.array_join(F.transform(parts, lambda p, i: F.concat(sep(p, i), number(p))), "")
    return F.when(F.contains(tail, F.lit(":")), F.regexp_replace(F.regexp_replace(tail, r"\s+", ""), r"^[,;.]+|[,;.]+$", "")).otherwise(spoken)


def name_citations(spans: DataFrame, tokens: DataFrame, key: str = "id") -> DataFrame:
    """spans with book and numbers. The first word that names a book or family decides; a family needs an ordinal
    before it (null without, but for a name that is a book alone too). numbers are what follows the last such word."""
    ordinals = F.create_map(*[F.lit(x) for kv in rules.ORDINALS.items() for x in kv])
    cut = spans.withColumn("_p", F.regexp_extract_all("surface", F.lit(PIECES), F.lit(0)))
    each = cut.select(key, "begin", F.posexplode("_p").alias("_at", "_w"))
    hits = each.withColumn("token", F.lower("_w")).join(tokens, "token")
    ends = hits.groupBy(key, "begin").agg(F.min_by(F.struct("plain", "family"), "_at").alias("_b"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    j = cut.join(ends, [key, "begin"], "left")
    ahead = F.filter(F.transform(F.slice("_p", 1, F.coalesce("_first", F.lit(0))), lambda p: F.try_element_at(ordinals, F.lower(p))), lambda o: o.isNotNull())
    ordinal = F.get(ahead, F.lit(0))
    book = F.when(F.col("_b.family").isNull() | ordinal.isNull(), F.col("_b.plain")).otherwise(F.concat(ordinal.cast("string"), F.lit(" "), "_b.family"))
    tail = F.array_join(F.slice("_p", F.coalesce(F.col("_last") + 2, F.lit(1)), F.size("_p")), "")
    return j.select(*spans.columns, book.alias("book"), _numbers(tail).alias("numbers"))


def localize_citations(named: DataFrame, labels: DataFrame, lang: str) -> DataFrame:
    """named with local: the book's label in `lang` and the numbers; null for en and where there is no label."""
    own = labels.where((F.col("lang") == lang) & (F.col("lang") != "en")).select("book", F.col("label").alias("_label"))
    return named.join(own, "book", "left").select(*named.columns, F.concat("_label", F.lit(" "), "numbers").alias("local"))


def mask_citations(df: DataFrame, spans: DataFrame, key: str = "id", col: str = "text", reference: str = "surface") -> DataFrame:
    """df with masked (the k-th citation of a text as @k@, from 0) and refs (what stood there, in order)."""
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("begin", "end", F.col(reference).alias("ref")))).alias("_s"))
    j = df.join(listed, key, "left").withColumn("_s", F.coalesce("_s", F.expr("cast(array() as array<struct<begin:int,end:int,ref:string>>)")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("k"))
    t = F.coalesce(F.col(col), F.lit(""))

    def step(acc, s):
        return F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["begin"] - acc["at"]), F.lit("@"), acc["k"].cast("string"), F.lit("@")).alias("out"), s["end"].alias("at"), (acc["k"] + 1).alias("k"))

    masked = F.aggregate("_s", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return j.select(*df.columns, masked.alias("masked"), F.transform("_s", lambda s: s["ref"]).alias("refs"))


def restore_citations(col: Column, refs: Column) -> Column:
    """A text with its citations back in their places. Placeholders may be wide or spaced; unknown numbers stay;
    citations that the text lost follow at its end."""
    pieces = _alternating(col, PLACEHOLDER)
    index = lambda p: F.regexp_extract(p, r"(\d+)", 1).try_cast("int")
    out = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.get(refs, index(p)), p)).otherwise(p)), "")
    seen = F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), index)
    lost = F.filter(refs, lambda r, i: ~F.coalesce(F.array_contains(seen, i), F.lit(False)))
    return F.when(F.size(lost) > 0, F.concat(F.rtrim(out), F.lit(" "), F.array_join(lost, " "))).otherwise(out)


def is_only_citation(masked: Column, refs: Column) -> Column:
    """Whether nothing but citations is left of a text."""
    return (F.size(refs) > 0) & ~F.regexp_replace(masked, PLACEHOLDER, "").rlike(r"[\p{L}\p{N}]")
