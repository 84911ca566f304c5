"""Transcript-shaped tables derived from the given ones; the same derivations stand as SQL in plans/oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import segmenting


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, word, start, end: one second a word."""
    w = segmenting.whitespace_words(table(spark, sf_dir, "documents"))
    return w.select("doc_id", "pos", "word", F.col("pos").cast("double").alias("start"), (F.col("pos") + 1).cast("double").alias("end"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_id"), "role", "text")
    n = F.size(text.words(F.col("text")))
    c = c.withColumns({"dur": n / F.lit(2.5) * F.when(F.col("seg_id") % 5 == 4, 4.0).otherwise(1.0), "pause": F.when(F.col("seg_id") % 3 == 0, 2.0).otherwise(0.3)})
    w = Window.partitionBy("doc_id").orderBy("seg_id")
    start = F.round(F.coalesce(F.sum(F.col("dur") + F.col("pause")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("pause"), 3)
    return c.withColumn("start", start).select("doc_id", "seg_id", "start", F.round(start + F.col("dur"), 3).alias("end"), "text", "role")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, duration."""
    end = _timed(spark, sf_dir).groupBy("doc_id").agg(F.max("end").alias("e"))
    return end.select("doc_id", F.round(F.col("e") + F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(2.5), 3).alias("duration"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seg_id, start, end, text, role, with an invented closing segment in every fourth conversation."""
    closing = docs(spark, sf_dir).where("doc_id % 4 = 0").select("doc_id", F.lit(9999).cast("long").alias("seg_id"), F.round(F.col("duration") - 0.9, 3).alias("start"), F.round(F.col("duration") + 29.1, 3).alias("end"), F.lit("Thank you").alias("text"), F.lit("user").alias("role"))
    timed = _timed(spark, sf_dir)
    return timed.withColumn("seg_id", F.col("seg_id").cast("long")).unionByName(closing)


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, word: what a listener made of it."""
    kept = words(spark, sf_dir).where("pos % 17 <> 5 AND NOT pos BETWEEN 40 AND 47")
    return kept.select("doc_id", "pos", F.when(F.col("pos") % 23 == 7, "zzz").otherwise(F.col("word")).alias("word"))


def heard_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, heard: the rows (pos, word) of `heard` as an array beside the text, in order."""
    each = F.transform(text.words(F.col("text")), lambda w, i: F.struct(i.alias("pos"), F.when(i % 23 == 7, "zzz").otherwise(w).alias("word")))
    kept = F.filter(each, lambda x: (x["pos"] % 17 != 5) & ~x["pos"].between(40, 47))
    return table(spark, sf_dir, "documents").select("doc_id", "text", kept.alias("heard"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ref, hyp: whole texts, and the same without what stands between 40 % and 45 % of their length."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("ref"))
    return d.selectExpr("id", "ref", "concat(substring(ref, 1, cast(length(ref) * 2 div 5 as int)), ' zz ', substring(ref, cast(length(ref) * 9 div 20 as int) + 1)) AS hyp")


def books(spark: SparkSession) -> DataFrame:
    """ord, book of the plain books, in order."""
    names = [line.split(":")[0] for line in rules.BOOKS.strip().splitlines()]
    return spark.createDataFrame(list(enumerate(names)), "ord int, book string")


def citation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: sentences with a citation in one of four forms, or a decoy."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    b = F.broadcast(books(spark))
    n = len(rules.BOOKS.strip().splitlines())
    x = li.join(b, F.col("l_partkey") % n == F.col("ord")).withColumns({"c": 1 + F.col("l_suppkey") % 150, "v": F.col("l_linenumber")})
    form = F.col("l_orderkey") % 5
    cite = (
        F.when(form == 0, F.format_string("%s %d:%d", "book", "c", "v"))
        .when(form == 1, F.format_string("%s %d.%d", "book", "c", "v"))
        .when(form == 2, F.format_string("%s, chapter %d, verse %d", "book", "c", "v"))
        .when(form == 3, F.format_string("%s %d, verses %d and %d", "book", "c", "v", F.col("v") + 1))
        .otherwise(F.format_string("Section %d, verse %d", "c", "v"))
    )
    return x.select(F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), F.concat(F.lit("read "), cite, F.lit(" again")).alias("text"))


def book_labels(spark: SparkSession) -> DataFrame:
    """book, lang, label: synthetic labels, one book missing in each language."""
    langs = spark.createDataFrame([(i, x) for i, x in enumerate(("en", "de", "es", "fr", "ru", "zh"))], "i int, lang string")
    return books(spark).crossJoin(F.broadcast(langs)).where("ord % 60 <> i OR lang = 'en'").select("book", "lang", F.concat_ws("_", "book", "lang").alias("label"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, seq, ts, status, error."""
    return ledger_rows(table(spark, sf_dir, "events"))


def ledger_rows(e: DataFrame) -> DataFrame:
    """The events table, or a stream of it, in the shape of the ledger."""
    kind = F.col("event_type")
    status = F.when(kind.isin("signup", "click"), "pending").when(kind == "view", "in_progress").when(kind == "purchase", "done").otherwise("failed")
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.when(status == "failed", F.concat(F.lit("E"), (F.floor("value") % 3).cast("string"))).alias("error"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, dir, stem, ext."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".MP4", ".txt", ".wav", ".jpg")]), (F.col("doc_id") % 5 + 1).cast("int"))
    f = d.select("doc_id", F.concat(F.lit("/src/"), "source", F.lit("/"), "lang").alias("dir"), F.concat(F.lit("Doc"), F.col("doc_id").cast("string")).alias("stem"), ext.alias("ext"))
    return f.select("doc_id", F.concat("dir", F.lit("/"), "stem", "ext").alias("path"), "dir", "stem", "ext")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, dir, stem: texts beside their recordings, in the text folder in another case, or missing; near misses."""
    f = files(spark, sf_dir)
    beside = f.where("doc_id % 3 = 0").select("dir", "stem")
    folder = f.where("doc_id % 3 = 1").select(F.lit("/texts").alias("dir"), F.upper("stem").alias("stem"))
    near = f.where("doc_id % 3 = 2").select("dir", F.concat("stem", F.lit("b")).alias("stem"))
    return beside.unionByName(folder).unionByName(near).select(F.concat("dir", F.lit("/"), "stem", F.lit(".txt")).alias("path"), "dir", "stem")


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, take, lost, tail."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("take"), (F.floor("l_quantity") % 7).alias("lost"), F.round(F.col("l_discount").cast("double") * 10 + F.lit(0.0), 6).alias("tail"))


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: conversations as a script, a tag before each turn, blank lines between."""
    tag = F.element_at(F.array(*[F.lit(x) for x in ("[calm] ", "[angry] ", "[laugh] ", "[inaudible] ")]), (F.col("turn") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.struct(F.col("turn").alias("turn"), F.concat(tag, "text").alias("line")).alias("x"))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("text"))


def digits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, lang."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()
    return li.select(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("room "), F.col("l_partkey").cast("string"), F.lit(" and "), F.col("l_linenumber").cast("string")).alias("text"), F.element_at(F.array(F.lit("zh"), F.lit("hi"), F.lit("xx")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("lang"))
