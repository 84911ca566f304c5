"""Transcripts and timed texts as files: plain text, text with times, JSON; and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

VERSION = 1
_SEGMENT = "struct<id:long,start:double,end:double,text:string>"
_CHUNK = "struct<id:long,start:double,end:double,timed:boolean,text:string>"
_SHAPE = f"version int, kind string, source string, language string, duration double, granularity string, segments array<{_SEGMENT}>, chunks array<{_CHUNK}>"


def read_text_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text: whole files, UTF-8, without the mark at the beginning; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.decode(F.encode("value", "UTF-8"), "UTF-8"), "^﻿", "").alias("text"))


def _ordered(rows: DataFrame, key: str, order: str, value) -> DataFrame:
    """key, parts: the values in order."""
    g = rows.select(key, F.struct(F.col(order).alias("o"), value.alias("v")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select(key, F.col("x.v").alias("parts"))


def render_txt(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body: the segments' texts joined by spaces, one sentence a line; without text an empty body."""
    said = _ordered(segments, key, "seg_id", F.trim(F.coalesce("text", F.lit(""))))
    lines = text.sentences(F.array_join(F.filter("parts", lambda t: t != ""), " "))
    return said.select(key, lines.alias("l")).select(key, F.when(F.size("l") > 0, F.concat(F.array_join("l", "\n"), F.lit("\n"))).otherwise("").alias("body"))


def render_timestamped_text(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body: [time] before each timed chunk (start not null), others bare, a blank line between."""
    line = F.when(F.col("start").isNotNull(), F.concat(F.lit("["), text.format_timestamp(F.col("start"), "."), F.lit("] "), "text")).otherwise(F.col("text"))
    return _ordered(chunks, key, "chunk_id", line).select(key, F.concat(F.regexp_replace(F.array_join("parts", "\n\n"), "\n+$", ""), F.lit("\n")).alias("body"))


def transcript_json(segments: DataFrame, docs: DataFrame, kind: str = "transcription", key: str = "doc_id") -> DataFrame:
    """key, body: one JSON document for each row of docs (source, language, duration). Blank segments go, the others
    keep their number; times have three decimals."""
    kept = segments.where(F.trim("text") != "")
    one = F.struct(F.col("seg_id").cast("long").alias("id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.trim("text").alias("text"))
    rows = docs.join(_ordered(kept, key, "seg_id", one), key, "left")
    none = F.array().cast(f"array<{_SEGMENT}>")
    whole = F.struct(F.lit(VERSION).alias("version"), F.lit(kind).alias("kind"), "source", "language", "duration", F.coalesce("parts", none).alias("segments"))
    return rows.select(key, F.to_json(whole, {"ignoreNullFields": "false"}).alias("body"))


def alignment_json(chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body: granularity (of docs), a summary and all chunks, those without times with nulls."""
    timed = F.col("start").isNotNull()
    one = F.struct(F.col("chunk_id").cast("long").alias("id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), timed.alias("timed"), "text")
    rows = docs.join(_ordered(chunks, key, "chunk_id", one), key, "left").withColumn("parts", F.coalesce("parts", F.array().cast(f"array<{_CHUNK}>")))
    met = F.size(F.filter("parts", lambda x: x["timed"]))
    summary = F.struct("granularity", F.size("parts").alias("chunks"), met.alias("timed"), (F.size("parts") - met).alias("unmatched"))
    whole = F.struct(F.lit(VERSION).alias("version"), F.lit("alignment").alias("kind"), "granularity", summary.alias("summary"), F.col("parts").alias("chunks"))
    return rows.select(key, F.to_json(whole, {"ignoreNullFields": "false"}).alias("body"))


def read_transcript_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`segments` (path, kind, source, language, duration, seg_id, start, end, text), `chunks` (path, granularity,
    chunk_id, start, end, text) and `refused` (path) of files of another version or broken ones."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", _SHAPE).alias("d")).select("path", "d.*")
    known = files.where(F.col("version") == VERSION)
    segments = known.where("kind <> 'alignment'").select("path", "kind", "source", "language", "duration", F.explode("segments").alias("s"))
    chunks = known.where("kind = 'alignment'").select("path", "granularity", F.explode("chunks").alias("s"))
    return {
        "segments": segments.select("path", "kind", "source", "language", "duration", F.col("s.id").alias("seg_id"), "s.start", "s.end", "s.text"),
        "chunks": chunks.select("path", "granularity", F.col("s.id").alias("chunk_id"), "s.start", "s.end", "s.text"),
        "refused": files.where(F.coalesce("version", F.lit(0)) != VERSION).select("path"),
    }


def write_outputs(bodies: dict[str, DataFrame], dest: str, key: str = "doc_id") -> None:
    """For each format a folder below `dest` with a part file's rows (key, body) as Parquet.

    Rows are written beside an earlier output, in a folder that readers skip, and take its place by a rename once all
    are there: a job that fails leaves the earlier output as it was, and between two renames it lies in the folder
    `_old-...`.
    """
    for form, rows in bodies.items():
        run = uuid.uuid4().hex
        new, old, place = f"{dest}/_new-{form}-{run}", f"{dest}/_old-{form}-{run}", f"{dest}/format={form}"
        rows.select(key, "body").write.parquet(new)
        jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path
        files = at(dest).getFileSystem(conf)
        if files.exists(at(place)) and not files.rename(at(place), at(old)):
            raise OSError(f"{place} could not be set aside")
        if not files.rename(at(new), at(place)):
            raise OSError(f"{new} could not be put in place")
        files.delete(at(old), True)
