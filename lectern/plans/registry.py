"""Queries over the given tables, by name, and the DuckDB SQL that says the same (plans/oracles.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger, repair, scoring, segmenting
from ..sources import fixtures as fx
from . import alignment_queries, building_blocks, citation_queries, label_queries, number_queries, opening_queries, reading_queries, restoring_queries, spoken_queries, stream_queries
from .oracles import ORACLES as _OWN

QUERIES = alignment_queries.QUERIES | building_blocks.QUERIES | citation_queries.QUERIES | label_queries.QUERIES | number_queries.QUERIES | opening_queries.QUERIES | reading_queries.QUERIES | restoring_queries.QUERIES | spoken_queries.QUERIES | stream_queries.QUERIES
ORACLES = _OWN | alignment_queries.ORACLES | building_blocks.ORACLES | citation_queries.ORACLES | label_queries.ORACLES | number_queries.ORACLES | opening_queries.ORACLES | reading_queries.ORACLES | restoring_queries.ORACLES | spoken_queries.ORACLES | stream_queries.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def sentence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    s = docs.select("lang", "source", "doc_id", F.explode(F.flatten(F.transform(text.paragraphs(F.col("text")), text.sentences))).alias("s"))
    n = F.size(text.words(F.col("s")))
    return s.groupBy("lang", "source").agg(F.count("*").alias("sentences"), F.sum(n).alias("words"), F.count_if(n >= 40).alias("long_sentences"), F.count_if(~F.col("s").rlike(r"[.!?]\z")).alias("no_stop"))


@query
def granularity_choice(spark, sf_dir):
    return segmenting.choose_granularity(fx.script(spark, sf_dir)).select("doc_id", "paragraphs", F.round("mean_words", 6).alias("mean_words"), "granularity")


@query
def unpunctuated_runs(spark, sf_dir):
    return segmenting.unpunctuated_runs(fx.words(spark, sf_dir)).select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n_words", F.col("marks").cast("long").alias("marks"))


@query
def window_tokens(spark, sf_dir):
    w = segmenting.window_tokens(fx.words(spark, sf_dir).select("doc_id", "pos"), 200, 180)
    return w.groupBy("doc_id", "win").agg(F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"), F.count_if("keep").alias("kept"))


@query
def segment_gaps(spark, sf_dir):
    return repair.segment_gaps(fx.segments(spark, sf_dir), fx.docs(spark, sf_dir)).select("doc_id", F.round("begin", 3).alias("begin"), F.round("finish", 3).alias("finish"))


@query
def slow_segments(spark, sf_dir):
    return repair.slow_segments(fx.segments(spark, sf_dir), fx.docs(spark, sf_dir)).select("doc_id", "seg_id", F.round("span", 3).alias("span"), F.col("words").cast("long").alias("words"))


@query
def closing_filler(spark, sf_dir):
    return repair.closing_filler(fx.segments(spark, sf_dir), fx.docs(spark, sf_dir)).select("doc_id", "seg_id", "start", "text")


@query
def fragment_stats(spark, sf_dir):
    r = repair.fragment_stats(fx.segments(spark, sf_dir), ["role"])
    return r.select("role", "segments", *[F.round(c, 9).alias(c) for c in ("begin_mid", "no_stop", "both")])


@query
def densest_window(spark, sf_dir):
    return repair.densest_window(fx.segments(spark, sf_dir)).select("doc_id", F.round("begin", 3).alias("begin"), F.round("speech", 3).alias("speech"), "thin")


@query
def reading_timeline(spark, sf_dir):
    c = fx.segments(spark, sf_dir).where("seg_id < 9999").select("doc_id", F.col("seg_id").alias("chunk_id"), (F.col("end") - F.col("start")).alias("duration"), (F.col("seg_id") % 5 == 0).alias("starts_paragraph"))
    return repair.reading_timeline(c).select("doc_id", "chunk_id", "start", "end")


@query
def render_srt_cues(spark, sf_dir):
    return repair.render_srt(fx.segments(spark, sf_dir)).select("doc_id", F.col("cue").cast("long").alias("cue"), "body")


@query
def document_words(spark, sf_dir):
    return repair.document_words(fx.segments(spark, sf_dir))


@query
def live_excerpt(spark, sf_dir):
    return repair.live_excerpt(fx.segments(spark, sf_dir))


@query
def forward_order(spark, sf_dir):
    c = fx.segments(spark, sf_dir).select("doc_id", F.col("seg_id").alias("chunk_id"), F.when(F.col("seg_id") % 3 == 1, F.col("start") - 20).otherwise(F.col("start")).alias("start"), "end")
    return repair.forward_order(c).select("doc_id", "chunk_id", F.round("start", 3).alias("start"))


@query
def tail_ratio(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(repair.tail_ratio(F.col("embedding"), F.lit(32)), 5).alias("ratio"))


@query
def choose_take(spark, sf_dir):
    return repair.choose_take(fx.takes(spark, sf_dir)).select("doc_id", F.col("take").cast("long").alias("take"), F.col("lost").cast("long").alias("lost"), "tail", "clean", "takes")


@query
def repeat_share(spark, sf_dir):
    return repair.repeat_share(fx.pairs(spark, sf_dir), "hyp", "ref").select("id", F.round("share", 9).alias("share"))


@query
def spoken_length(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.spoken_length(F.col("text")).alias("units"))


@query
def ledger_state(spark, sf_dir):
    return ledger.ledger_state(fx.ledger_events(spark, sf_dir)).select("path", "seq", "status", "error")


@query
def ledger_summary(spark, sf_dir):
    return ledger.ledger_summary(ledger.ledger_state(fx.ledger_events(spark, sf_dir)))


@query
def ledger_retry_failed(spark, sf_dir):
    return ledger.ledger_retry_failed(ledger.ledger_state(fx.ledger_events(spark, sf_dir))).select("path", "status")


@query
def ledger_reset_interrupted(spark, sf_dir):
    return ledger.ledger_reset_interrupted(ledger.ledger_state(fx.ledger_events(spark, sf_dir))).select("path", "status")


@query
def failure_runs(spark, sf_dir):
    return ledger.failure_runs(fx.ledger_events(spark, sf_dir))


@query
def next_pending(spark, sf_dir):
    return ledger.next_pending(ledger.ledger_state(fx.ledger_events(spark, sf_dir)), 5).select("path", "seq")


@query
def adopt_unfinished(spark, sf_dir):
    state = ledger.ledger_state(fx.ledger_events(spark, sf_dir))
    return ledger.adopt_unfinished(state, state.where("seq % 2 = 0")).select("path", "status")


@query
def purgeable_uploads(spark, sf_dir):
    state = ledger.ledger_state(fx.ledger_events(spark, sf_dir))
    return ledger.purgeable_uploads(state.select("path", F.col("seq").alias("length")), state)


@query
def scan_catalog(spark, sf_dir):
    return ledger.scan_catalog(fx.files(spark, sf_dir)).select("path", "dir")


@query
def pair_reference_text(spark, sf_dir):
    return ledger.pair_reference_text(fx.files(spark, sf_dir), fx.texts(spark, sf_dir))


@query
def plan_output_paths(spark, sf_dir):
    return ledger.plan_output_paths(fx.files(spark, sf_dir), ["txt", "srt", "json"])


@query
def stage_plan(spark, sf_dir):
    p = ledger.stage_plan(fx.files(spark, sf_dir), ["es", "ru"], True, False)
    return p.groupBy("stage", "lang").agg(F.count("*").alias("n"))


@query
def chrf(spark, sf_dir):
    # a small table is one row group: spread it, as grams take far longer than reading
    spread = fx.pairs(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return scoring.chrf(spread).select("id", F.round("chrf", 6).alias("chrf"))


@query
def content_stems(spark, sf_dir):
    s = scoring.content_stems(fx.pairs(spark, sf_dir), "ref")
    return s.groupBy("id").agg(F.count("*").alias("stems"), F.min("stem").alias("first_stem"))


@query
def missing_runs(spark, sf_dir):
    return scoring.missing_runs(fx.words(spark, sf_dir), fx.heard(spark, sf_dir)).select("doc_id", F.col("first").cast("long").alias("first"), "n")
