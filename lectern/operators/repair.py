"""Defects of timed transcripts, and what to put in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text


def segment_gaps(segments: DataFrame, docs: DataFrame, least: float = rules.GAP_SECONDS) -> DataFrame:
    """doc_id, begin, finish of stretches longer than `least` that no segment covers, the one before the document's end
    included. Documents without duration have no tail."""
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    inner = segments.select("doc_id", F.coalesce(F.max("end").over(w), F.lit(0.0)).alias("begin"), F.col("start").alias("finish"))
    tail = docs.join(segments.groupBy("doc_id").agg(F.max("end").alias("begin")), "doc_id", "left").select("doc_id", F.coalesce("begin", F.lit(0.0)).alias("begin"), F.col("duration").alias("finish"))
    return inner.unionByName(tail).where(F.col("finish") - F.col("begin") > least)


def slow_segments(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, seg_id, span, words of segments of six seconds or more with under 1.3 words a second; ends beyond the
    document's are clipped."""
    span = F.least(F.col("end"), F.coalesce("duration", "end")) - F.col("start")
    cut = segments.join(docs.select("doc_id", "duration"), "doc_id", "left").select("doc_id", "seg_id", span.alias("span"), F.size(text.words(F.col("text"))).alias("words"))
    return cut.where((F.col("span") >= rules.SLOW_SECONDS) & (F.col("words") < rules.SLOW_RATE * F.col("span")))


def closing_filler(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """Segments that begin in the last 1.5 seconds and run over a second past the end: invented closing words."""
    return segments.join(docs.select("doc_id", "duration"), "doc_id").where((F.col("start") > F.col("duration") - rules.CLOSING_SECONDS) & (F.col("end") > F.col("duration") + rules.SLACK_SECONDS)).drop("duration")


def without_closing_filler(segments: DataFrame, words: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and words without it."""
    bad = closing_filler(segments, docs)
    first = bad.groupBy("doc_id").agg(F.min("start").alias("_from"))
    return segments.join(bad.select("doc_id", "seg_id"), ["doc_id", "seg_id"], "left_anti"), words.join(first, "doc_id", "left").where(F.col("_from").isNull() | (F.col("start") < F.col("_from"))).drop("_from")


def choose_refill(stretches: DataFrame, candidates: DataFrame, least_words: int = 0) -> DataFrame:
    """For each stretch (doc_id, stretch, finish) the way of decoding with most words among segments that end by
    finish + 1 s; on a tie the way listed first. Ways with fewer than `least_words` words don't count."""
    fit = candidates.join(stretches.select("doc_id", "stretch", "finish"), ["doc_id", "stretch"]).where(F.col("end") <= F.col("finish") + rules.SLACK_SECONDS)
    ways = fit.groupBy("doc_id", "stretch", "way").agg(F.sum(F.size(text.words(F.col("text")))).alias("words")).where(F.col("words") >= least_words)
    best = ways.groupBy("doc_id", "stretch").agg(F.max_by("way", F.struct(F.col("words"), -F.col("way"))).alias("way"), F.max("words").alias("words"))
    return best


def slow_options(segments: DataFrame, slow: DataFrame) -> DataFrame:
    """doc_id, seg_id, option, begin, finish: the stretches of a slow segment (segments: doc_id, seg_id, start, end, text)
    to decode again. 1: all of it; 2: what comes before its text, said last; 3: what comes after it, said first."""
    old = segments.join(slow.select("doc_id", "seg_id").distinct(), ["doc_id", "seg_id"])
    said = F.size(text.words(F.coalesce("text", F.lit("")))) / rules.READING_RATE
    option = lambda n, a, b: F.struct(F.lit(n).alias("option"), a.alias("begin"), b.alias("finish"))
    start, end = F.col("start"), F.col("end")
    each = old.select("doc_id", "seg_id", F.explode(F.array(option(1, start, end), option(2, start, end - said), option(3, start + said, end))).alias("o"))
    return each.select("doc_id", "seg_id", "o.*").where(F.col("finish") - F.col("begin") >= rules.GAP_SECONDS)


def replace_slow_segments(segments: DataFrame, words: DataFrame, slow: DataFrame, candidates: DataFrame, candidate_words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """segments (doc_id, at, seg_id, piece, start, end, text) and words (doc_id, start, end, word) after slow segments gave way
    to what was decoded again.

    candidates: doc_id, seg_id, option, piece, start, end, text (`slow_options` says of what); candidate_words: the same
    keys with start, end, word. In options 2 and 3 pieces that repeat the old text (60 % of their words) don't count and
    the old text stays beside the others, for as long as it takes to say. The option with most words wins, the first on a
    tie, if it has three words more than the old text; options without pieces are none. Words that began within a
    replaced segment go. Keys of segments and pieces are unique.
    """
    count = lambda c: F.size(text.words(F.coalesce(c, F.lit(""))))
    options = slow_options(segments, slow)
    old = segments.join(slow.select("doc_id", "seg_id").distinct(), ["doc_id", "seg_id"]).select("doc_id", "seg_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("text").alias("_t"))
    pieces = candidates.join(options, ["doc_id", "seg_id", "option"]).join(old, ["doc_id", "seg_id"])
    share = repeat_share(pieces.where("option > 1").select(F.struct("doc_id", "seg_id", "option", "piece").alias("id"), "text", "_t"), "text", "_t").where(F.col("share") >= rules.REPEATED).select("id.*")
    pieces = pieces.join(share, ["doc_id", "seg_id", "option", "piece"], "left_anti")
    total = pieces.groupBy("doc_id", "seg_id", "option").agg(F.sum(count(F.col("text"))).alias("n"), F.first(count(F.col("_t"))).alias("old"))
    total = total.withColumn("n", F.col("n") + F.when(F.col("option") > 1, F.col("old")).otherwise(0))
    best = total.groupBy("doc_id", "seg_id").agg(F.max_by("option", F.struct(F.col("n"), -F.col("option"))).alias("option"), (F.max("n") - F.first("old")).alias("gain")).where(F.col("gain") >= rules.REFILL_WORDS).drop("gain")
    won = pieces.join(best, ["doc_id", "seg_id", "option"]).select("doc_id", "seg_id", F.col("piece").cast("long").alias("piece"), "start", "end", "text")
    said = count(F.col("_t")) / rules.READING_RATE
    first = F.col("option") == 3
    kept = old.join(best.where("option > 1"), ["doc_id", "seg_id"]).select("doc_id", "seg_id", F.lit(None).cast("long").alias("piece"), F.when(first, F.col("_s")).otherwise(F.col("_e") - said).alias("start"), F.when(first, F.col("_s") + said).otherwise(F.col("_e")).alias("end"), F.col("_t").alias("text"))
    stay = segments.join(best, ["doc_id", "seg_id"], "left_anti").select("doc_id", "seg_id", F.lit(None).cast("long").alias("piece"), "start", "end", "text")
    out = stay.unionByName(won).unionByName(kept)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "seg_id", F.col("piece").asc_nulls_first())) - 1
    gone = old.join(best, ["doc_id", "seg_id"]).select("doc_id", F.col("_s").alias("start"), F.col("_e").alias("end"), F.lit(None).cast("string").alias("word"), F.lit(0).alias("kind"))
    both = words.select("doc_id", "start", "end", "word", F.lit(1).alias("kind")).unionByName(gone)
    reach = F.max(F.when(F.col("kind") == 0, F.col("end"))).over(Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    left = both.withColumn("reach", reach).where("kind = 1 AND (reach IS NULL OR start >= reach)").select("doc_id", "start", "end", "word")
    if candidate_words is not None:
        left = left.unionByName(candidate_words.join(won.select("doc_id", "seg_id", "piece").join(best, ["doc_id", "seg_id"]), ["doc_id", "seg_id", "option", "piece"]).select("doc_id", "start", "end", "word"))
    return out.select("doc_id", at.alias("at"), "seg_id", "piece", "start", "end", "text"), left


def repeat_share(df: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """key, share: of the words of text a (lower case, outer marks dropped) those that b has; 1.0 where a has none. Rows
    with one key count as one text. Words are counted by key before they meet, so long texts cost no more than words."""
    clean = lambda c: F.filter(F.transform(text.words(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    side = lambda c, own: F.transform(clean(F.col(c)), lambda w: F.struct(w.alias("w"), F.lit(own).alias("own")))
    said = df.select(key, F.explode_outer(F.concat(side(a, 1), side(b, 0))).alias("x")).select(key, "x.w", "x.own")
    counted = said.groupBy(key, "w").agg(F.sum("own").alias("n"), F.min("own").alias("least"))
    total = counted.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("least") == 0, F.col("n"))).alias("met"))
    return total.select(key, F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("met", F.lit(0)) / F.col("n")).alias("share"))


def fragment_stats(segments: DataFrame, by: list[str]) -> DataFrame:
    """Shares of segments that begin in mid-sentence (lower-case letter first), end without a stop, and both."""
    t = F.trim("text")
    a, b = t.rlike(r"^\p{Ll}"), ~t.rlike(r"[.!?…]$")
    return segments.groupBy(*by).agg(F.count("*").alias("segments"), F.avg(a.cast("double")).alias("begin_mid"), F.avg(b.cast("double")).alias("no_stop"), F.avg((a & b).cast("double")).alias("both"))


def densest_window(segments: DataFrame, seconds: float = 10.0) -> DataFrame:
    """doc_id, begin, speech, thin: the window from some segment's start with most speech in it, the first among
    equals; thin below 60 %. Segments meet through the stretch of `seconds` that they touch, not all with all."""
    s = segments.where("end > start").select("doc_id", "seg_id", "start", "end")
    cells = lambda a, b: F.sequence(F.floor(a / seconds), F.floor(b / seconds))
    windows = s.select("doc_id", F.col("seg_id").alias("w"), F.col("start").alias("begin"), F.explode(cells(F.col("start"), F.col("start") + seconds)).alias("cell"))
    spans = s.select("doc_id", "seg_id", "start", "end", F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    overlap = F.least(F.col("end"), F.col("begin") + seconds) - F.greatest(F.col("start"), F.col("begin"))
    met = windows.join(spans, ["doc_id", "cell"]).where((F.col("start") < F.col("begin") + seconds) & (F.col("end") > F.col("begin")))
    once = met.where(F.col("cell") == F.greatest(F.floor(F.col("start") / seconds), F.floor(F.col("begin") / seconds)))
    score = once.groupBy("doc_id", "w", "begin").agg(F.sum(overlap).alias("speech"))
    best = score.groupBy("doc_id").agg(F.max_by(F.struct("begin", "speech"), F.struct(F.round("speech", 6), -F.col("begin"), -F.col("w"))).alias("x"))
    return best.select("doc_id", "x.begin", "x.speech", (F.col("x.speech") < 0.6 * seconds).alias("thin"))


def forward_order(chunks: DataFrame, slack: float = rules.ORDER_SLACK) -> DataFrame:
    """Chunks with times set to null where they begin over `slack` seconds before the largest start so far."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.greatest(F.coalesce(F.max("start").over(w), F.lit(0.0)), F.lit(0.0))
    marked = chunks.withColumn("_late", F.col("start") < floor - slack)
    drop = lambda c: F.when(~F.coalesce("_late", F.lit(False)), F.col(c)).alias(c)
    return marked.select(*[drop(c) if c in ("start", "end") else c for c in chunks.columns])


def reading_timeline(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    """chunks (duration, starts_paragraph) with start and end: durations so far and the pauses between."""
    w = Window.partitionBy(key).orderBy(order)
    pause = F.when(F.row_number().over(w) == 1, 0.0).when(F.col("starts_paragraph"), rules.GAP_PARAGRAPH).otherwise(rules.GAP_CHUNK)
    timed = chunks.withColumn("_pause", pause)
    start = F.sum(F.col("_pause")).over(w) + F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return timed.withColumn("start", F.round(start, 3)).withColumn("end", F.round(start + F.col("duration"), 3)).drop("_pause")


def speech_loud_gaps(gaps: DataFrame, frames: DataFrame, frame: float = 0.1) -> DataFrame:
    """Gaps (doc_id, begin, finish) at least 40 % of whose frames are louder than 0.3 of the document's third
    quartile, with the share."""
    level = frames.groupBy("doc_id").agg((F.percentile("rms", F.lit(0.75)) * rules.LOUD_LEVEL).alias("level"))
    spread = gaps.withColumn("frame_no", F.explode(F.sequence(F.floor(F.col("begin") / frame), F.floor(F.col("finish") / frame))))
    met = spread.join(frames, ["doc_id", "frame_no"]).join(level, "doc_id")
    return met.groupBy("doc_id", "begin", "finish").agg(F.avg((F.col("rms") > F.col("level")).cast("double")).alias("loud_share")).where(F.col("loud_share") >= rules.LOUD_SHARE)


def tail_ratio(samples, rate):
    """Loudness of the last half second over that of the whole clip; 0 if silent."""
    power = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(a))
    n = F.least(F.size(samples), F.greatest(F.floor(rate / 2).cast("int"), F.lit(1)))
    whole = power(samples)
    return F.when((F.size(samples) == 0) | (whole == 0), 0.0).otherwise(power(F.slice(samples, -n, n)) / whole)


def choose_take(takes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, take, lost, tail, clean, takes: the take that loses least, then with the smallest tail, the first of
    equals; clean if nothing is lost and the tail is within its limit."""
    best = takes.groupBy(key).agg(F.min(F.struct("lost", "tail", "take")).alias("x"), F.count("*").alias("takes"))
    return best.select(key, "x.take", "x.lost", "x.tail", ((F.col("x.lost") == 0) & (F.col("x.tail") <= rules.TAIL_LIMIT)).alias("clean"), "takes")


def document_words(segments: DataFrame) -> DataFrame:
    """doc_id, words over all segments."""
    return segments.groupBy("doc_id").agg(F.sum(F.size(text.words(F.col("text")))).alias("words"))


def live_excerpt(segments: DataFrame, n: int = rules.EXCERPT_WORDS) -> DataFrame:
    """doc_id, excerpt: the last n words of a transcript so far. Only segments that can hold them are gathered."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("seg_id")).rowsBetween(Window.unboundedPreceding, -1)
    sized = segments.withColumn("_w", text.words(F.col("text"))).withColumn("_after", F.coalesce(F.sum(F.size("_w")).over(w), F.lit(0)))
    kept = sized.where(F.col("_after") < n).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "_w"))), lambda x: x["_w"])).alias("all"))
    return kept.select("doc_id", F.array_join(F.slice("all", -F.least(F.size("all"), F.lit(n)), F.least(F.size("all"), F.lit(n))), " ").alias("excerpt"))


def render_srt(segments: DataFrame) -> DataFrame:
    """doc_id, cue, body of non-blank segments, numbered from 1 by start."""
    w = Window.partitionBy("doc_id").orderBy("start", "seg_id")
    kept = segments.where(F.trim("text") != "").withColumn("cue", F.row_number().over(w))
    body = F.concat_ws("\n", F.col("cue").cast("string"), F.concat(text.format_timestamp(F.col("start")), F.lit(" --> "), text.format_timestamp(F.col("end"))), F.trim("text"))
    return kept.select("doc_id", "cue", body.alias("body"))


def fill_durations(files: DataFrame, probes: DataFrame, key: str = "path") -> DataFrame:
    """files with duration taken from a positive probe where it is null or zero."""
    p = probes.where("probe > 0").groupBy(key).agg(F.max("probe").alias("_probe"))
    filled = files.join(p, key, "left").withColumn("duration", F.coalesce(F.nullif("duration", F.lit(0.0)), "_probe", "duration"))
    return filled.drop("_probe")
