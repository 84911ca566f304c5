"""Comparing what was meant with what came out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text


def _gram_means(hyp, ref, order: int):
    """Mean precision and recall of the n-grams up to `order` that both sides have; None where there are none.

    Grams of n characters are numbered by the number of their first n - 1 and their last character, so they are told apart
    exactly; time is that of `order` sorts of both texts.
    """
    sides = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (hyp, ref)]
    h, r = map(len, sides)
    if not h or not r:
        return None
    chars = np.unique(np.concatenate(sides), return_inverse=True)[1].astype(np.int64)
    number, size, found = np.zeros(h + r, np.int64), int(chars.max()) + 1, []
    for n in range(1, min(order, h, r) + 1):
        first = np.concatenate((np.arange(h - n + 1), h + np.arange(r - n + 1)))
        grams = np.unique(number[first] * size + chars[first + n - 1], return_inverse=True)[1]
        number[first] = grams
        kinds = int(grams.max()) + 1
        in_h, in_r = (np.bincount(x, minlength=kinds) for x in (grams[: h - n + 1], grams[h - n + 1 :]))
        both = int(np.minimum(in_h, in_r).sum())
        found.append((both / (h - n + 1), both / (r - n + 1)))
    return [sum(x) / len(found) for x in zip(*found)]


def chrf(pairs: DataFrame, order: int = 6, beta: float = 2.0, key: str = "id") -> DataFrame:
    """key, chrf: mean character n-gram precision and recall (orders that both sides have), F with beta, times 100; 0
    where either side is empty or null. A row's grams are counted within the row: nothing is exploded or shuffled."""

    @F.pandas_udf("array<double>")
    def means(hyp, ref):
        import pandas as pd

        return pd.Series([_gram_means(h, r, order) for h, r in zip(hyp, ref)], dtype=object)

    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", "")
    scored = pairs.select(key, means(clean("hyp"), clean("ref")).alias("m")).select(key, F.get("m", F.lit(0)).alias("p"), F.get("m", F.lit(1)).alias("r"))
    b2 = beta * beta
    score = F.when((F.col("p") + F.col("r")) > 0, 100 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r")))
    return scored.select(key, F.coalesce(score, F.lit(0.0)).alias("chrf"))


def flag_invented(scored: DataFrame, floor: float = rules.CHRF_FLOOR) -> DataFrame:
    """Rows whose translation read back is below the floor."""
    return scored.where(F.col("chrf") < floor)


def choose_candidate(scored: DataFrame, key: str = "id") -> DataFrame:
    """key, way: the best chrF, the first way of equals."""
    return scored.groupBy(key).agg(F.max_by("way", F.struct(F.col("chrf"), -F.col("way"))).alias("way"))


def content_stems(df: DataFrame, col: str = "text", key: str = "id") -> DataFrame:
    """key, stem: distinct first five letters of words of four letters or more that are not function words."""
    found = F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"\p{L}{4,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(rules.STOPWORDS))
    return df.select(key, F.explode(F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 5)))).alias("stem"))


def dropped_clause(whole: DataFrame, clauses: DataFrame, key: str = "id") -> DataFrame:
    """key, clause: the first clause whose own translation has three stems or more, none of them in the whole's."""
    own = content_stems(clauses.withColumn("_k", F.struct(key, "clause")), "text", "_k").select(F.col(f"_k.{key}").alias(key), "_k.clause", "stem")
    there = content_stems(whole, "text", key).withColumn("hit", F.lit(1))
    counts = own.join(there, [key, "stem"], "left").groupBy(key, "clause").agg(F.count("*").alias("stems"), F.count("hit").alias("hits"))
    return counts.where("stems >= 3 AND hits = 0").groupBy(key).agg(F.min("clause").alias("clause"))


def citation_recall(want: DataFrame, got: DataFrame, key: str = "id") -> DataFrame:
    """key, right, wanted: citations of the source that came back, each counted as often as it stands there."""
    w = want.groupBy(key, "citation").agg(F.count("*").alias("w"))
    g = got.groupBy(key, "citation").agg(F.count("*").alias("g"))
    return w.join(g, [key, "citation"], "left").groupBy(key).agg(F.sum(F.least("w", F.coalesce("g", F.lit(0)))).alias("right"), F.sum("w").alias("wanted"))


def marker_kept(src: DataFrame, back: DataFrame, months: list[str], key: str = "id") -> DataFrame:
    """One row: readings whose source names a month, and the share of those whose way back has it."""
    month = F.regexp_extract(F.lower("text"), "(" + "|".join(m.lower() for m in months) + ")", 1)
    s = src.select(key, month.alias("month")).where("month <> ''")
    j = s.join(back.select(key, F.lower("text").alias("_b")), key, "left")
    return j.agg(F.count("*").alias("readings"), F.avg(F.coalesce(F.contains("_b", "month"), F.lit(False)).cast("double")).alias("kept"))


def strip_trailing_fillers(col, reference, phrases: list[str]):
    """Known filler phrases off the end, repeatedly, unless the reference ends that way."""
    quoted = "|".join(rf"\Q{p}\E" for p in phrases)
    tail = rf"(?i)(?:\s*(?:{quoted})[.!?]*)+\s*$"
    return F.when(reference.rlike(tail), col).otherwise(F.regexp_replace(col, tail, ""))


def missing_runs(words: DataFrame, heard: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, n: stretches of positions that were not heard."""
    lost = words.join(heard.select(key, "pos"), [key, "pos"], "left_anti")
    w = Window.partitionBy(key).orderBy("pos")
    return lost.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy(key, "island").agg(F.min("pos").alias("first"), F.count("*").alias("n")).drop("island")


def added_or_missing(regions: DataFrame, least: int, kind: str) -> DataFrame:
    """Regions (spoken, heard) that one side lacks: deleted, or over twice as long on one side, of `least` letters."""
    a, b = ("spoken", "heard") if kind == "missing" else ("heard", "spoken")
    la, lb = F.length(a), F.length(b)
    return regions.where((la >= least) & ((lb == 0) | (la > 2 * lb)))


def warning_digest(warnings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, digest: the first warning and how many more there are."""
    g = warnings.groupBy(key).agg(F.min_by("message", "ord").alias("first"), F.count("*").alias("n"))
    return g.select(key, F.when(F.col("n") == 1, F.col("first")).otherwise(F.concat("first", F.lit(" ("), (F.col("n") - 1).cast("string"), F.lit(" more)"))).alias("digest"))


def reading_provenance(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, styles (in order of first use), chunks, seconds."""
    first = chunks.groupBy(key, "style").agg(F.min("chunk_id").alias("at"), F.count("*").alias("n"), F.sum("duration").alias("s"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "style"))), lambda x: x["style"]).alias("styles"), F.sum("n").alias("chunks"), F.round(F.sum("s"), 3).alias("seconds"))


def alignment_summary(chunks: DataFrame) -> DataFrame:
    """doc_id, chunks, timed, unmatched."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("start").alias("timed"), F.count_if(F.col("start").isNull()).alias("unmatched"))


def round_trip_report(scores: DataFrame) -> DataFrame:
    """take, doc_id, chrf, right, wanted with totals for each take and over all."""
    return scores.rollup("take", "doc_id").agg(F.avg("chrf").alias("chrf"), F.sum("right").alias("right"), F.sum("wanted").alias("wanted"))




def missing_citations(pairs: DataFrame, key: str = "id", stretches: str | None = None) -> DataFrame:
    """key, citation, short: chapters and verses that `spoken` says more often than `heard` has them, by how many;
    same-sounding letters of `heard` count. `stretches` is a column of texts already known to be missing: what stands in
    one of them is not told again. Null sides are empty; rows with equal keys count as one text."""
    side = lambda c: F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), *rules.SAME_SOUND), F.lit(rules.CHAPTER_OR_VERSE), F.lit(0))
    known = F.transform(F.coalesce(F.col(stretches), F.array().cast("array<string>")), lambda t: F.translate(t, *rules.SAME_SOUND)) if stretches else F.array().cast("array<string>")
    within = lambda x: F.coalesce(F.exists(known, lambda t: F.contains(t, x)), F.lit(False))
    marked = lambda c, n: F.transform(side(F.col(c)), lambda x: F.struct(x.alias("citation"), F.lit(n).alias("n"), within(x).alias("told")))
    found = pairs.select(key, F.explode(F.concat(marked("spoken", 1), marked("heard", -1))).alias("x")).groupBy(key, "x.citation").agg(F.sum("x.n").alias("short"), F.bool_or("x.told").alias("told"))
    return found.where("short > 0 AND NOT told").drop("told")


def names_a_citation(stretches):
    """Whether any of the stretches (array) has a chapter or verse mark; false for none."""
    return F.coalesce(F.exists(stretches, lambda s: s.rlike(rules.CHAPTER_OR_VERSE + "|פרק|פסוק")), F.lit(False))


def language_notices(docs: DataFrame, confusions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, detected, meant: documents without a set language whose detected one is taken for another (detected, meant)."""
    return docs.where("language IS NULL").join(confusions.dropDuplicates(["detected"]), "detected").select(key, "detected", "meant")


def gazetteer_coverage(labels: DataFrame, books: DataFrame) -> DataFrame:
    """lang, labels, complete, thinnest first: how many of the books have a label that is not blank in each language."""
    have = labels.where("trim(label) <> ''").select("lang", "book").distinct().join(books.select("book").distinct(), "book", "left_semi")
    total = books.agg(F.countDistinct("book").alias("_total"))
    return have.groupBy("lang").agg(F.count("*").alias("labels")).crossJoin(total).select("lang", "labels", (F.col("labels") == F.col("_total")).alias("complete")).orderBy("labels", "lang")


def supported_languages(vocabulary: DataFrame, family: str) -> DataFrame:
    """lang: codes that a model of the family (marked: __xx__, tagged: <2xx>) takes, from its tokens (token)."""
    pattern = {"marked": r"^__([a-z]{2,3})__$", "tagged": r"^<2([a-zA-Z_]{2,})>$"}[family]
    return vocabulary.select(F.regexp_extract("token", pattern, 1).alias("lang")).where("lang <> ''").distinct().orderBy("lang")
