"""Texts into paragraphs, sentences, runs and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text


def split_paragraphs(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, para, text."""
    return df.select(key, F.posexplode(text.paragraphs(F.col(col))).alias("para", "text"))


def split_sentences(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, para, sent, text; sentences numbered within their paragraph."""
    return split_paragraphs(df, key, col).select(key, "para", F.posexplode(text.sentences(F.col("text"))).alias("sent", "text"))


def whitespace_words(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, pos, word."""
    return df.select(key, F.posexplode(text.words(F.col(col))).alias("pos", "word"))


def tokenize(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, pos, token; tokens that normalise to nothing are not counted."""
    return df.select(key, F.posexplode(text.tokens(F.col(col))).alias("pos", "token"))


def choose_granularity(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, paragraphs, mean_words, granularity: sentence below two paragraphs or over 120 words on average."""
    parts = text.paragraphs(F.col(col))
    sized = df.select(key, F.transform(parts, lambda p: F.size(text.words(p))).alias("n"))
    mean = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x) / F.nullif(F.size("n"), F.lit(0))
    return sized.select(key, F.size("n").cast("long").alias("paragraphs"), mean.alias("mean_words"), F.when((F.size("n") < 2) | (mean > rules.PARAGRAPH_WORDS), "sentence").otherwise("paragraph").alias("granularity"))


def chunk_parts(col: Column, granularity: str = "auto") -> Column:
    """A text's paragraphs or sentences as an array, or as choose_granularity says."""
    parts = text.paragraphs(col)
    whole = F.transform(parts, lambda p: F.regexp_replace(p, r"\s*\n\s*", " "))
    cut = F.flatten(F.transform(parts, text.sentences))
    if granularity == "auto":
        total = F.aggregate(F.transform(parts, lambda p: F.size(text.words(p)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when((F.size(parts) >= 2) & (total <= rules.PARAGRAPH_WORDS * F.size(parts)), whole).otherwise(cut)
    return whole if granularity == "paragraph" else cut


def chunk_text(df: DataFrame, granularity: str = "auto", key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, chunk_id, text, words: paragraphs or sentences, or as choose_granularity says; each row is chosen for by itself."""
    return df.select(key, F.posexplode(chunk_parts(F.col(col), granularity)).alias("chunk_id", "text")).withColumn("words", text.tokens(F.col("text")))


def unpunctuated_runs(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, last, n_words, marks of stretches between sentence ends of 40 words or more with fewer than one
    comma, colon or semicolon per 40 words (the last word's marks don't count)."""
    w = Window.partitionBy(key).orderBy("pos")
    ended = words.withColumn("ends", F.col("word").rlike(r"[.!?…][\"'”’)\]]*$").cast("int"))
    runs = ended.withColumn("run", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marks = F.length(F.regexp_replace("word", "[^,;:]", ""))
    grouped = runs.groupBy(key, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_words"), (F.sum(marks) - F.max_by(marks, "pos")).alias("marks"))
    return grouped.where((F.col("n_words") >= rules.RUN_WORDS) & (F.col("marks") * rules.RUN_WORDS < F.col("n_words"))).drop("run")


def window_tokens(tokens: DataFrame, size: int, step: int, key: str = "doc_id") -> DataFrame:
    """key, win, pos, keep: overlapping windows of a token table; every window but the last keeps its first `step`
    positions, so each token is kept once."""
    n = tokens.groupBy(key).agg((F.max("pos") + 1).alias("n"))
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0))
    return (
        tokens.join(n, key)
        .select(key, "pos", last.alias("_last"), F.explode(F.sequence(F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0)), F.least(F.floor(F.col("pos") / step), last))).alias("win"))
        .select(key, "win", "pos", ((F.col("win") == F.col("_last")) | (F.col("pos") < F.col("win") * step + step)).alias("keep"))
    )


def merge_window_scores(scores: DataFrame, key: str = "doc_id", threshold: float = 0.25) -> DataFrame:
    """key, pos, score, is_break: mean logit of a token over its windows; a break above the threshold."""
    mean = scores.groupBy(key, "pos").agg(F.avg("logit").alias("logit"))
    p = 1 / (1 + F.exp(-F.col("logit")))
    return mean.select(key, "pos", p.alias("score"), (p > threshold).alias("is_break"))


def source_clauses(df: DataFrame, key: str = "doc_id", col: str = "text", least: int = 6) -> DataFrame:
    """key, clause, text: cut after commas and semicolons that don't follow a digit; pieces that are short without the
    spaces, commas and semicolons around them join the next one, a short tail the one before."""
    pieces = F.filter(F.split(F.regexp_replace(col, r"(?<![0-9])([,，;；])", "$1" + text.MARK), text.MARK), lambda p: p != "")
    start = F.struct(F.lit("").alias("open"), F.expr("cast(array() as array<string>)").alias("done"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def step(acc, p):
        now = F.concat(acc["open"], p)
        full = F.length(F.regexp_replace(now, "^[ ,，;；]+|[ ,，;；]+$", "")) >= least
        return F.struct(F.when(full, "").otherwise(now).alias("open"), F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"))

    def close(acc):
        n = F.size(acc["done"])
        joined = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(acc["done"], F.lit(-1)), F.lit("")), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).otherwise(joined)

    merged = F.aggregate(pieces, start, step, close)
    return df.select(key, F.posexplode(F.transform(merged, strip)).alias("clause", "text"))


def reading_clauses(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, clause, text: cut after commas, semicolons, colons not between digits, after their Arabic and CJK kin, and
    after spaced dashes; the mark stays left."""
    return df.select(key, F.posexplode(_breaths(F.col(col))).alias("clause", "text"))


def _breaths(col: Column) -> Column:
    cut = F.regexp_replace(col, r"((?:(?<![0-9])[,;:](?![0-9])|[,;:](?=\s)|[،؛，；：、]|\s[-–—](?=\s)))\s*", "$1" + text.MARK)
    return F.filter(F.transform(F.split(cut, text.MARK), lambda p: F.trim(p)), lambda p: p != "")


def pack_chunks(sentences: DataFrame, budget: int = rules.CHUNK_BUDGET, key: str = "doc_id", order: str = "sent") -> DataFrame:
    """key, chunk_id, text: sentences packed greedily, in order, up to the budget of spoken length (one more for each
    join). A sentence over the budget is a chunk of its own. One fold over a document's sentences, in the JVM."""
    listed = sentences.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: F.struct(x["t"].alias("t"), text.spoken_length(x["t"]).alias("n"))).alias("all"))
    start = F.struct(F.lit("").alias("open"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<string>)").alias("done"))

    def step(acc, x):
        fits = (acc["n"] > 0) & (acc["n"] + 1 + x["n"] <= budget)
        flush = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(
            F.when(fits, F.concat(acc["open"], F.lit(" "), x["t"])).otherwise(x["t"]).alias("open"),
            F.when(fits, acc["n"] + 1 + x["n"]).otherwise(x["n"]).alias("n"),
            F.when(fits, acc["done"]).otherwise(flush).alias("done"),
        )

    packed = F.aggregate("all", start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return listed.select(key, F.posexplode(packed).alias("chunk_id", "text"))


def pack_for_speech(sentences: DataFrame, budget: int = rules.CHUNK_BUDGET, openers: tuple[str, ...] = (), key: str = "doc_id", order: str = "sent") -> DataFrame:
    """As pack_chunks for texts that are read aloud: a sentence over the budget is offered as its clauses (one without
    any stays whole), what ends in a colon goes with what it introduces if both fit, and a sentence that starts with one
    of `openers` starts a chunk. Blank sentences are left out."""
    one = lambda c: F.trim(F.regexp_replace(c, "[ \t]+", " "))
    listed = sentences.where(one(F.col("text")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one(F.col("text")).alias("t")))).alias("s"))
    units = F.flatten(F.transform("s", lambda x: F.when(text.spoken_length(x["t"]) <= budget, F.array(x["t"])).otherwise(_breaths(x["t"]))))
    sized = listed.select(key, F.transform(units, lambda u: F.struct(u.alias("t"), text.spoken_length(u).alias("n"))).alias("u"))
    none = F.expr("cast(array() as array<struct<t:string,n:bigint>>)")
    start = F.struct(F.lit("").alias("open"), F.lit(0).cast("long").alias("n"), none.alias("done"))
    ended = lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], F.struct(a["open"].alias("t"), a["n"].alias("n"))))

    def fold(col, joins):
        def step(a, x):
            fits = (a["n"] > 0) & (a["n"] + 1 + x["n"] <= budget) & joins(a, x)
            return F.struct(
                F.when(fits, F.concat(a["open"], F.lit(" "), x["t"])).otherwise(x["t"]).alias("open"),
                F.when(fits, a["n"] + 1 + x["n"]).otherwise(x["n"]).alias("n"),
                F.when(fits, a["done"]).otherwise(ended(a)).alias("done"),
            )

        return F.aggregate(col, start, step, ended)

    with_next = sized.select(key, fold("u", lambda a, x: a["open"].rlike("[:：]\\s*$")).alias("u"))
    opens = lambda x: F.lit(False) if not openers else x["t"].rlike("^(?:" + "|".join(rf"\Q{o}\E" for o in openers) + ")")
    packed = with_next.select(key, F.transform(fold("u", lambda a, x: ~opens(x)), lambda x: x["t"]).alias("c"))
    return packed.select(key, F.posexplode("c").alias("chunk_id", "text"))


def rebuild_paragraphs(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: sentences joined by newlines, paragraphs by blank lines, blank sentences dropped."""
    kept = sentences.where(F.trim("text") != "")
    paras = kept.groupBy(key, "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return paras.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
