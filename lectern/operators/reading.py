"""From transcripts to texts that are read, translated and read aloud: prose sentences, chunks of prose, the languages of
each file, and citations of an English text as they are scored.

Documents are folded in their own rows; tables of languages are relations of the user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from .citations import find_citations, name_citations
from .model import apply_model
from .segmenting import pack_for_speech

# English number words, and how a chapter and verse are said with them.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER = rf"(?:\d+|(?:{'|'.join(UNITS + TENS)})(?:[- ](?:{'|'.join(UNITS[1:10])}))?)"
SPELLED = rf"(?i),?\s*\bchapter\s+({NUMBER})\s*,?\s*verses?\s+({NUMBER})"


def prose_sentences(segments: DataFrame, key: str = "doc_id", order: str = "seg_id") -> DataFrame:
    """key, sent, text: a transcript's segments joined in order and cut into sentences, whatever they were cut for.
    Blank segments are left out; a transcript of nothing else has no sentence. Restore lost stops before this
    (punctuation.py)."""
    said = segments.where(F.trim("text") != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim("text").alias("t")))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["t"]), " ")
    return said.select(key, F.posexplode(text.sentences(joined)).alias("sent", "text"))


def translate_prose(sentences: DataFrame, fn: Callable[[list[str]], list[str]], key: str = "doc_id", order: str = "sent") -> DataFrame:
    """key, body: every sentence through the model, a line each; blank results are left out, and a text without any
    line is empty."""
    lines = apply_model(sentences.select(key, F.col(order).alias("o"), "text"), fn, "text", "said").withColumn("said", F.trim("said"))
    listed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("o", "said")))).alias("l"))
    return listed.select(key, F.when(F.size("l") > 0, F.concat(F.array_join(F.transform("l", lambda x: x["said"]), "\n"), F.lit("\n"))).otherwise("").alias("body"))


def translate_chunks(chunks: DataFrame, fn: Callable[[list[str]], list[str]], col: str = "text") -> DataFrame:
    """chunks with their texts translated and every other column (style, numbers) as it was; a chunk whose translation
    is blank is left out."""
    done = apply_model(chunks, fn, col, "_said").withColumn("_said", F.trim("_said")).where("_said <> ''")
    return done.withColumn(col, F.col("_said")).drop("_said")


def chunks_from_prose(df: DataFrame, style: str = rules.DEFAULT_STYLE, budget: int = rules.CHUNK_BUDGET, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, chunk_id, text, style, starts_paragraph: lines are the sentences, as the translator left them; a text of one
    line is cut into sentences first. No tags are read. Blank and null texts have no chunk; keys are unique."""
    t = F.coalesce(F.col(col), F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\R|[\x1C-\x1E]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    listed = F.when(F.size(lines) <= 1, text.sentences(F.trim(F.regexp_replace(t, r"\s+", " ")))).otherwise(lines)
    packed = pack_for_speech(df.select(key, F.posexplode(listed).alias("sent", "text")), budget, key=key)
    return packed.select(key, "chunk_id", "text", F.lit(style).alias("style"), (F.col("chunk_id") == 0).alias("starts_paragraph"))


def source_code(df: DataFrame, supported: DataFrame, detected: str = "detected", told: str | None = None) -> DataFrame:
    """df with source_code: the detected language, if the model knows it (supported: lang) or works it out for itself
    (`told` is a boolean column: false where it does); empty for one unknown to such a model, else English. A model
    without any listed language takes what was detected."""
    known = supported.select(F.col("lang").alias("_lang")).distinct().withColumn("_known", F.lit(True))
    listed = supported.select(F.lit(True).alias("_any")).limit(1)
    j = df.join(known, F.col(detected) == F.col("_lang"), "left").join(listed, F.lit(True), "left")
    own = F.nullif(F.col(detected), F.lit(""))
    code = F.when(own.isNotNull() & (F.col("_any").isNull() | F.col("_known")), own).otherwise("en")
    if told:
        code = F.when(F.col(told), code).otherwise(F.coalesce(own, F.lit("")))
    return j.select(*df.columns, code.alias("source_code"))


def fan_out_languages(files: DataFrame, speakable: DataFrame, key: str = "path") -> DataFrame:
    """key, lang, at, read, refused: a row for each target language of a file (targets, readings: lists in a text), in
    order. `read` marks those to be read aloud; refused is `untranslated` for a reading that is no target and
    `unspeakable` for one that the voice (speakable: lang; no row: any) lacks, and such a row is not read."""
    t, r = text.language_list(F.col("targets")), text.language_list(F.col("readings"))
    each = files.select(key, F.posexplode(F.concat(t, F.array_except(r, t))).alias("at", "lang"), t.alias("_t"), r.alias("_r"))
    each = each.select(key, "at", "lang", F.array_contains("_t", F.col("lang")).alias("_target"), F.array_contains("_r", F.col("lang")).alias("_read"))
    voice = speakable.select("lang").distinct().withColumn("_voice", F.lit(True))
    j = each.join(voice, "lang", "left").join(speakable.select(F.lit(True).alias("_any")).limit(1), F.lit(True), "left")
    refused = F.when(~F.col("_target"), "untranslated").when(F.col("_read") & F.col("_any").isNotNull() & F.col("_voice").isNull(), "unspeakable")
    return j.select(key, "lang", "at", (F.col("_read") & refused.isNull()).alias("read"), refused.alias("refused"))


def _value(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for k, w in [*enumerate(UNITS), *((10 * k, w) for k, w in enumerate(TENS, 2))] for x in (w, k)])
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).otherwise(F.aggregate(F.split(F.lower(c), "[- ]"), F.lit(0), lambda s, w: s + F.coalesce(F.try_element_at(words, w), F.lit(0))))


def citations_in_digits(col: Column) -> Column:
    """Roman numbers before a capitalised word as digits, and chapters and verses said in words as chapter:verse."""
    t = F.regexp_replace(col, r"\bIII(?= [A-Z][a-z])", "3")
    t = F.regexp_replace(F.regexp_replace(t, r"\bII(?= [A-Z][a-z])", "2"), r"\bI(?= [A-Z][a-z])", "1")
    pieces = F.split(F.regexp_replace(t, SPELLED, text.MARK + "$0" + text.MARK), text.MARK, -1)
    part = lambda p, k: F.regexp_extract(p, SPELLED, k)
    digits = lambda p: part(p, 1).rlike("^[0-9]+$") & part(p, 2).rlike("^[0-9]+$")
    said = lambda p: F.concat(F.lit(" "), _value(part(p, 1)).cast("string"), F.lit(":"), _value(part(p, 2)).cast("string"))
    return F.array_join(F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & ~digits(p), said(p)).otherwise(p)), "")


def english_citation_list(df: DataFrame, tokens: DataFrame, key: str = "id", col: str = "text") -> DataFrame:
    """key, begin, citation (book chapter:verse) of English texts, for scoring: begins are those of the rewritten text
    (citations_in_digits). tokens as for citations.find_citations."""
    plain = df.select(key, citations_in_digits(F.col(col)).alias("text"))
    named = name_citations(find_citations(plain, tokens, key), tokens, key)
    return named.select(key, "begin", F.concat_ws(" ", "book", "numbers").alias("citation"))
