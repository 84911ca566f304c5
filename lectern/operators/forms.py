"""Texts as they are compared when a reading is scored against what was heard of it: a figure for each way of writing
that counts as one, and the errors of every take.

A language's forms and its limit of tokens that count as lost are in SCORERS. Spell numbers on both sides first
(numbers.spell_numbers), and citations of the text that was read (numbers.speak_citations).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .alignment import error_rate
from .scoring import strip_trailing_fillers

# Three ways of writing "he", and a word read in one way and heard in others.
ZH_SAME, ZH_MANNA = ("祂她它", "他他他"), ("[吗玛][哪纳娜]", "吗哪")
# What is heard after the end, letters said alike, and number words of either gender as one.
HE_TAIL = "תודה רבה"
HE_SOUND = ("עהחטקבס", "אאכתכוש")
HE_GENDER = {"אחד": "אחת", "שנימ": "שתימ", "שניימ": "שתימ", "שתיימ": "שתימ", "שלושה": "שלוש", "ארבעה": "ארבע", "חמישה": "חמש", "שישה": "שש", "שבעה": "שבע", "תשעה": "תשע", "עשרה": "עשר"}
HE_PREFIXES = "ובלמהכש"
# Arabic marks that are no letters, and spellings of one sound.
AR_MARKS = "[ً-ٰٟۖ-ۭـ]"
AR_SAME = ("أإآٱىة", "اااايه")


def _presentation(first: int, last: int) -> tuple[str, str]:
    """Presentation forms of a block that stand for one letter with marks, and those letters."""
    pairs = [(c, [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]) for c in map(chr, range(first, last + 1))]
    kept = [(c, base[0]) for c, base in pairs if len(base) == 1 and base[0] != c]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


def _zh(t: Column, heard: Column, raw: bool) -> dict[str, Column]:
    chars = F.translate(F.regexp_replace(t, r"[^\p{L}\p{N}]|[a-zA-Z]", ""), *ZH_SAME)
    return {"chars": chars if raw else F.regexp_replace(chars, *ZH_MANNA)}


def _he(t: Column, heard: Column, raw: bool) -> dict[str, Column]:
    plain = F.regexp_replace(F.translate(F.translate(t, "־-", "  "), *_presentation(0xFB1D, 0xFB4F)), "[֑-ׇ]", "")
    letters = F.translate(F.regexp_replace(plain, "[^א-ת ]+", " "), *text.FOLDS["he", "letters"])
    words = F.filter(F.split(letters, " +"), lambda w: w != "")
    if not raw:
        ended = F.regexp_replace(F.array_join(words, " "), f"(?:(?:^| ){HE_TAIL})+$", "")
        words = F.when(heard, F.filter(F.split(ended, " "), lambda w: w != "")).otherwise(words)
        genders = F.create_map(*[F.lit(x) for kv in HE_GENDER.items() for x in kv])
        tail = lambda w: F.substr(w, F.lit(2))
        prefixed = lambda w: F.when(w.rlike(f"^[{HE_PREFIXES}]"), F.concat(F.substring(w, 1, 1), F.try_element_at(genders, tail(w))))
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(genders, w), prefixed(w), w))
    short = lambda ws, drop: F.array_join(F.transform(ws, lambda w: F.concat(F.substring(w, 1, 1), F.translate(F.substr(w, F.lit(2)), drop, ""))), "")
    return {"letters": F.array_join(words, ""), "skeleton": short(words, "וי"), "sound": short(F.transform(words, lambda w: F.translate(w, *HE_SOUND)), "ויא"), "words": words}


def _ar(t: Column, heard: Column, raw: bool) -> dict[str, Column]:
    plain = F.regexp_replace(F.translate(F.regexp_replace(t, "[ﻵ-ﻼ]", "لا"), *_presentation(0xFB50, 0xFEF4)), AR_MARKS, "")
    words = F.filter(F.split(F.regexp_replace(F.translate(plain, *AR_SAME), "[^ء-ي ]+", " "), " +"), lambda w: w != "")
    return {"letters": F.array_join(words, ""), "words": words}


NEVER = 10**9
# language: its forms, and for each figure how many tokens in a row count as lost
SCORERS = {"zh": (_zh, {"chars": 6}), "he": (_he, {"letters": NEVER, "skeleton": NEVER, "sound": NEVER, "words": 3}), "ar": (_ar, {"letters": NEVER, "words": 3})}


def score_forms(df: DataFrame, lang: str, heard: bool = False, raw: bool = False, col: str = "text") -> DataFrame:
    """df with a column for each figure of SCORERS[lang]: a text of the letters that count, or an array of words. `raw`
    keeps what is otherwise put down to the listener. Null texts are empty."""
    if lang not in SCORERS:
        raise ValueError(f"no forms for {lang}")
    return df.withColumns(SCORERS[lang][0](F.coalesce(F.col(col), F.lit("")), F.lit(heard), raw))


def score_takes(refs: DataFrame, takes: DataFrame, lang: str, fillers: list[str] = (), raw: bool = False, key: str = "doc_id") -> DataFrame:
    """figure, take, key, edits, n, rate, lost of takes (key, take, text) against refs (key, text), with totals of each
    take (key null) and figure (take null too). Fillers at the end of what was heard go, unless the reference ends so.
    Texts without a take have no row; keys of refs are unique."""
    figures = SCORERS[lang][1]
    side = lambda df, n, cols, heard: score_forms(df, lang, heard, raw).select(*cols, F.struct(*figures).alias(n))
    pairs = side(refs, "_r", [key], False).join(side(takes, "_h", [key, "take"], True), key)
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def row(figure, lost_at):
        r, h = F.col(f"_r.{figure}"), F.col(f"_h.{figure}")
        if figure != "words":
            h = strip_trailing_fillers(h, r, list(fillers)) if fillers and not raw else h
            r, h = letters(r), letters(h)
        return F.struct(F.lit(figure).alias("figure"), F.lit(lost_at).alias("lost_at"), r.alias("ref"), h.alias("hyp"))

    each = pairs.select(key, "take", F.explode(F.array(*[row(*x) for x in figures.items()])).alias("x")).select(key, "take", "x.*")
    return error_rate(each, F.col("lost_at"), keys=("figure", "take", key)).where("figure IS NOT NULL")
