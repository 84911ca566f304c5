"""Column expressions over text: no joins, no Python on rows. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

MARK = "\u0001"
OPENER = r"([.!?][\"')\]]*)\s+([\"'(\[]?[\p{Lu}\p{Nd}\p{Lo}])"
CASELESS = r"([。！？؟۔।։、．]+[\"')\]」』）]*)\s*"
ABBREVIATED = r"(?i)((?:^|[\s" + MARK + r"])(?:" + "|".join(a.replace(".", r"\.") for a in rules.ABBREVIATIONS) + ")) ?" + MARK
# Scripts whose characters carry more speech than a Latin letter.
DENSE = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"
ABJAD = r"[֐-׿؀-ۿݐ-ݿࢠ-ࣿיִ-﷿ﹰ-﻿]"
SCRIPTS = {"he": r"\p{IsHebrew}", "zh": r"\p{IsHan}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}", "digit": r"[0-9]"}


def let(value: Column, then) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def words(col: Column) -> Column:
    """White-space words as an array."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def normalise_token(col: Column) -> Column:
    """Letters, digits and apostrophes, lower case, without accents and outer apostrophes."""
    return F.btrim(F.lower(F.regexp_replace(_unaccented(col), r"[^\p{L}\p{N}']", "")), F.lit("'"))


def _unaccented(col: Column) -> Column:
    """Precomposed letters as their base letters; ASCII texts are not walked."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, *_accents())).otherwise(col)


def _accents() -> tuple[str, str]:
    """Precomposed letters whose decomposition is one base letter and marks, and those base letters."""
    import unicodedata

    a, b = [], []
    for c in (chr(i) for i in [*range(0xC0, 0x250), *range(0x386, 0x3D0), *range(0x400, 0x482), *range(0x1E00, 0x2000)]):
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c:
            a.append(c)
            b.append(base[0])
    return "".join(a), "".join(b)


def tokens(col: Column) -> Column:
    """Normalised tokens of a text, empty ones dropped."""
    # a letter's base is a letter, so tokens are cut alike without accents, and only the underscore is left to drop
    cut = F.regexp_extract_all(_unaccented(col), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    return F.filter(F.transform(cut, lambda w: F.btrim(F.lower(F.replace(w, F.lit("_"), F.lit(""))), F.lit("'"))), lambda w: w != "")


def format_timestamp(seconds: Column, sep: str = ",") -> Column:
    """HH:MM:SS and milliseconds, halves to even; null and negative as zero; hours over 99 in full."""
    ms = F.bround(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1000, 0).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(sep), F.lpad((ms % 1000).cast("string"), 3, "0"))


def spoken_length(col: Column) -> Column:
    """Characters, with more for dense scripts and for scripts that leave vowels out; halves to even."""
    count = lambda cls: F.length(col) - F.length(F.regexp_replace(col, cls, ""))
    return F.bround(F.length(col) + rules.DENSE_EXTRA * count(DENSE) + rules.ABJAD_EXTRA * count(ABJAD), 0).cast("long")


# Letters that are compared as one, by language and level.
FOLDS = {
    ("he", "letters"): ("ךםןףץ", "כמנפצ"),
    ("he", "sound"): ("עהחקטשו", "אאככתסב"),
    ("ar", "letters"): ("أإآٱةى", "ااااهي"),
    ("ar", "sound"): ("أإآٱةىعصخط", "ااااهياسحت"),
    ("zh", "letters"): ("張张片節", "章章篇节"),
    ("hi", "sound"): ("खघछझठढथधफभङञणशषईऊीू", "कगचजटडतदपबननननससइउिु"),
}
DROPPED = {"he": r"[֑-ׇ]", "ar": r"[ً-ْـٰ]", "hi": r"[़ँं्]"}


def fold_script(col: Column, lang: str, level: str = "letters") -> Column:
    """A text with letters that a comparison takes as one folded together."""
    out = F.regexp_replace(col, DROPPED[lang], "") if lang in DROPPED else col
    for step in ("letters", "sound") if level == "sound" else ("letters",):
        if (lang, step) in FOLDS:
            out = F.translate(out, *FOLDS[lang, step])
    return out


def has_script(col: Column, script: str) -> Column:
    """Cheap test before heavy matching."""
    return col.rlike(SCRIPTS[script])


def respell(col: Column, pairs: list[tuple[str, str]], drop: str = "") -> Column:
    """Quote marks dropped, written forms replaced by said ones, in order (rules: dozens, known at plan time)."""
    out = F.translate(col, drop, "") if drop else col
    for written, said in pairs:
        out = F.replace(out, F.lit(written), F.lit(said))
    return out


def source_fixups(col: Column) -> Column:
    """Western stops for full-width ones, and the title with a capital before a model sees the text."""
    out = F.regexp_replace(F.translate(col, "。！？，：；", ".!?,:;"), r"\b([Tt]he|[Oo]ur) lord\b", "$1 Lord")
    return out


def unescape(col: Column) -> Column:
    """The HTML entities that models emit."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(name), F.lit(ch))
    return col


def language_list(col: Column) -> Column:
    """Codes of a list text: split at commas and spaces, trimmed, first of repeats kept."""
    return F.array_distinct(F.filter(F.split(F.coalesce(col, F.lit("")), r"[,\s]+"), lambda x: x != ""))


def resolve_reading_language(targets: Column, detected: Column, stated: Column) -> Column:
    """First target, else detected, else stated, else en; lower case."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(clean(F.get(targets, F.lit(0))), clean(detected), clean(stated), F.lit("en"))


def style_params(exaggeration: Column, weight: Column, temperature: Column) -> Column:
    """A style's numbers within their limits, three decimals."""
    put = lambda c, low, high: F.round(F.least(F.greatest(c, F.lit(low)), F.lit(high)), 3)
    return F.struct(put(exaggeration, 0.0, 1.5).alias("exaggeration"), put(weight, 0.0, 1.0).alias("cfg_weight"), put(temperature, 0.05, 1.5).alias("temperature"))


def sentences(paragraph: Column) -> Column:
    """Sentences of one paragraph: a stop and space before a capital, digit or caseless letter, or a caseless script's
    stop; not after an abbreviation. Line breaks count as spaces."""
    flat = F.regexp_replace(F.trim(paragraph), r"\s*\n\s*", " ")
    # twice: the letter that opens one sentence may be all of it
    out = F.regexp_replace(F.regexp_replace(flat, OPENER, "$1" + MARK + "$2"), OPENER, "$1" + MARK + "$2")
    out = F.regexp_replace(out, CASELESS, "$1" + MARK)
    for _ in range(2):
        out = F.regexp_replace(out, ABBREVIATED, "$1 ")
    return F.filter(F.transform(F.split(out, MARK), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
