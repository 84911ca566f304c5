"""Citations put back into translated sentences so that they fit what stands before them, and the way of a sentence
round or through a model.

All rules are expressions over one row (tables of a dozen words, known at plan time); only sentences that need the model
reach it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .citations import PLACEHOLDER, _alternating, is_only_citation
from .model import apply_model

# A sentence's stops in other scripts.
STOPS = {
    "zh": {".": "。", "!": "！", "?": "？"},
    "ja": {".": "。", "!": "！", "?": "？"},
    "ar": {"?": "؟"},
    "fa": {"?": "؟"},
    "ur": {".": "۔", "?": "؟"},
    "hi": {".": "।"},
    "mr": {".": "।"},
    "ne": {".": "।"},
    "bn": {".": "।"},
    "hy": {".": "։"},
}
# Hebrew words whose first letter is the article.
HE_ARTICLE_WORDS = ("הבשורה", "האיגרת")
# Russian words of books' names in the genitive, dative, accusative, instrumental and prepositional.
CASES = ("gen", "dat", "acc", "ins", "prep")
RU_FORMS = """
книга: книги книге книгу книгой книге
послание: послания посланию послание посланием послании
евангелие: евангелия евангелию евангелие евангелием евангелии
второзаконие: второзакония второзаконию второзаконие второзаконием второзаконии
откровение: откровения откровению откровение откровением откровении
псалтирь: псалтири псалтири псалтирь псалтирью псалтири
песнь: песни песни песнь песнью песни
плач: плача плачу плач плачем плаче
деяния: деяний деяниям деяния деяниями деяниях
первая: первой первой первую первой первой
вторая: второй второй вторую второй второй
третья: третьей третьей третью третьей третьей
четвёртая: четвёртой четвёртой четвёртую четвёртой четвёртой
"""
RU_ORDINALS = ("первая", "вторая", "третья", "четвёртая")
RU_NUMBERED = {"е": ("го", "му", "е", "м", "м"), "я": ("й", "й", "ю", "й", "й")}
# The case after a preposition; after three of them the verb before decides; verbs with the accusative.
RU_PREPOSITIONS = {"prep": "в во о об обо при", "gen": "из от до у для без после около из-за среди", "dat": "к ко по", "ins": "с со над перед между", "acc": "про через"}
RU_TWO_CASE = {
    "на": ([("prep", "основан основыва базир построен сосредоточ откр останов")], "acc"),
    "за": ([("acc", "благодар спасибо слава хвал"), ("ins", "след стои стоя скрыва")], None),
    "под": ([("acc", "подпада попада подпаст попаст"), ("ins", "стои стоя наход жив")], None),
}
RU_ACCUSATIVE = "^(?:сравн|чит|прочит|прочт|перечит|рассмотр|рассматрив|цитир|процитир|помн|вспомн|вспомина|запомн|изуч|откр|упомина|упомян)"
RU_VERBAL_NOUN, RU_REFLEXIVE = "(?:ени|ани|ти)(?:е|я|ю|ем|и|й|ям|ями|ях)$", "(?:ся|сь)$"
RU_WORD = "[а-яёА-ЯЁ-]+"


def keep_final_stop(source: Column, translated: Column, lang: str) -> Column:
    """The translation with the stop that the source has after a last citation, where it ends on a bare placeholder."""
    stop = F.regexp_extract(F.coalesce(source, F.lit("")), PLACEHOLDER + r"([.!?…]+)[\"'”’)\]]*\s*$", 2)
    for western, own in STOPS.get(lang, {}).items():
        stop = F.replace(stop, F.lit(western), F.lit(own))
    return F.when((stop != "") & translated.rlike(PLACEHOLDER + r"\s*$"), F.concat(F.regexp_replace(translated, r"\s+$", ""), stop)).otherwise(translated)


def fit_hebrew_prefix(before: Column, rendered: Column) -> Column:
    """A citation after what stands before it: a hyphen between a Hebrew prefix and a foreign name, no article after a
    prefix that takes it up."""
    joins = before.rlike("[א-ת]$")
    article = before.rlike("[בכלה]$") & F.substring_index(rendered, " ", 1).isin(*HE_ARTICLE_WORDS)
    foreign = (rendered != "") & ~rendered.rlike("^[א-ת]")
    return F.when(joins & foreign, F.concat(F.lit("-"), rendered)).when(joins & article, F.substr(rendered, F.lit(2))).otherwise(rendered)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _starts(word: Column, stems: str) -> Column:
    return word.rlike("^(?:" + "|".join(stems.split()) + ")")


def case_before(before: Column) -> Column:
    """The case that Russian gives a name after `before`: of the preposition, for three of them of the verb among the three
    words before it, or the accusative of a verb; null: as it is."""
    return text.let(F.lower(F.regexp_extract(before, f"(?:^|[^а-яёА-ЯЁ-])({RU_WORD})\\s+$", 1)), lambda word: _case_of(word, before))


def _case_of(word: Column, before: Column) -> Column:
    earlier = F.regexp_extract_all(F.lower(F.regexp_replace(before, f"{RU_WORD}\\s+$", "")), F.lit(RU_WORD), F.lit(0))
    case = F.try_element_at(_map({p: c for c, ps in RU_PREPOSITIONS.items() for p in ps.split()}), word)
    for preposition, (stems, default) in RU_TWO_CASE.items():

        def of_verb(x, stems=stems, default=default):
            found = F.lit(default).cast("string")
            for n in (3, 2, 1):  # the nearest word decides
                near = F.coalesce(F.get(x, F.size(x) - n), F.lit(""))
                for own, group in reversed(stems):
                    found = F.when(_starts(near, group), own).otherwise(found)
            return found

        case = F.when(word == preposition, text.let(earlier, of_verb)).otherwise(case)
    verb = word.rlike(RU_ACCUSATIVE) & ~word.rlike(RU_VERBAL_NOUN) & ~word.rlike(RU_REFLEXIVE)
    return F.coalesce(case, F.when(verb & ~word.isin(*RU_TWO_CASE), "acc"))


def _declined(word: Column, case: Column) -> Column:
    forms = {}
    for line in RU_FORMS.strip().splitlines():
        name, _, rest = line.partition(": ")
        forms |= {f"{name} {c}": f for c, f in zip(CASES, rest.split())}
    numbered = _map({f"{e} {c}": f for e, own in RU_NUMBERED.items() for c, f in zip(CASES, own)})
    raised = lambda form: F.when(word.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(form, 1, 1)), F.substr(form, F.lit(2)))).otherwise(form)
    form = text.let(F.try_element_at(_map(forms), F.concat(F.lower(word), F.lit(" "), case)), raised)
    ending = F.try_element_at(numbered, F.concat(F.regexp_extract(word, r"^\d+-([ея])$", 1), F.lit(" "), case))
    return F.coalesce(F.concat(F.regexp_extract(word, r"^(\d+-)", 1), ending), form)


def inflect_by_context(before: Column, rendered: Column) -> Column:
    """A Russian name in the case that the words before it govern: its first word, and after an ordinal the second.
    Words that the table lacks stay, and so does a name whose first word it lacks."""

    def fitted(x):
        case, words = x["case"], x["words"]
        first = F.get(words, F.lit(0))
        ordinal = first.rlike("^[0-9]") | F.lower(first).isin(*RU_ORDINALS)
        two = F.when(ordinal, _declined(F.get(words, F.lit(1)), case))
        rest = lambda t: F.when(t.isNotNull(), F.concat(F.array(t), F.slice(words, F.lit(3), F.size(words)))).otherwise(F.slice(words, F.lit(2), F.size(words)))
        put = lambda one: F.when(one.isNotNull(), F.array_join(F.concat(F.array(one), text.let(two, rest)), " ")).otherwise(rendered)
        return F.when(case.isNotNull(), text.let(_declined(first, case), put)).otherwise(rendered)

    return text.let(F.struct(case_before(before).alias("case"), F.split(rendered, " ").alias("words")), fitted)


def restore_fitted(col: Column, refs: Column, lang: str) -> Column:
    """As citations.restore_citations, each citation fitted to what stands before it (he, ru)."""
    if lang == "he":
        col = F.regexp_replace(col, r"(?<![א-ת])(ו?[בכלמשה]|ו)\s+(?=[@＠]\s*\d+\s*[@＠])", "$1")
    fit = {"he": fit_hebrew_prefix, "ru": inflect_by_context}.get(lang, lambda before, rendered: rendered)
    index = lambda p: F.regexp_extract(p, r"(\d+)", 1).try_cast("int")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("odd"))

    def step(acc, p):
        put = F.when(acc["odd"], text.let(F.get(refs, index(p)), lambda ref: F.when(ref.isNotNull(), fit(acc["out"], ref)).otherwise(p))).otherwise(p)
        return F.struct(F.concat(acc["out"], put).alias("out"), (~acc["odd"]).alias("odd"))

    def restored(pieces):
        out = F.aggregate(pieces, start, step, lambda a: a["out"])
        seen = F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), index)
        lost = lambda known: F.filter(refs, lambda r, i: ~F.coalesce(F.array_contains(known, i), F.lit(False)))
        ended = lambda x: F.when(F.size(x["lost"]) > 0, F.concat(F.rtrim(x["out"]), F.lit(" "), F.array_join(x["lost"], " "))).otherwise(x["out"])
        return text.let(F.struct(out.alias("out"), text.let(seen, lost).alias("lost")), ended)

    return text.let(_alternating(col, PLACEHOLDER), restored)


def unprotect(source: Column, translated: Column, refs: Column, lang: str) -> Column:
    """A translated text (masked) with its last stop and its citations; `source` is the masked text it was made of."""
    return F.when(F.size(refs) > 0, restore_fitted(keep_final_stop(source, translated, lang), refs, lang)).otherwise(translated)


def route_for_model(df: DataFrame, col: str = "text", masked: str = "masked", refs: str = "refs") -> DataFrame:
    """df with route: blank, citation (nothing else in the text), or model."""
    route = F.when(F.coalesce(F.trim(col), F.lit("")) == "", "blank").when(is_only_citation(F.col(masked), F.col(refs)), "citation")
    return df.withColumn("route", F.coalesce(route, F.lit("model")))


def translate_segments(df: DataFrame, fn: Callable[[list[str]], list[str]], lang: str, names: str = "refs", col: str = "text", opened: str | None = None) -> DataFrame:
    """df (text, masked, refs from citations.mask_citations; any other columns stay, times among them) with route and translated.

    Blank texts stay as they are; a citation alone is put in by its name; the rest goes to the model with its citations
    masked and gets them back by `names` (a column of names in `lang`, in the order of refs). A row in, a row out.
    `opened` is a column of lines rendered already (opening_lines.set_apart): they stand before the translation, and
    where nothing else was said (route fixed) they are all of it.
    """
    routed = route_for_model(df, col)
    if opened:
        routed = routed.withColumn("route", F.when(F.col(opened).isNotNull() & (F.col("route") == "blank"), "fixed").otherwise(F.col("route")))
    routed = routed.withColumn("_row", F.when(F.col("route") == "model", F.trim(text.source_fixups(F.col("masked")))))
    done = apply_model(routed.where("route = 'model'"), fn, "_row", "_said")
    apart = routed.where("route <> 'model'").withColumn("_said", F.lit(None).cast("string"))
    back = F.when(F.col("route") == "blank", F.col(col)).when(F.col("route") == "citation", restore_fitted(F.col("masked"), F.col(names), lang)).otherwise(unprotect(F.col("masked"), F.col("_said"), F.col(names), lang))
    if opened:
        back = F.when(F.col("route") == "fixed", F.col(opened)).otherwise(F.concat(F.coalesce(F.col(opened), F.lit("")), back))
    return done.unionByName(apart).withColumn("translated", back).drop("_row", "_said")


def translate_sentences(df: DataFrame, fn: Callable[[list[str]], list[str]], lang: str, names: str = "refs", col: str = "text") -> DataFrame:
    """As translate_segments, blank lines left out."""
    return translate_segments(df.where(F.coalesce(F.trim(col), F.lit("")) != ""), fn, lang, names, col)
