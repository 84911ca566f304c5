"""Personal data by weak supervision, in DataFrame functions only.

Patterns find candidate spans: the four base kinds, and account numbers, secrets and names with a title. Five labelers
(strict shape, gazetteer, words of the context for and against, borders of the span) vote for, against or abstain.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each
pattern is personal data; a logistic span classifier is trained on those likelihoods from votes, kind, length and
digits. Base spans are always kept; the classifier decides on the others.

The pattern counts (at most kinds x 3^5 x lengths rows, whatever the input) are all that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret", "name")
KINDS = BASE + ADDED
ROUNDS = 50
PRIOR = 0.5
CUT = 0.5
AROUND = 32

# Patterns of the kinds. A start is only tried at the beginning of a run or where the last match ended,
# which finds the same matches without rescanning long runs.
_RUN = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "digits": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{20,}+",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
# Gazetteers and words of the context.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?)$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){0,4}$",
    "account": r"^(?:[0-9]{9,19}|[0-9]{2,6}(?:[ -][0-9]{2,6}){2,5})$",
    "secret": r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16,})$",
    "name": r"^\S+ \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?$",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|us|ca)$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "account": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "secret": r"^(?:sk|pk|ghp|AKIA|xox|eyJ)",
    "name": r" (?:James|John|Mary|Robert|Anna|Maria|Peter|Paul|Hans|Jean|Pierre|Jose|Juan|Carlos|Müller|Schmidt|Smith|Garcia|Martin)\b",
}
FOR = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|from|to)\W*$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|from)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|account|karte|tarjeta|carte)\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|telefon|teléfono|téléphone)\W*$",
    "account": r"(?i)(?:account|iban|ssn|passport|card|konto|cuenta|compte|customer)\W*(?:no|number)?\W*$",
    "secret": r"(?i)(?:token|key|secret|password|passwd|pwd|bearer|apikey)\s*[=:]?\s*[\"']?$",
    "name": r"(?i)(?:dear|contact|signed|patient|sincerely|by)\W*$",
}
AGAINST = r"(?i)(?:version|section|chapter|page|figure|table|isbn|\bv|§|\$|€|£|#)\s*$"


BLOCK = 128  # elements that a scan appends one by one before it joins them to the rest


def _scanned(items: Column, state: Column, step, emit, kind: str) -> Column:
    """The array of emit(state, x) over `items` in order, where step(state, x) is the next state; `kind` is the type of
    the elements. An append copies its array, so elements are gathered in blocks first."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    one = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], emit(acc["at"], x)).alias("out"))

    def many(acc, block):
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(block, start, one, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

    def walked(every):
        blocks = F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(BLOCK)), lambda k: F.slice(every, k + 1, F.lit(BLOCK)))
        return F.when(F.size(every) > 0, F.aggregate(blocks, F.struct(state.alias("at"), none.alias("out")), many, lambda a: a["out"])).otherwise(none)

    return _bound(items, walked)


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


MATCH = "start int, stop int, s string, before string, after string"


def _matches(text: str, pattern: str) -> Column:
    """Matches of a pattern as an array of (start, stop, s, before, after), in code points; before: up to AROUND
    characters of what stands between the match and the one before it, and of that one."""
    p, kind = F.lit(pattern), f"struct<{MATCH.replace(' ', ':').replace(',:', ',')}>"
    ends = lambda at, x: at + F.length(x["gap"]) + F.length(x["s"])

    def emit(at, x):
        before, after = F.right(F.concat(x["last"], x["gap"]), F.lit(AROUND)), F.left(F.concat(x["behind"], x["next"]), F.lit(1))
        return F.struct((at + F.length(x["gap"])).alias("start"), ends(at, x).alias("stop"), x["s"].alias("s"), before.alias("before"), after.alias("after"))

    def walked(x):
        found, between, n, blank = x["found"], x["between"], F.size(x["found"]), F.array(F.lit(""))
        last, following = F.concat(blank, F.slice(found, 1, n - 1)), F.concat(F.slice(found, 2, n), blank)
        zipped = F.arrays_zip(F.slice(between, 1, n).alias("gap"), found.alias("s"), last.alias("last"), F.slice(between, 2, n).alias("behind"), following.alias("next"))
        return _scanned(zipped, F.lit(0), ends, emit, kind)

    both = F.struct(F.regexp_extract_all(F.col(text), p, F.lit(0)).alias("found"), F.split(F.col(text), pattern, -1).alias("between"))
    return F.when(F.regexp_like(F.col(text), p), _bound(both, walked)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def _luhn(digits: Column) -> Column:
    chars = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def candidates(df: DataFrame) -> DataFrame:
    """`df` with `_text` (null: empty), `_base` and `_more`: arrays of (kind number, start, stop, s), in kind order."""
    df = df.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    numbers = {k: i for i, k in enumerate(KINDS)}
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    small = lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255)
    df = df.withColumns({
        "_email": F.when(F.contains("_text", F.lit("@")), _matches("_text", PATTERNS["email"])),
        "_ip": _matches("_text", PATTERNS["ip"]),
        "_digits": F.filter(_matches("_text", PATTERNS["digits"]), lambda x: F.length(digits(x["s"])).between(9, 19)),
        "_phone": F.when(F.contains("_text", F.lit("+")), _matches("_text", PATTERNS["phone"])),
        "_secret": F.filter(_matches("_text", PATTERNS["secret"]), lambda x: F.regexp_like(x["s"], F.lit("[0-9]")) & F.regexp_like(x["s"], F.lit("[A-Za-z]"))),
        "_name": _matches("_text", PATTERNS["name"]),
    })
    is_card = lambda x: F.length(digits(x["s"])).between(16, 19) & _luhn(digits(x["s"]))
    kinds = {
        "email": F.col("_email"),
        "ip": F.filter("_ip", lambda x: F.forall(F.split(x["s"], r"\."), small)),
        "card": F.filter("_digits", is_card),
        "phone": F.filter("_phone", lambda x: F.length(digits(x["s"])).between(8, 15)),
        "account": F.filter("_digits", lambda x: ~is_card(x)),
        "secret": F.col("_secret"),
        "name": F.col("_name"),
    }
    span = f"struct<kind:int,{MATCH.replace(' ', ':').replace(',:', ',')}>"
    none = F.expr(f"cast(array() as array<{span}>)")
    tagged = lambda k: F.coalesce(F.transform(kinds[k], lambda x: F.struct(F.lit(numbers[k]).alias("kind"), *[x[c].alias(c) for c in ("start", "stop", "s", "before", "after")])), none)
    df = df.withColumn("_base", F.concat(*[tagged(k) for k in BASE])).withColumn("_more", F.concat(*[tagged(k) for k in ADDED]))
    ahead, back, free = _clear(span)
    both = (F.size("_more") > 0) & (F.size("_base") > 0)
    df = df.withColumn("_walk", F.when(both, ahead)).withColumn("_walk", F.when(both, back)).withColumn("_more", F.when(both, free).otherwise(F.col("_more")))
    return df.drop("_email", "_ip", "_digits", "_phone", "_secret", "_name", "_walk")


def _clear(span: str) -> tuple[Column, Column, Column]:
    """The spans of `_more` that overlap none of `_base`, in three steps over `_walk`: a walk in order of the starts that
    knows how far base spans reached so far, one back that knows where the next one begins, and what neither hit."""
    base = len(BASE)
    every = F.transform(F.concat("_base", "_more"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x.alias("x"), F.lit(False).alias("hit")))
    kind = f"struct<start:int,kind:int,x:{span},hit:boolean>"
    marked = lambda y, hit: F.struct(y["start"].alias("start"), y["kind"].alias("kind"), y["x"].alias("x"), (y["hit"] | hit).alias("hit"))
    ahead = _scanned(F.array_sort(every), F.lit(-1), lambda at, y: F.when(y["kind"] < base, F.greatest(at, y["x"]["stop"])).otherwise(at), lambda at, y: marked(y, at > y["start"]), kind)
    back = _scanned(F.reverse(F.col("_walk")), F.lit(2**31 - 1), lambda at, y: F.when(y["kind"] < base, y["start"]).otherwise(at), lambda at, y: marked(y, at < y["x"]["stop"]), kind)
    free = F.transform(F.filter("_walk", lambda y: (y["kind"] >= base) & ~y["hit"]), lambda y: y["x"])
    return ahead, back, F.array_sort(free)


def _by_kind(x: Column, patterns: dict[str, str], on: Column) -> Column:
    out = None
    for i, k in enumerate(KINDS):
        test = F.regexp_like(on, F.lit(patterns[k]))
        out = F.when(x["kind"] == i, test) if out is None else out.when(x["kind"] == i, test)
    return out


def signs(x: Column) -> Column:
    """The votes (1, 0, -1 abstains) and shape of a span, as one small number in base 3 digits and a length class."""
    before, edges = x["before"], F.concat(F.right(x["before"], F.lit(1)), F.lit("|"), x["after"])
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    strict = _by_kind(x, STRICT, x["s"])
    known = _by_kind(x, GAZETTEER, x["s"])
    cue, odd = _by_kind(x, FOR, before), F.regexp_like(before, F.lit(AGAINST))
    apart = F.regexp_like(edges, F.lit(r"^[\s\"'(<\[:;=,.]?\|[\s\"')>\],.;:!?]?$"))
    votes = (vote(strict, ~strict), vote(known, F.lit(False)), vote(cue, F.lit(False)), vote(F.lit(False), odd), vote(apart, ~apart))
    size = F.when(F.length(x["s"]) < 12, 0).when(F.length(x["s"]) < 20, 1).when(F.length(x["s"]) < 36, 2).otherwise(3)
    code = x["kind"]
    for v in votes:
        code = code * 3 + v + 1
    return code * 4 + size


def decode(code: int) -> tuple[int, tuple[int, ...], int]:
    """kind, votes, length class."""
    size, code, votes = code % 4, code // 4, []
    for _ in range(5):
        votes.append(code % 3 - 1)
        code //= 3
    return code, tuple(reversed(votes)), size


def estimate(counts: dict[int, int]) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """Expectation-maximisation: the likelihood of personal data for each code, and each labeler's rates of voting for
    among spans that are and that are not. Codes of base kinds and others share the labelers."""
    rates = [(0.8, 0.3)] * 5
    share = {k: PRIOR for k in range(len(KINDS))}
    belief: dict[int, float] = {}
    for _ in range(ROUNDS):
        for code in counts:
            kind, votes, _ = decode(code)
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for v, (a, b) in zip(votes, rates):
                if v >= 0:
                    yes += math.log(a if v else 1 - a)
                    no += math.log(b if v else 1 - b)
            belief[code] = 1 / (1 + math.exp(min(700, max(-700, no - yes))))
        for kind in share:
            own = [(n, belief[c]) for c, n in counts.items() if decode(c)[0] == kind]
            share[kind] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        new = []
        for i in range(5):
            cells = [[1.6, 0.4], [0.6, 1.4]]  # pseudo-counts: labelers are better than chance
            for c, n in counts.items():
                v = decode(c)[1][i]
                if v >= 0:
                    cells[0][1 - v] += n * belief[c]
                    cells[1][1 - v] += n * (1 - belief[c])
            new.append((cells[0][0] / sum(cells[0]), cells[1][0] / sum(cells[1])))
        rates = [(min(0.99, max(0.01, a)), min(0.99, max(0.01, b))) for a, b in new]
    return belief, rates


def features(code: int) -> list[float]:
    kind, votes, size = decode(code)
    out = [1.0] + [float(kind == k) for k in range(len(KINDS))] + [float(size == s) for s in range(4)]
    for v in votes:
        out += [float(v == 1), float(v == 0)]
    return out


def span_classifier(counts: dict[int, int]) -> dict[int, float]:
    """Score of every code: logistic regression on the estimated likelihoods, weighted by counts."""
    belief, _ = estimate(counts)
    rows = [(features(c), belief[c], n) for c, n in sorted(counts.items())]
    if not rows:
        return {}
    total, w = sum(n for *_, n in rows), [0.0] * len(rows[0][0])
    for _ in range(400):
        grad = [1e-3 * x for x in w]
        for f, p, n in rows:
            d = (1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(f, w)))))) - p) * n / total
            for i, a in enumerate(f):
                if a:
                    grad[i] += d * a
        w = [x - 2.0 * g for x, g in zip(w, grad)]
    return {c: 1 / (1 + math.exp(-sum(a * b for a, b in zip(features(c), w)))) for c in counts}


def personal_spans(df: DataFrame) -> DataFrame:
    """`df` with `_text`, `_base` and `_added`: base spans, and the candidates that the classifier takes (score over
    CUT). Null and empty texts have no spans; repeated rows are searched each; an empty table gives no rows. Two passes
    over the scan (one counts vote patterns), no shuffle of texts."""
    found = candidates(df)
    every = found.select("_text", F.explode(F.concat("_base", "_more")).alias("x")).select(signs(F.col("x")).alias("code"))
    counts = {r.code: r.n for r in every.groupBy("code").agg(F.count("*").alias("n")).collect()}  # bounded by the codes
    taken = sorted(c for c, p in span_classifier(counts).items() if p > CUT)
    if not taken:
        return found.withColumn("_added", F.filter("_more", lambda x: F.lit(False))).drop("_more")
    return found.withColumn("_added", F.filter("_more", lambda x: signs(x).isin(taken))).drop("_more")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = personal_spans(docs)
    number = lambda i: F.size(F.filter("_base", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("_base", "_added")).alias("spans"))


def masked(df: DataFrame) -> DataFrame:
    """The rows of `df`, all columns, with every span of `text` replaced by its kind in angle brackets; overlapping
    spans are replaced together, under the kind of the first. A null text stays null; n_chars, where the table has
    it, follows the new text."""
    found = personal_spans(df)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.array_sort(F.transform(F.concat("_base", "_added"), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    # what is kept before each span: from the furthest end so far to its start (null where it begins before that end)
    reach = lambda at, x: F.greatest(at, x["stop"])
    parts = _scanned(spans, F.lit(0), reach, lambda at, x: F.struct(at.alias("from"), x["start"].alias("to"), x["kind"].alias("kind")), "struct<from:int,to:int,kind:int>")
    found = found.withColumn("_parts", F.filter(parts, lambda x: x["from"] <= x["to"])).withColumn("_end", F.array_max(F.transform(spans, lambda x: x["stop"])))
    # a substring counts from the beginning of its string, so each block of spans has its own
    blocks = F.transform(F.sequence(F.lit(0), F.size("_parts") - 1, F.lit(BLOCK)), lambda k: F.slice("_parts", k + 1, F.lit(BLOCK)))

    def rendered(block):
        low, high = F.element_at(block, 1)["from"], F.element_at(block, -1)["to"]
        own = F.struct(F.substring(F.col("_text"), low + 1, high - low).alias("text"), low.alias("low"), block.alias("block"))
        return F.array_join(F.flatten(F.transform(F.array(own), lambda o: F.transform(o["block"], lambda x: F.concat(F.substring(o["text"], x["from"] - o["low"] + 1, x["to"] - x["from"]), F.element_at(names, x["kind"] + 1))))), "")

    text = F.concat(F.array_join(F.transform(blocks, rendered), ""), F.substring(F.col("_text"), F.col("_end") + 1, F.length("_text")))
    changed = found.withColumn("text", F.when(F.col("text").isNull() | F.col("_end").isNull(), F.col("text").cast("string")).otherwise(text))
    if "n_chars" in df.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(df.schema["n_chars"].dataType), F.col("n_chars")))
    return changed.select(*[f"`{c}`" for c in df.columns])
