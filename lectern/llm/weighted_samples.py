"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its white-space words, each named by its 64-bit hash; the weight of a term with frequency f is 1+ln f.
For each of SAMPLES samples a term gets r and c from a Gamma(2, 1) and beta from a uniform distribution, all fixed by
(term, sample). With t = floor(ln w / r + beta), the sample picks the term with the smallest
ln c - r (t - beta) - r; two documents pick the same (term, t) with probability sum(min w) / sum(max w), the
generalised Jaccard similarity. That smallest value names (term, t), so it is what the fingerprint keeps (16 bits of
its hash per sample), and the likeness of two fingerprints is their share of equal places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, tasks_for

SAMPLES = 64
PLACE = 4  # hexadecimal digits of one sample
TOGETHER = 4  # samples computed in one row
NO_ID = -(2**63)


def _value(sample: str, lw: str) -> str:
    """What the sample of number `sample` compares for a term (h: its hash, lw: logarithm of its weight). Two hashes
    give five uniform draws of 21 bits."""

    def uniform(of: str, shift: int) -> str:
        return f"(((shiftrightunsigned({of}, {shift}) & 2097151L) + 0.5D) / 2097152)"

    x = f"xxhash64(h, {sample})"
    y = f"xxhash64({x})"
    minus_r = f"ln({uniform(x, 0)} * {uniform(x, 21)})"
    c = f"ln(-ln({uniform(y, 0)} * {uniform(y, 21)}))"
    beta = uniform(x, 42)
    return f"{c} + {minus_r} * (if({lw} = 0, 1D, floor({beta} - {lw} / {minus_r}) + 1D) - {beta})"  # t is 0 at weight 1


def fingerprints(texts: DataFrame, keys: list[str], versions: int = 1, samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint0, fingerprint1 .. of every row group of (keys, v: version, text); keys[0] must already deal the
    rows out, then nothing is shuffled. The draws of a term serve all versions.

    A text without words has one empty word; null is treated as empty; rows with the same keys and v must not differ;
    a version without a row has a null fingerprint. `samples` must be a multiple of TOGETHER.
    """
    words = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    terms = texts.select(*keys, "v", F.explode(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))).alias("w")).select(*keys, "v", F.xxhash64("w").alias("h"))
    counted = terms.groupBy(*keys, "h").agg(*[F.expr(f"log1p(ln(nullif(cast(count_if(v = {v}) as double), 0)))").alias(f"lw{v}") for v in range(versions)])
    # a few samples in each row keep the generated code small enough to be compiled to machine code
    dealt = counted.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(samples // TOGETHER)])))
    least = [F.expr(f"min({_value(f'part * {TOGETHER} + {i}', f'lw{v}')})").alias(f"m{v}_{i}") for v in range(versions) for i in range(TOGETHER)]
    place = lambda v, i: F.lpad(F.lower(F.hex(F.expr(f"pmod(xxhash64(round(m{v}_{i}, 6), part * {TOGETHER} + {i}), 65536)"))), PLACE, "0")
    parts = dealt.groupBy(*keys, "part").agg(*least).select(*keys, "part", *[F.when(F.col(f"m{v}_0").isNotNull(), F.concat(*[place(v, i) for i in range(TOGETHER)])).alias(f"p{v}") for v in range(versions)])
    ordered = F.sort_array(F.collect_list(F.struct("part", *[f"p{v}" for v in range(versions)])))
    joined = [F.when(F.col("parts")[0][f"p{v}"].isNotNull(), F.array_join(F.col("parts")[f"p{v}"], "")).alias(f"fingerprint{v}") for v in range(versions)]
    return parts.groupBy(*keys).agg(ordered.alias("parts")).select(*keys, *joined)


def likeness(a: str, b: str, samples: int = SAMPLES) -> F.Column:
    """Share of equal places of two fingerprint columns."""
    return F.expr(f"size(filter(sequence(0, {samples - 1}), k -> substring({a}, k * {PLACE} + 1, {PLACE}) = substring({b}, k * {PLACE} + 1, {PLACE}))) / {float(samples)}D")


def _order(rows: DataFrame, tasks: int) -> DataFrame:
    """id, first_th (its first text), next, above (the id whose next it is), above_n (that one's longest text): the
    order of the ids, found range by range. Only one row for each range meets in one place."""
    ids = rows.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("first_th"))
    ranged = stored(ids.repartitionByRange(tasks, "id").withColumn("range", F.spark_partition_id()), "document-order")
    ends = ranged.groupBy("range").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high"))
    up = Window.orderBy("range")
    whole = ends.agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    edges = ends.withColumns({"down": F.lag("high").over(up), "up": F.lead("low").over(up)}).crossJoin(F.broadcast(whole))
    edges = edges.select("range", F.coalesce("down", "top").alias("down"), F.coalesce("up", "bottom").alias("up"))
    inside = Window.partitionBy("range").orderBy("id")
    placed = ranged.withColumns({"below": F.lag("id").over(inside), "above": F.lead(F.struct("id", "n")).over(inside)}).join(F.broadcast(edges), "range")
    above = F.coalesce("above", "up")
    return placed.select("id", "first_th", F.coalesce("below", "down").alias("next"), above["id"].alias("above"), above["n"].alias("above_n"))


def weighted_fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the one with the next smaller doc_id, after the smallest the largest (a lone document is its
    own next). Null texts are empty; a null doc_id stands below all others; of several rows with one doc_id each keeps
    its row, and the one with the smallest text hash is the neighbour of others; other columns are not read; an empty
    table gives no rows. The texts cross one exchange; beginnings that go to a neighbour a second.
    """
    tasks = tasks_for(df, 2 << 20)
    raw = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = _order(raw, max(2, tasks // 16))
    rows = raw.repartition(tasks, "id").groupBy("id", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"th": F.xxhash64("text"), "n": F.length("text")}).join(order.hint("shuffle_hash"), "id")
    # a document's beginning goes to the one above it, whose `next` it is
    # (an equality would become a join key and deal the texts out anew)
    giving = rows.where("(th ^ first_th) = 0").select(F.col("above").alias("id"), F.expr("substring(text, 1, cast(above_n / 3 as int))").alias("head"))
    joined = rows.select("id", "th", "copies", "n", "next", "first_th", "text").join(giving.repartition(tasks, "id").hint("shuffle_hash"), "id")
    edited = joined.withColumn("edited", F.expr("concat(substring(text, 1, n - cast(n div 3 as int)), substring(head, 1, cast(n div 3 as int)))"))
    both = edited.select("id", "th", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("text")))).alias("x")).select("id", "th", F.col("x.v").alias("v"), F.col("x.text").alias("text"))
    pair = fingerprints(both, ["id", "th"], versions=2).withColumnsRenamed({"fingerprint0": "fingerprint", "fingerprint1": "edited_fingerprint"})
    facts = edited.select("id", "th", "copies", "n", "next", "first_th", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    met = facts.join(pair.withColumnRenamed("th", "pair_th"), "id").where("(th ^ pair_th) = 0").drop("pair_th")
    kept = stored(met, "fingerprints")
    after = kept.where("th = first_th").select(F.col("id").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    out = kept.join(after, "next").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op2_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints(table(spark, sf_dir, "documents"))
