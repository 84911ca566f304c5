"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lower-case runs of letters and digits. A fixed mask picks six of seven to nine neighbouring tokens, so a
hash survives substitutions at the ignored positions. Any 13 aligned tokens of which at most two differ hold a place
where one of the two masks meets no substitution (tests try them all). Hashes of benchmark items and documents meet
in an equality join; each hit fixes a diagonal, on which the item and the document are compared token by token.
A document is contaminated by an item if 13 neighbouring tokens of the diagonal hold at least 11 equal ones (shorter
items: all of their tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# Offsets that the masks keep.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8))
WINDOW = 13
EQUAL = 11
#: Most benchmark seeds (40 bytes each) that are sent to every executor; more meet the documents in a shuffle join.
BROADCAST_SEEDS = 400_000


def tokens(col: str) -> F.Column:
    return F.expr(rf"filter(split(lower(coalesce({col}, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')")


def seeds(rows: DataFrame, keys: list[str], masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """keys, pos, seed for every place of `t` (array of token hashes) where a mask fits."""
    out = None
    for number, mask in masks:
        shifted = [F.expr(f"slice(t, {o + 1}, greatest(size(t) - {mask[-1]}, 0))") for o in mask]
        fits = rows.where(F.size("t") > mask[-1])
        placed = fits.select(*keys, F.posexplode(F.arrays_zip(*[s.alias(f"h{i}") for i, s in enumerate(shifted)])).alias("pos", "z"))
        one = placed.select(*keys, "pos", F.xxhash64(F.lit(number), *[F.col("z").getField(f"h{i}") for i in range(len(mask))]).alias("seed"))
        out = one if out is None else out.unionByName(one)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_items, n_item, n_equal, best, share: one row for each document and class of equal items that it
    holds, named by the smallest item_id of the class.

    best: most equal tokens among 13 neighbours of a diagonal; n_equal: equal tokens on the best diagonal; share: of
    the item. Null and empty texts and items match nothing; rows with one doc_id are reported together, and rows with
    a null doc_id as one; a class of null item_ids has a null one; other columns are not read. Only texts with a hit
    move: the hits are written first, and their size decides how the texts meet them.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens("text").alias("ti")).where("size(ti) > 0")
    groups = items.groupBy("ti").agg(F.min(F.struct(F.xxhash64("ti"), F.coalesce("item_id", F.lit(-1)))).alias("g")).select("ti", F.xxhash64("g").alias("g"))
    groups = groups.withColumn("t", F.transform("ti", lambda w: F.xxhash64(w)))
    longest = max(m[-1] for m in MASKS) + 1
    short = [r.n for r in groups.where(F.size("ti") < longest).select(F.size("ti").alias("n")).distinct().collect()]  # below `longest`
    masks = list(enumerate(MASKS)) + [(100 + n, tuple(range(n))) for n in sorted(short)]
    of_items = seeds(groups, ["g"], masks[: len(MASKS)])
    for number, mask in masks[len(MASKS) :]:
        of_items = of_items.unionByName(seeds(groups.where(F.size("t") == len(mask)), ["g"], [(number, mask)]))
    of_items = of_items.select("g", F.col("pos").alias("ipos"), "seed").distinct()
    few = len(of_items.limit(BROADCAST_SEEDS + 1).select(F.lit(1)).agg(F.count("*").alias("n")).where(f"n > {BROADCAST_SEEDS}").take(1)) == 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    hashed = texts.select("doc_id", "th", F.transform(tokens("text"), lambda w: F.xxhash64(w)).alias("t"))
    of_docs = seeds(hashed, ["doc_id", "th"], masks)
    hits = of_docs.join(F.broadcast(of_items) if few else of_items, "seed").select("doc_id", "th", "g", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct()
    hits = stored(hits, "benchmark-hits")
    near = hits.join(groups.select("g", "t").withColumnRenamed("t", "ti"), "g").withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    met = texts.join(hits.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), same, "left_semi").distinct()
    met = met.select("doc_id", "th", F.transform(tokens("text"), lambda w: F.xxhash64(w)).alias("td"))
    found = near.join(met, same).select("doc_id", "g", "diagonal", "ti", "td")
    found = found.withColumn("low", F.expr("greatest(0, -diagonal)")).withColumn("n", F.expr("least(size(ti), size(td) - diagonal) - low")).where("n > 0")
    found = found.withColumn("eq", F.expr("zip_with(slice(ti, low + 1, n), slice(td, low + diagonal + 1, n), (x, y) -> if(x = y, 1, 0))"))
    found = found.withColumn("best", F.expr(f"array_max(transform(sequence(0, greatest(n - {WINDOW}, 0)), i -> aggregate(slice(eq, i + 1, {WINDOW}), 0, (s, x) -> s + x)))"))
    found = found.withColumn("n_equal", F.expr("aggregate(eq, 0, (s, x) -> s + x)")).withColumn("n_item", F.size("ti"))
    held = found.where(f"best >= {EQUAL} OR (n_item < {WINDOW} AND n_equal = n_item)").groupBy("doc_id", "g").agg(F.max(F.struct("best", "n_equal", "n_item")).alias("x"))
    named = items.join(groups.select("ti", "g"), "ti").groupBy("g").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    out = stored(held, "benchmark-found").join(named, "g")
    return out.select("doc_id", "item_id", "n_items", F.col("x.n_item").alias("n_item"), F.col("x.n_equal").alias("n_equal"), F.col("x.best").alias("best"), (F.col("x.n_equal") / F.col("x.n_item")).alias("share"))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id, class_id for every item with a token: the smallest item_id of the items with equal tokens."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(tokens("text")).alias("g"), tokens("text").alias("ti")).where("size(ti) > 0")
    return items.join(items.groupBy("g", "ti").agg(F.min("item_id").alias("class_id")), ["g", "ti"]).select("item_id", "class_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `df` that hold no benchmark item, all columns; rows without doc_id are judged together."""
    gone = stored(contamination(df, benchmark).select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    return df.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
