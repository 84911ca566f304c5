"""Near-duplicate documents by SimHash, linked through deletion-variant signatures.

Two fingerprints that differ in at most two bits are cut into two segments of 32 bits, so one segment differs by at
most one bit. Every fingerprint is indexed under each segment with one position left out (64 keys); fingerprints that
share a key are candidates and are verified on all 64 bits. Copies are folded into one fingerprint first.

A key that more than GROUP fingerprints share is not paired up: its fingerprints are linked through the values at one
bit's distance. Two fingerprints are at most two bits apart exactly if some value is at most one bit from both, so a
star around the smallest document of each such value gives the same components, in 65 rows for each fingerprint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, tasks_for, whole_texts
from .components import connected_components
from .pieces import text_slices

WORDS = 3
DISTANCE = 2
GROUP = 8


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text one after the other, and where each text begins: ASCII lower case,
    white-space words; a shorter text is one shingle, a blank one none."""
    from xxhash import xxh64_intdigest

    hashes, starts = [], []
    for text in texts:
        w = text.encode("utf-8").lower().split()
        starts.append(len(hashes))
        if len(w) < words:
            w, n = [b" ".join(w)] if w else [], 1
        else:
            n = words
        hashes += [xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(w[i:] for i in range(n))))]
    return np.array(hashes, np.uint64), np.array(starts, np.int64)


def fingerprints_of(texts: list[str], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; repeated shingles are counted."""
    return folded(*shingle_hashes(texts, words))


def folded(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 64 majority bits of each run of hashes; of an empty run 0."""
    out = np.zeros(len(starts), np.uint64)
    if not len(hashes):
        return out
    sizes = np.diff(np.append(starts, len(hashes)))
    filled = np.flatnonzero(sizes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts[filled], axis=0, dtype=np.int32)
    out[filled] = np.packbits(2 * counts > sizes[filled, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def simhash(df: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every (doc_id, text); null, empty and blank texts: 0. No shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, texts in text_slices(batch, 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingerprints_of(texts).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return whole_texts(df).mapInArrow(run, "doc_id long, fp long")


def near_links(reps: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the `rep` ids of (fp, rep), fp unique: their components are those of all pairs of
    fingerprints within two bits."""
    half = lambda s: F.expr(f"shiftrightunsigned(fp, {32 * s}) & 4294967295")
    keys = lambda s: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half(s).bitwiseAND(F.lit(-1).cast("long").bitwiseXOR(F.pow(F.lit(2), i).cast("long"))) + (i.cast("long") + 32 * s) * F.lit(1 << 32))
    indexed = reps.select("fp", "rep", F.explode(F.concat(keys(0), keys(1))).alias("key"))
    shared = indexed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    shared = checkpointed(shared)
    few = shared.where(F.col("n") <= group)
    pairs = few.alias("x").join(few.alias("y"), F.col("x.key") == F.col("y.key")).where("x.fp < y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE)
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    many = shared.where(F.col("n") > group).groupBy("fp").agg(F.min("rep").alias("rep"))
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    points = many.select("rep", F.explode(around).alias("point"))
    centres = points.groupBy("point").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    stars = points.join(centres, "point").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    return pairs.unionByName(stars)


def simhash_groups(df: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every (doc_id, text).

    Null, empty and blank texts have fingerprint 0 and are linked like any other; equal doc_ids keep a row each; rows
    with a null doc_id are their own group unless a numbered document shares it (component null otherwise); an empty
    table gives no rows; other columns are not read.
    """
    prints = checkpointed(simhash(df))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = checkpointed(reps.where("rep IS NOT NULL").repartition(tasks_for(df), "fp"))
    linked = connected_components(near_links(reps)).withColumnRenamed("node", "rep")
    named = reps.join(linked, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
