"""Documents linked by the Jaccard similarity of their sets of 3-word shingles (0.9 or more), and their components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole_texts
from .components import connected_components
from .set_join import CELL, GROUP, ROUNDS, set_links, set_marks

WORDS = 3
Q = 19  # (19 - 1) / (19 + 1) = 0.9


def shingle_components(df: DataFrame, words: int = WORDS, q: int = Q, group: int = GROUP, rounds: int = ROUNDS, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id for every (doc_id, text).

    Texts of fewer words are one shingle; null, empty and blank texts have none and are linked with nothing, so that
    they are their own component. Equal doc_ids keep a row each. Rows without doc_id link like others, but name no
    component (null if no numbered document is reachable). An empty table gives no rows; other columns are not read.
    """
    docs = whole_texts(df).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("id"))
    named = docs.select(F.col("id").alias("doc_id"), "text")
    marks = stored(set_marks(named, words), "marks")
    own = marks.where("name IS NULL").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n", "node")
    linked = connected_components(set_links(named, marks, words, q, group, rounds, cell))
    placed = docs.select("doc_id", "id").join(own, "id").join(linked, "node", "left").select("doc_id", "n", "node", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "placed")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return placed.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' 3-word shingle sets joined at 0.9: doc_id, n_shingles, component_id."""
    return shingle_components(table(spark, sf_dir, "documents"))
