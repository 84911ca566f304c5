"""Scripts with tags in brackets: runs of one style, cut into chunks, and what has to be said about the tags.

A document's pieces meet in windows by document. The tags are a relation of the user (token, kind, style): kinds are
`style`, `merged` (an old style, read as another), `alias` (a feeling, read as the nearest style) and `sound` (laugh,
cough: the speaking model's own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from .segmenting import pack_chunks

TAG = r"\[([A-Za-z][A-Za-z0-9_-]*)\]"


def style_tags(spark: SparkSession) -> DataFrame:
    """token, kind, style of the tags that are known without a user's own."""
    rows = [(t, "style", t) for t in rules.STYLES]
    for kind, table in (("merged", rules.MERGED_STYLES), ("alias", rules.STYLE_ALIASES)):
        rows += [(token, kind, style) for token, style in table.items()]
    rows += [(t, "sound", None) for t in rules.SOUND_TAGS]
    return spark.createDataFrame(rows, "token string, kind string, style string")


def resolve_style(df: DataFrame, tags: DataFrame, col: str = "style", default: str = rules.DEFAULT_STYLE) -> DataFrame:
    """df with resolved (a style; the default for null, blank and unknown names) and notice: merged, alias, unknown or null."""
    own = tags.where("kind <> 'sound'").select(F.col("token").alias("_token"), F.col("kind").alias("_kind"), F.col("style").alias("_style"))
    j = df.withColumn("_token", F.lower(F.trim(col))).join(own, "_token", "left")
    notice = F.when(F.col("_kind").isin("merged", "alias"), F.col("_kind")).when(F.col("_kind").isNull() & (F.coalesce("_token", F.lit("")) != ""), "unknown")
    return j.select(*df.columns, F.coalesce("_style", F.lit(default)).alias("resolved"), notice.alias("notice"))


def _pieces(df: DataFrame, tags: DataFrame, key: str, col: str) -> DataFrame:
    """key, at, piece, token (of a tag), kind, style for the texts cut around tags."""
    cut = F.split(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), TAG, text.MARK + "$0" + text.MARK), text.MARK, -1)
    each = df.select(key, F.posexplode(cut).alias("at", "piece"))
    token = F.when(F.col("at") % 2 == 1, F.lower(F.regexp_extract("piece", TAG, 1)))
    own = tags.dropDuplicates(["token"])
    known = each.where("at % 2 = 1").withColumn("token", token).join(own, "token", "left").select(key, "at", "piece", "token", F.coalesce("kind", F.lit("unknown")).alias("kind"), "style")
    return each.where("at % 2 = 0").selectExpr(f"`{key}`", "at", "piece", "CAST(NULL AS STRING) AS token", "CAST(NULL AS STRING) AS kind", "CAST(NULL AS STRING) AS style").unionByName(known)


def parse_tagged_script(df: DataFrame, tags: DataFrame, acts_on_sounds: bool = False, default: str = rules.DEFAULT_STYLE, budget: int | None = rules.CHUNK_BUDGET, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, chunk_id, text, style, starts_paragraph.

    A style holds until the next one, and begins a run. Tags of sounds go without a cut, unless the model acts on them;
    other brackets stay in the text. Runs are cut at blank lines and packed up to `budget` (None: a block is a chunk). A
    chunk starts a paragraph if a blank line, or nothing, came before it. Null and blank texts give no chunk; keys are
    unique.
    """
    pieces = _pieces(df, tags, key, col)
    styled = F.col("kind").isin("style", "merged", "alias")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = pieces.withColumns({"run": F.sum(F.when(styled, 1).otherwise(0)).over(w), "held": F.coalesce(F.last(F.when(styled, F.col("style")), ignorenulls=True).over(w), F.lit(default))})
    said = F.when(styled, "").when((F.col("kind") == "sound") & F.lit(not acts_on_sounds), "").otherwise(F.col("piece"))
    joined = runs.groupBy(key, "run", "held").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("s")))), lambda x: x["s"]), "").alias("body"))
    blocks = joined.select(key, "run", "held", F.posexplode(F.split("body", r"\n[ \t]*\n", -1)).alias("k", "block"))
    order = Window.partitionBy(key).orderBy("run", "k")
    broken = blocks.withColumn("breaks", F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = broken.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).where("block <> ''")
    before = F.lag("breaks").over(order)
    kept = kept.withColumns({"starts": before.isNull() | (F.col("breaks") > before), "at": F.row_number().over(order)})
    if budget is None:
        chunks = kept.select(key, "at", F.lit(0).alias("n"), F.col("block").alias("text"), F.col("held").alias("style"), F.col("starts").alias("starts_paragraph"))
    else:
        sentences = kept.select(F.struct(key, "at").alias("_block"), F.posexplode(text.sentences(F.col("block"))).alias("sent", "text"))
        packed = pack_chunks(sentences, budget, key="_block").select(F.col(f"_block.{key}").alias(key), F.col("_block.at").alias("at"), F.col("chunk_id").alias("n"), "text")
        chunks = packed.join(kept.select(key, "at", F.col("held").alias("style"), "starts"), [key, "at"]).withColumn("starts_paragraph", F.col("starts") & (F.col("n") == 0))
    number = F.row_number().over(Window.partitionBy(key).orderBy("at", "n")) - 1
    return chunks.select(key, number.alias("chunk_id"), "text", "style", "starts_paragraph")


def script_notices(df: DataFrame, tags: DataFrame, acts_on_sounds: bool = False, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, token, notice, style, times: once for each tag of a document that was read as another style (merged, alias), left out
    (removed) or left in the text (unknown)."""
    pieces = _pieces(df, tags, key, col).where("token IS NOT NULL")
    notice = F.when(F.col("kind").isin("merged", "alias", "unknown"), F.col("kind")).when((F.col("kind") == "sound") & F.lit(not acts_on_sounds), "removed")
    return pieces.withColumn("notice", notice).where("notice IS NOT NULL").groupBy(key, "token", "notice", "style").agg(F.count("*").alias("times"))
