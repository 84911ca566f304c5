"""Two token sequences of a document beside each other: matching blocks, what lies between them, times and error rates.

The blocks are the longest common runs, found first in the whole, then to the left and right of each one; they are those
of an exact search (`blocks.py`, for many pairs at once). A pair is matched within its row, so matching needs no exchange.
A null sequence is an empty one; rows with equal keys get their blocks each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .blocks import blocks_of
from .repair import forward_order


def _as_list(offsets, **columns) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))


def _matched():
    @F.arrow_udf("array<struct<i:int,j:int,size:int>>")
    def matched(a: pa.Array, b: pa.Array) -> pa.Array:
        offsets, i, j, n = blocks_of(a, b)
        return _as_list(offsets, i=i.astype(np.int32), j=j.astype(np.int32), size=n.astype(np.int32))

    return matched


def matching_blocks(df: DataFrame, a: str = "ref", b: str = "hyp") -> DataFrame:
    """df with `blocks` of (i, j, size): tokens i.. of array a equal tokens j.. of array b; the last is (ends, 0)."""
    empty = F.array().cast("array<string>")
    whole = df.withColumns({c: F.coalesce(F.col(c), empty) for c in (a, b)})
    return whole.withColumn("blocks", _matched()(a, b))


def _part(c, first, size):
    """`size` items of an array from `first` (counted from 0) on, in time linear in them."""
    return F.when(size > 0, F.transform(F.sequence(first, first + size - 1), lambda p: F.get(c, p))).otherwise(F.array())


def _between(blocks):
    """The parts (i1, i2, j1, j2) before each block."""
    before = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("size"))), blocks)
    return F.zip_with(F.slice(before, 1, F.size(blocks)), blocks, lambda p, q: F.struct((p["i"] + p["size"]).alias("i1"), q["i"].alias("i2"), (p["j"] + p["size"]).alias("j1"), q["j"].alias("j2")))


def edit_regions(df: DataFrame, a: str = "ref", b: str = "hyp", key: str = "id", sep: str = " ") -> DataFrame:
    """key, kind (equal, delete, insert, replace), i1, i2, j1, j2, spoken, heard for every run of each pair, in order."""
    m = matching_blocks(df, a, b)
    same = F.transform("blocks", lambda x: F.struct(x["i"].alias("i1"), (x["i"] + x["size"]).alias("i2"), x["j"].alias("j1"), (x["j"] + x["size"]).alias("j2"), F.lit(True).alias("same")))
    other = F.transform(_between(F.col("blocks")), lambda x: F.struct(*[x[n].alias(n) for n in ("i1", "i2", "j1", "j2")], F.lit(False).alias("same")))
    runs = F.filter(F.concat(same, other), lambda x: (x["i2"] > x["i1"]) | (x["j2"] > x["j1"]))
    part = lambda c, i, j: F.array_join(_part(c, i, j - i), sep)
    told = F.transform(F.array_sort(runs), lambda x: F.struct(*[x[n].alias(n) for n in ("i1", "i2", "j1", "j2", "same")], part(a, x["i1"], x["i2"]).alias("spoken"), part(b, x["j1"], x["j2"]).alias("heard")))
    kind = F.when(F.col("same"), "equal").when(F.col("j1") == F.col("j2"), "delete").when(F.col("i1") == F.col("i2"), "insert").otherwise("replace")
    # the parts are cut within the row: only they are repeated, not the sequences
    return m.select(key, F.explode(told).alias("r")).select(key, "r.*").select(key, kind.alias("kind"), "i1", "i2", "j1", "j2", "spoken", "heard")


def error_rate(df: DataFrame, lost_at: int | Column = 8, a: str = "ref", b: str = "hyp", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, edits, n, rate, lost: the longer side of every run that differs over the tokens of the reference, and the
    tokens in runs of `lost_at` or more that are left out; rows without a key are totals over it (a rollup)."""
    parts = _between(F.col("blocks"))
    longer = F.transform(parts, lambda x: F.greatest(x["i2"] - x["i1"], x["j2"] - x["j1"]))
    gone = F.transform(parts, lambda x: F.when((x["j2"] == x["j1"]) & (x["i2"] - x["i1"] >= lost_at), x["i2"] - x["i1"]).otherwise(0))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    rows = matching_blocks(df, a, b).select(*keys, total(longer).alias("edits"), F.size(a).alias("n"), total(gone).alias("lost"))
    sums = rows.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("edits", "n", "lost")])
    return sums.select(*keys, "edits", "n", (F.col("edits") / F.nullif("n", F.lit(0))).alias("rate"), "lost")


def _times():
    @F.arrow_udf("array<struct<start:double,end:double,matched:bigint>>")
    def times(told: pa.Array, sizes: pa.Array, said: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        offsets, i, j, n = blocks_of(told, said)
        rows, chunks, words = len(told), sizes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(said.value_lengths().to_numpy())))
        each = sizes.value_lengths().to_numpy()
        row = np.repeat(np.arange(rows), np.diff(offsets))
        first = np.concatenate(([0], np.cumsum(told.value_lengths().to_numpy())))
        ends = np.cumsum(chunks)  # of chunks, in tokens through all rows
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = (np.repeat(x[row] + y, n) + step for x, y in ((first, i), (words, j)))
        begun, over = (x.flatten().to_numpy(zero_copy_only=False)[j] for x in (start, end))
        timed = ~(np.isnan(begun) | np.isnan(over))  # nulls are not a number here
        chunk, begun, over = np.searchsorted(ends, i[timed], "right"), begun[timed], over[timed]
        count = np.bincount(chunk, minlength=len(chunks))
        low, high = np.full(len(chunks), np.inf), np.full(len(chunks), -np.inf)
        np.minimum.at(low, chunk, begun)
        np.maximum.at(high, chunk, over)
        none = count == 0
        at = np.concatenate(([0], np.cumsum(each)))
        return _as_list(at, start=pa.array(low, mask=none), end=pa.array(np.maximum(low, high), mask=none), matched=count)

    return times


def align_listed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_id, text, start, end, matched of rows (key, told: array of chunk_id, text, words; said: array of word,
    start, end; both in order, words normalised): as align_text_to_words, whose table forms it takes listed."""
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    words = F.transform("told", lambda x: none(x["words"], "string"))
    sizes = none(F.transform(words, lambda w: F.size(w).cast("long")), "long")
    side = lambda c: none(F.col(f"said.{c}").cast("array<double>"), "double")
    timed = df.withColumn("_t", _times()(none(F.flatten(words), "string"), sizes, none(F.col("said.word"), "string"), side("start"), side("end")))
    each = F.zip_with("told", "_t", lambda x, t: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), t["matched"].alias("matched")))
    ordered = forward_order(timed.select(key, F.explode(each).alias("x")).select(key, "x.*"))
    return ordered.withColumn("matched", F.when(F.col("start").isNull(), 0).otherwise(F.col("matched")))


def align_text_to_words(chunks: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_id, text, start, end, matched of chunks (text, words: normalised tokens) against timed words (pos,
    word, start, end): the earliest start and latest end of the words that match, null for chunks that match none or
    would go backwards. Spoken words without times match but do not count."""
    told = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text", "words"))).alias("told"))
    said = words.select(key, F.struct("pos", text.normalise_token(F.col("word")).alias("word"), "start", "end").alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("said"))
    return align_listed(told.join(said, key, "left"), key)
