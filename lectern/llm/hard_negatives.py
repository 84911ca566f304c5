"""Hard negatives by vertical scans: every anchor reads the dimensions in which it is large first.

The vectors lie in blocks, a column for each dimension. For an anchor q the scores of a block's rows grow dimension by
dimension in descending order of |q|; what the remaining dimensions can add lies between the sums of their least and
largest contributions (from the block's minimum and maximum of each). Rows whose bounds show that they cannot be
returned leave the candidate bitmap; the others have their scores whole when the dimensions end.

Two scans: the first finds the best rows of the anchor's label (positives); their scores open windows, and the second
finds the best rows of other labels in each window. Blocks hold a bounded number of rows, groups of anchors too; every group meets
every block once, dealt out by the pair's numbers, and what a block returns for an anchor is a few rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
EVERY = 50  # anchors: ids divisible by this
ANCHORS = 16384  # of a group
ROWS = (1024, 16384)  # of a block, least and most
MOST_TASKS = 50_000
STEP = 8  # dimensions between two looks at the bounds
SAFE = 2.0**53  # sums of whole numbers up to this are exact in a double


def points(df: DataFrame, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (floor(scale * x)) of the rows that take part."""
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) == float("inf")))
    whole = df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    floors = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), floors.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _as_long(x: int) -> int:
    return max(1 - 2**63, min(2**63 - 1, x))


class Block:
    """The rows of a block by dimension: a column of doubles for each, rows by ascending label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.zeros((int(sizes.max(initial=0)), len(ids)))
        starts = np.cumsum(sizes) - sizes
        self.columns[np.arange(len(flat)) - np.repeat(starts, sizes), np.repeat(np.arange(len(ids)), sizes)] = flat
        self.least, self.most = (self.columns.min(1), self.columns.max(1)) if self.columns.size else (np.zeros(len(self.columns)),) * 2
        self.top = float(np.abs(self.columns).sum(0).max()) if self.columns.size else 0.0

    def scan(self, q: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `rows` (places in the block) that `keep` leaves, and their scores. `keep` gets the least and the
        largest score that each row can have, and says which may still be wanted."""
        d = min(len(q), len(self.columns))
        q = q[:d]
        if np.abs(q).max(initial=0) * self.top >= SAFE:  # whole numbers of any size, for values that are that large
            score = np.array([_as_long(sum(int(a) * int(b) for a, b in zip(q, self.columns[:d, r]))) for r in rows], object)
            wanted = keep(score, score)
            return rows[wanted], score[wanted]
        order = np.argsort(-np.abs(q), kind="stable")
        a, b = q * self.least[:d], q * self.most[:d]
        rest_low = np.append(np.cumsum(np.minimum(a, b)[order][::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(np.maximum(a, b)[order][::-1])[::-1], 0)
        score, all_rows = np.zeros(len(rows)), len(rows) == len(self.ids)
        for s in range(0, d, STEP):
            dims = order[s : s + STEP]
            part = self.columns[dims] if all_rows else self.columns[np.ix_(dims, rows)]
            score = score + q[dims] @ part
            e = min(s + STEP, d)
            if e >= d // 2 or e == d:
                wanted = keep(score + rest_low[e], score + rest_high[e])
                if not wanted.all():
                    rows, score, all_rows = rows[wanted], score[wanted], False
            if not len(rows):
                break
        return rows, score


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, ties by smaller id."""
    if len(score) > 4 * k and score.dtype != object:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], int)


def _kth(low: np.ndarray, k: int):
    """The `k`-th highest of the scores that rows have at least; what cannot reach it is not wanted."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else None


def block_positives(block: Block, anchor: int, label: int, q: np.ndarray) -> list[tuple[int, int]]:
    """(score, id) of the best rows of the anchor's label in a block."""
    lo, hi = np.searchsorted(block.labels, [label, label + 1])
    rows = np.arange(lo, hi)
    rows = rows[block.ids[rows] != anchor]

    def keep(low, high):
        least = _kth(low, POSITIVES)
        return np.ones(len(low), bool) if least is None else high >= least

    rows, score = block.scan(q, rows, keep)
    return [(int(score[i]), int(block.ids[rows[i]])) for i in _best(score, block.ids[rows], POSITIVES)]


def block_negatives(block: Block, label: int, q: np.ndarray, windows: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For each window (least and largest score) the (score, id) of the best rows of other labels in a block."""
    lo, hi = np.searchsorted(block.labels, [label, label + 1])
    rows = np.arange(len(block.ids)) if lo == hi else np.concatenate([np.arange(lo), np.arange(hi, len(block.ids))])
    distinct = sorted({w for w in windows if w[0] <= w[1]})

    def keep(low, high):
        wanted = np.zeros(len(low), bool)
        for least, most in distinct:
            inside = low[(low >= least) & (high <= most)]  # rows that are surely in the window
            reach = _kth(inside, NEGATIVES)
            wanted |= (high >= (least if reach is None else reach)) & (low <= most)
        return wanted

    if not distinct:
        return [[] for _ in windows]
    rows, score = block.scan(q, rows, keep)
    ids, out = block.ids[rows], {}
    for least, most in distinct:
        within = np.flatnonzero((score >= least) & (score <= most))
        out[least, most] = [(int(score[within[i]]), int(ids[within[i]])) for i in _best(score[within], ids[within], NEGATIVES)]
    return [out.get(w, []) for w in windows]


def window_of(score: int) -> tuple[int, int]:
    """Whole scores s with LOW * score <= 100 s <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _scanned(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, per_anchor, schema: str) -> DataFrame:
    """The rows that `per_anchor` (block, anchor) gives for every anchor and block. In each pair of a block and a group of
    anchors the block's rows come first, so that a task holds one block and reads anchors as they come."""
    names, extra = [c.split()[0] for c in schema.split(", ")], [c for c in anchors.columns if c not in rows.columns]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("long")
    one = rows.select("*", F.lit(0).alias("kind"), of(1, blocks).alias("block"), every(groups).alias("group"))
    other = anchors.select("*", F.lit(1).alias("kind"), every(blocks).alias("block"), of(2, groups).alias("group"))
    dealt = one.unionByName(other, allowMissingColumns=True).repartition(min(MOST_TASKS, max(blocks * groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block", "group")

    def run(batches):
        import pyarrow as pa

        cell, held, block = None, [], None
        for batch in batches:
            at = batch.column("block").to_numpy() * groups + batch.column("group").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                part = batch.slice(s, e - s)
                if at[s] != cell:
                    cell, held, block = at[s], [], None
                vectors = part.column("v")
                flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
                if kind[s] == 0:
                    held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), flat, sizes))
                    continue
                if block is None:
                    block, held = Block(*map(np.concatenate, zip(*(held or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))])))), []
                ends = np.cumsum(sizes)
                more = [part.column(c).to_pylist() for c in extra]
                found = [row for k, (i, label) in enumerate(zip(part.column("vec_id").to_pylist(), part.column("label").to_pylist())) for row in per_anchor(block, i, label, flat[ends[k] - sizes[k] : ends[k]], *(m[k] for m in more))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    return dealt.sortWithinPartitions("block", "group", "kind", "label", "vec_id").mapInArrow(tidy(run), schema)


def hard_negatives(df: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, embedding, label).

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Of rows with one
    vec_id the smallest (label, vector) does. What a shorter vector lacks counts as zero. Scores are exact; those beyond
    2^63 - 1 (or below its negative) count as that. Anchors without positives, and positives without negatives in their
    window, give no rows; so does an empty table. Other columns are not read.
    """
    rows = stored(points(df), "points")
    total = rows.count()
    if not total:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = -(-total // max(ROWS[0], min(ROWS[1], total // 24)))
    anchors = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-anchors.count() // ANCHORS))

    def positives(block, anchor, label, q):
        for score, other in block_positives(block, anchor, label, q):
            yield anchor, other, score

    found = _scanned(rows, anchors, blocks, groups, positives, "vec_id long, other long, score long")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "other", "score")))
    best = stored(found.groupBy("vec_id").agg(F.slice(ordered, 1, POSITIVES).alias("best")), "positives")

    def negatives(block, anchor, label, q, best):
        windows = [window_of(p["score"]) for p in best]
        for p, found in zip(best, block_negatives(block, label, q, windows)):
            for score, other in found:
                yield anchor, p["other"], p["score"], other, score

    met = _scanned(rows, anchors.join(best, "vec_id"), blocks, groups, negatives, "anchor_id long, positive_id long, positive_score long, other long, score long")
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "other", "score"))), 1, NEGATIVES)
    mined = met.groupBy("anchor_id", "positive_id", "positive_score").agg(first.alias("first"))
    mined = mined.select("anchor_id", "positive_id", "positive_score", F.posexplode("first").alias("at", "n"))
    return mined.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.other").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of the embeddings whose id 50 divides."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))
