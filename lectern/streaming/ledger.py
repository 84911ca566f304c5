"""The ledger, its counts, progress and failures kept up to date from streams.

State is held by path or job in the state store, so a batch costs what it brings, not what the ledger holds. Sinks
write one folder for each batch and overwrite it when a batch is repeated, so a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.ledger import ledger_state


def stream_new_files(listing: DataFrame) -> DataFrame:
    """path, status, mode of every file of a stream of listings when it is first seen; a later listing of it gives
    nothing. Null paths are dropped."""
    mode = F.when(F.lower("path").endswith(".txt"), "text").otherwise("transcribe")
    return listing.where("path IS NOT NULL").dropDuplicates(["path"]).select("path", F.lit("pending").alias("status"), mode.alias("mode"))


def stream_ledger(events: DataFrame) -> DataFrame:
    """Latest (ts, seq) row of each path whose events arrived; write it in update mode. Late events lose."""
    return ledger_state(events)


def stream_status_changes(events: DataFrame) -> DataFrame:
    """status, change (+1 or -1) for every path whose latest status changed (path, status, ts, seq); the sums of the
    changes are the counts of the paths in each status."""

    def step(key, batches, state):
        import pandas as pd

        last = state.get if state.exists else None
        best = last
        for b in batches:
            for ts, seq, status in zip(b["ts"].astype("int64"), b["seq"], b["status"]):
                if best is None or (ts, seq) > best[:2]:
                    best = (int(ts), int(seq), status)
        state.update(best)
        changes = [] if last is not None and last[2] == best[2] else [(best[2], 1)] + ([(last[2], -1)] if last is not None else [])
        yield pd.DataFrame(changes, columns=["status", "change"])

    known = events.select("path", "ts", "seq", "status").where("ts IS NOT NULL AND seq IS NOT NULL")
    return known.groupBy("path").applyInPandasWithState(step, "status string, change long", "ts long, seq long, status string", "append", "NoTimeout")


def stream_progress(segments: DataFrame, n: int = rules.EXCERPT_WORDS) -> DataFrame:
    """path, fraction, excerpt for every path with new segments (path, seg_id, end, duration, text): last end over
    duration within 0..1 (null without a positive duration), and the last n words. Write it in update mode.

    Segments are taken by seg_id within a batch; one that is older than the last taken adds no words.
    """

    def step(key, batches, state):
        import pandas as pd

        seg, end, duration, excerpt = state.get if state.exists else (-1, 0.0, 0.0, "")
        rows = sorted((int(i), float(e), float(d), t) for b in batches for i, e, d, t in zip(b["seg_id"], b["end"].fillna(0.0), b["duration"].fillna(0.0), b["text"].fillna("")))
        for i, e, d, t in rows:
            end, duration = max(end, e), max(duration, d)
            if i > seg:
                seg, excerpt = i, " ".join((excerpt.split() + t.split())[-n:])
        state.update((seg, end, duration, excerpt))
        yield pd.DataFrame({"path": [key[0]], "fraction": [min(max(end / duration, 0.0), 1.0) if duration > 0 else None], "excerpt": [excerpt]}).astype({"fraction": "float64"})

    known = segments.select("path", "seg_id", "end", "duration", "text").where("seg_id IS NOT NULL")
    return known.groupBy("path").applyInPandasWithState(step, "path string, fraction double, excerpt string", "seg long, end double, duration double, excerpt string", "update", "NoTimeout")


def stream_breaker(events: DataFrame, by: str = "path", least: int = rules.FAILURE_RUN, reset_on_success: bool = False) -> DataFrame:
    """by, error, seq of the event at which the same error came `least` times in a row, once for each run.

    Other statuses stand aside, or with `reset_on_success` a done one ends the run. Events (status, error, ts, seq)
    are taken by (ts, seq) within a batch.
    """

    def step(key, batches, state):
        import pandas as pd

        error, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        stops = []
        for status, e, seq in zip(rows["status"], rows["error"], rows["seq"]):
            if status == "failed":
                e = None if pd.isna(e) else e
                run = run + 1 if run and e == error else 1
                error = e
                if run == least:
                    stops.append((key[0], error, int(seq)))
            elif reset_on_success and status == "done":
                error, run = None, 0
        state.update((error, run))
        yield pd.DataFrame(stops, columns=[by, "error", "seq"])

    known = events.select(F.col(by).cast("string").alias(by), "ts", "seq", "status", "error").where("status IN ('failed', 'done')")
    return known.groupBy(by).applyInPandasWithState(step, f"{by} string, error string, seq long", "error string, run int", "append", "NoTimeout")


def batch_folders(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch in its own folder, replaced when the batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """State of the ledger whose changed rows `batch_folders` wrote."""
    return ledger_state(spark.read.parquet(folder).drop("batch"))


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """status, files from the written status changes; statuses that no path has any more are left out."""
    return spark.read.parquet(folder).groupBy("status").agg(F.sum("change").alias("files")).where("files <> 0")
