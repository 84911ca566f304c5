"""Streaming operators over the given tables, read as streams until all that is there has been taken."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.model import apply_model
from ..sources import fixtures as fx
from ..streaming import ledger as live


def _folder(spark: SparkSession, kind: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-streams-", dir="/tmp")
    return f"{named.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return fx.ledger_rows(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))  # a glob may name one file


def _written(spark: SparkSession, stream: DataFrame, kind: str, mode: str) -> str:
    folder = _folder(spark, kind)
    stream.writeStream.foreachBatch(live.batch_folders(f"{folder}/rows")).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/rows"


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, live.stream_ledger(_events(spark, sf_dir)), "ledger", "update")
    return live.read_ledger(spark, rows).select("path", "seq", "status", "error")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.read_counts(spark, _written(spark, live.stream_status_changes(_events(spark, sf_dir)), "counts", "append"))


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, live.stream_breaker(_events(spark, sf_dir)), "breaker", "append")
    return spark.read.parquet(rows).select("path", "error", "seq")


def model_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model hook with a stand-in model: the number of characters as a string."""
    return apply_model(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [str(len(t)) for t in texts]).select("doc_id", "result")


QUERIES = {f.__name__: f for f in (stream_ledger, stream_counts, stream_breaker, model_lengths)}

_EV = """ev AS (SELECT 'f' || user_id AS path, event_id AS seq, ts,
  CASE WHEN event_type IN ('signup', 'click') THEN 'pending' WHEN event_type = 'view' THEN 'in_progress' WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN event_type NOT IN ('signup', 'click', 'view', 'purchase') THEN 'E' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS error FROM events)"""

ORACLES = {
    "stream_ledger": f"WITH {_EV} SELECT path, seq, status, error FROM ev QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) = 1",
    "stream_counts": f"WITH {_EV}, last AS (SELECT path, status FROM ev QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) = 1) SELECT status, count(*) AS files FROM last GROUP BY status",
    "stream_breaker": f"""WITH {_EV}, f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, seq) - row_number() OVER (PARTITION BY path, error ORDER BY ts, seq) AS run FROM ev WHERE status = 'failed')
SELECT path, error, seq FROM f QUALIFY row_number() OVER (PARTITION BY path, error, run ORDER BY ts, seq) = 3""",
    "model_lengths": "SELECT doc_id, CAST(length(text) AS VARCHAR) AS result FROM documents",
}
