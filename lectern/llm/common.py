"""Helpers that the training-data operators share: table access, task counts, the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of stored input that one task of an exchange gets by default.
TASK_BYTES = 8 << 20
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only `doc_id` and `text` (null: empty), whatever other columns the input carries."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def stored_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a relation (for file scans, the bytes of the files); 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def tasks_for(df: DataFrame, per_task: int = TASK_BYTES, least: int = 0) -> int:
    """Tasks for an exchange of `df`; grows with the input and never falls below the session's number."""
    spark = df.sparkSession
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(df) // per_task))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to BATCH_BYTES. Spark's own bounds are 10,000 rows and 64 MB, which stand
    beside each other several times in the executor and its Python workers; no result depends on them."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.fullmatch(r"([0-9]+)([kmgtp]?)b?", spark.conf.get(bound).strip().lower()).groups()
    if int(digits) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))


def tidy(run):
    """`run` (batches to batches) with its free memory given back to the system at the end of each task: workers live on,
    and what one stage has freed must not stand beside the next one's."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """`df` written once as a Parquet table in the shared folder and read back."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
