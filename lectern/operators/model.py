"""The hook for a user's model: a function from a batch of texts to as many results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_model(df: DataFrame, fn: Callable[[list[str]], list[str]], col: str = "text", out: str = "result", batch: int = 16) -> DataFrame:
    """`df` with `out` = fn of `col`. Every distinct text is given to the model once, in lists of at most `batch`; null
    texts give null. A list of another length than its input stops the job."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            texts, results = frame["_in"].tolist(), []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                got = list(fn(part))
                if len(got) != len(part):
                    raise ValueError(f"the model gave {len(got)} results for {len(part)} texts")
                results += got
            yield pd.DataFrame({"_in": texts, out: results})

    wanted = df.select(F.col(col).alias("_in")).where("_in IS NOT NULL").distinct()
    found = wanted.mapInPandas(run, f"_in string, `{out}` string")
    return df.join(found, F.col(col) == F.col("_in"), "left").drop("_in")
