"""Model parameters: summed gradients from tasks, and saving as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]


def flatten(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflatten(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def sum_over_rows(df: DataFrame, partial: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``partial(batch)`` over all rows: added up per task, then over tasks.

    Only ``size`` numbers a branch, as many as the model has parameters, come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += partial(pdf)
        yield pd.DataFrame({"part": [total.tobytes()]})

    return sum_arrays(df.mapInPandas(run, "part binary"), "part", size)


BRANCHES = 8


def sum_arrays(df: DataFrame, column: str, size: int, few: bool = False) -> np.ndarray:
    """Sum of arrays of doubles held as bytes. The tasks' arrays are added whole, in ``BRANCHES`` tasks, and those by the driver.

    With ``few`` there are no more rows than that, and they come to the driver as they are.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch[0].drop_null():
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = df.select(F.col(column).alias("part"))
    if not few:
        parts = parts.mapInArrow(add, "part binary").repartition(BRANCHES).mapInArrow(add, "part binary")
    total = np.zeros(size)
    for row in parts.collect():
        total += np.frombuffer(row["part"])
    return total


def save_params(spark: SparkSession, params: Params, path: str) -> None:
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def load_params(spark: SparkSession, path: str) -> Params:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
