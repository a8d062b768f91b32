"""Tables written below ``spark.checkpoint.dir``: results that several later steps read, and that outlive an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import drop_path, new_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes tables made by ``cut`` that nothing reads any more."""
    for df in frames:
        drop_path(df.sparkSession, df._cut_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text"):
    """A text column as bytes; the bytes of a valid text are its UTF-8 form."""
    return F.col(column).cast("binary").alias(column)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, and otherwise as it is. Counts its rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


BATCH_ROWS = 1000


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches that suit whole texts."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows, unless the session has another number than Spark's 10,000.

    A row here is a whole text, and a batch is held several times by the executor and its Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    n = 0
    while f"tmp_{n}" in taken:
        n += 1
    return f"tmp_{n}"
