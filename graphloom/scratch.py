"""Cutting the lineage of iterative jobs.

Each step of a loop is written as a parquet table below ``spark.checkpoint.dir``, the shared folder
named by the cluster, and read back. A lost executor then costs one re-read, the next plan starts
from a scan with true sizes, and the plan does not grow with the number of steps.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 1_000_000  # rows that ``dealt`` sends to one task, about

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cuts: ``spark.checkpoint.dir``, or a fresh one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def new_path(spark: SparkSession, name: str = "cut") -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` below the scratch folder and return the table read back."""
    return _write(df, new_path(df.sparkSession, name))


def per_key(df: DataFrame, name: str = "per-key") -> DataFrame:
    """An aggregate that is about to be joined back to its own rows, as a table.

    Spark splits a skewed partition of a join only when both sides come straight out of a shuffle. An
    aggregate keeps the partitioning of its key, so it would be joined in place and a hot key's rows
    would all meet in one task. Read back as a table it is shuffled like the other side, and the hot
    key is split; when the table is small it is broadcast, by its true size.
    """
    return cut(df, name)


def settled(df: DataFrame, name: str = "input") -> DataFrame:
    """``df`` as a table that a loop can read again and again: cut unless it already is a cut or a bare scan."""
    return df if getattr(df, "_is_cut", False) or is_scan(df) else cut(df, name)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads columns of files, so that a copy of it would gain nothing."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    project = re.fullmatch(r"Project \[([\w#, ]*)\]", plan[0])
    return len(plan) <= 2 and plan[-1].startswith(("Relation", "+- Relation")) and (len(plan) == 1 or project is not None)


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into tasks of about ``ROWS_PER_TASK`` of its ``rows``, ahead of an aggregation that few rows share.

    Spark merges shuffled partitions by their compressed size, and millions of narrow rows fit that. An aggregation keeps
    each of its groups in memory, before and after its shuffle, and spills. Where most groups have one row, counting
    them before the shuffle gains nothing; here they are counted once, after it.
    """
    if rows is None:
        return df.repartition(*keys)
    return df.repartition(tasks_for(df.sparkSession, rows), *keys) if rows > ROWS_PER_TASK else df


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of about ``ROWS_PER_TASK`` rows, and as many as a shuffle has partitions."""
    return max(-(-rows // ROWS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_of_groups(spark: SparkSession, groups: int) -> int:
    """Tasks to which groups that each take a while are dealt by a hash, so that few share one."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(4 * groups, 8 * n))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_cut = True
    return out


def bucketed(df: DataFrame, keys: list[str], name: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """``df`` written in as many buckets of ``keys`` as a shuffle has partitions, so that joins and aggregations by them need no shuffle of it.

    With ``buckets`` it comes dealt by ``keys`` into so many tasks already.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = new_path(spark, name), f"graphloom_{name}_{uuid.uuid4().hex}"
    # dealt by the buckets' own hash, so each task writes one file
    dealt = (df if buckets else df.repartition(n, *keys)).write.bucketBy(n, *keys)
    dealt.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._is_cut, out._bucketed = True, (table, path)
    return out


def release(df: DataFrame) -> None:
    """Removes a table made by ``bucketed``."""
    table, path = df._bucketed
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Loop:
    """State of a driver loop: ``step`` writes the next state and frees the one before it."""

    def __init__(self, name: str):
        self.name = name
        self.path: str | None = None

    def step(self, df: DataFrame) -> DataFrame:
        path = new_path(df.sparkSession, self.name)
        out = _write(df, path)
        if self.path:
            drop_path(df.sparkSession, self.path)
        self.path = path
        return out
