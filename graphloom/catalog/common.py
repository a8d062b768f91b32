"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Catalog(dict):
    """name -> (query, SQL or None)."""

    def query(self, name: str, sql: str | None):
        def register(fn):
            if name in self:
                raise ValueError(f"query {name} is there already")
            self[name] = (fn, sql)
            return fn

        return register


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


def draw_sql(a: str, b: str, seed: int) -> str:
    return f"((({a} * 7919 + {b} * 104729 + {seed * 1299709}) % 1000003) / 1000003.0::DOUBLE)"


def long_form(df: DataFrame, keep: list[str], vec: str = "features", digits: int = 6) -> DataFrame:
    """One row per vector element, rounded, for comparison."""
    long = df.select(*keep, F.posexplode(vec).alias("idx", "x"))
    return long.withColumn("x", F.round(F.col("x").cast("double"), digits))
