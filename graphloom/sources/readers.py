"""Text readers. Each is ``spark.read.text`` and a pure parser of the column ``value``.

Files whose name is a number (or ``subgraph_id=`` folders) give the column ``subgraph_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import clean_dense_feature, clean_sparse_token, composite_key, strip

SOH = "\x01"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value")


def read_subgraph_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path)
    if "subgraph_id" in lines.columns:
        return lines.select("subgraph_id", "value")
    # escaped metadata names are not numbers; the file's own name is the id
    return lines.select(
        F.regexp_extract("_metadata.file_name", r"(\d+)(\.\w+)*$", 1).try_cast("int").alias("subgraph_id"), "value"
    )


def _at(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _others(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c != "value"]


# ---- edges


def parse_edge_list(lines: DataFrame, u_idx: int, v_idx: int, w_idx: int = -1, delimiter: str = r"\s+") -> DataFrame:
    parts = F.split("value", delimiter)
    w = F.lit(1.0) if w_idx == -1 else _at(parts, w_idx).cast("double")
    return lines.select(
        *_others(lines), _at(parts, u_idx).cast("bigint").alias("src"), _at(parts, v_idx).cast("bigint").alias("dst"), w.alias("w")
    )


def read_edge_list(spark: SparkSession, path: str, u_idx: int, v_idx: int, w_idx: int = -1, delimiter: str = r"\s+") -> DataFrame:
    return parse_edge_list(read_lines(spark, path), u_idx, v_idx, w_idx, delimiter)


def parse_subgraph_edges(lines: DataFrame, sep: str | None = "\t") -> DataFrame:
    """Columns 2, 3, 4 of each line; ``sep=None`` splits at any white space."""
    parts = F.split(strip("value"), r"\s+" if sep is None else sep)
    return lines.select(
        *_others(lines), _at(parts, 2).alias("src"), _at(parts, 3).alias("dst"), _at(parts, 4).cast("double").alias("intimacy")
    )


def read_subgraph_edges(spark: SparkSession, path: str, sep: str | None = "\t") -> DataFrame:
    return parse_subgraph_edges(read_subgraph_lines(spark, path), sep)


def parse_composite_edges(lines: DataFrame) -> DataFrame:
    """Seven columns; a node key is two of them joined by a tab."""
    parts = F.split(strip("value"), "\t")
    return lines.select(
        *_others(lines),
        composite_key(_at(parts, 2), _at(parts, 3)).alias("src"),
        composite_key(_at(parts, 4), _at(parts, 5)).alias("dst"),
        _at(parts, 6).cast("double").alias("intimacy"),
    )


def read_composite_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_composite_edges(read_subgraph_lines(spark, path))


def read_delimited_edges(spark: SparkSession, path: str, sep: str = SOH) -> DataFrame:
    """Integer edges; a line that does not fit is an error."""
    return spark.read.csv(path, sep=sep, schema="src BIGINT, dst BIGINT, w BIGINT", mode="FAILFAST")


# ---- nodes


def parse_subgraph_nodes(lines: DataFrame, nan: str = "keep") -> DataFrame:
    """Column 1 the id, the last the label, those between the features, cleaned."""
    parts = F.split(strip("value"), "\t")
    tokens = F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0)))
    return lines.select(
        *_others(lines),
        _at(parts, 1).alias("id"),
        clean_dense_feature(tokens, nan).alias("features"),
        F.element_at(parts, -1).alias("label"),
    )


def read_subgraph_nodes(spark: SparkSession, path: str, nan: str = "keep") -> DataFrame:
    return parse_subgraph_nodes(read_subgraph_lines(spark, path), nan)


def parse_libsvm_nodes(lines: DataFrame, n_features: int | None = None) -> DataFrame:
    """``id`` and ``cells ARRAY<STRUCT<idx, val>>``; a node without features keeps an empty array.

    Tokens without an integer index are dropped. With ``n_features``, an index outside it is an error.
    """
    parts = F.split(strip("value"), "\t")
    tokens = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    cells = F.filter(F.transform(tokens, clean_sparse_token), lambda c: c.isNotNull())
    if n_features is not None:
        outside = F.exists(cells, lambda c: (c.idx < 0) | (c.idx >= n_features))
        cells = F.when(outside, F.raise_error(F.lit(f"feature index outside 1..{n_features}"))).otherwise(cells)
    return lines.select(*_others(lines), _at(parts, 1).alias("id"), cells.alias("cells"))


def read_libsvm_nodes(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    return parse_libsvm_nodes(read_subgraph_lines(spark, path), n_features)


def sparse_cells(nodes: DataFrame) -> DataFrame:
    """Long form (id, idx, val) with repeated cells of a node summed."""
    keys = [c for c in nodes.columns if c != "cells"]
    long = nodes.select(*keys, F.inline("cells"))
    return long.groupBy(*keys, "idx").agg(F.sum("val").alias("val"))


def sparse_to_dense(nodes: DataFrame, n_features: int) -> DataFrame:
    """``features`` of length ``n_features``; repeated cells are summed."""
    def at(i):
        return F.aggregate(F.filter("cells", lambda c: c.idx == i), F.lit(0.0), lambda acc, c: acc + c.val)

    dense = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), at)
    return nodes.withColumn("features", dense).drop("cells")


# ---- id lists and vectors


def parse_id_list(lines: DataFrame, col: int | None = 1) -> DataFrame:
    """Distinct ids: a tab-separated column, or with ``col=None`` the whole trimmed line."""
    text = strip("value")
    ident = text if col is None else _at(F.split(text, "\t"), col)
    return lines.select(ident.alias("id")).distinct()


def read_id_list(spark: SparkSession, path: str, col: int | None = 1) -> DataFrame:
    return parse_id_list(read_lines(spark, path), col)


def parse_word2vec_text(lines: DataFrame) -> DataFrame:
    """``id v1 .. vd`` with ids from 1, given back from 0; the header ``n d`` is the two-token line."""
    parts = F.split(strip("value"), r"\s+")
    rows = lines.select(parts.alias("_p")).filter(F.size("_p") > 2)
    vec = F.transform(F.slice("_p", 2, F.size("_p") - 1), lambda t: t.cast("double"))
    return rows.select((_at(F.col("_p"), 0).cast("bigint") - 1).alias("id"), vec.alias("vec"))


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_word2vec_text(read_lines(spark, path))


def parse_embeddings(lines: DataFrame, id_sep: str = SOH) -> DataFrame:
    """``id<sep>v v v``."""
    parts = F.split(strip("value"), f"\\Q{id_sep}\\E")
    vec = F.transform(F.split(_at(parts, 1), " "), lambda t: t.cast("float"))
    return lines.select(*_others(lines), _at(parts, 0).alias("id"), vec.alias("vec"))


def read_embeddings(spark: SparkSession, path: str | list[str], id_sep: str = SOH) -> DataFrame:
    return parse_embeddings(read_subgraph_lines(spark, path), id_sep)
