"""Sinks. All replace what is at the path. Tables with a subgraph are split into one folder each.

``rebalance`` lets Spark merge small subgraphs into one task and split a huge one over several, so
a subgraph that holds a third of the rows is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import vec_to_string
from graphloom.sources.readers import SOH


def _write_text(df: DataFrame, line: Column, path: str) -> None:
    """One text line per row, under ``subgraph_id=`` folders when there is such a column."""
    if "subgraph_id" in df.columns:
        lines = df.select("subgraph_id", line.alias("value")).hint("rebalance", "subgraph_id")
        lines.write.mode("overwrite").partitionBy("subgraph_id").text(path)
    else:
        df.select(line.alias("value")).write.mode("overwrite").text(path)


def _tabbed(*cols: str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in cols])


def write_partition(parts: DataFrame, path: str) -> None:
    _write_text(parts.select("id", "part"), _tabbed("id", "part"), path)


def write_scores(scores: DataFrame, path: str, columns: tuple[str, ...] = ("id", "p"), sep: str = "\t") -> None:
    """``id<tab>p``; other columns, such as a leading date, by ``columns``."""
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    _write_text(scores.select(*columns), line, path)


def write_embeddings(emb: DataFrame, path: str, sep: str = SOH) -> None:
    _write_text(emb, F.concat(F.col("id").cast("string"), F.lit(sep), vec_to_string("vec")), path)


def merge_embeddings(sources: dict[str, DataFrame], date: str, keep_source: bool = False) -> DataFrame:
    """All sources as one table ``(dt, id, vec)``."""
    out = None
    for tag, emb in sources.items():
        extra = [F.lit(tag).alias("source")] if keep_source else []
        part = emb.select(F.lit(date).alias("dt"), *extra, F.col("id").cast("string").alias("id"), "vec")
        out = part if out is None else out.unionByName(part)
    return out


def write_merged_embeddings(sources: dict[str, DataFrame], date: str, path: str) -> None:
    merged = merge_embeddings(sources, date)
    _write_text(merged, F.concat_ws(SOH, "dt", "id", vec_to_string("vec", SOH)), path)


def augmented_lines(edges: DataFrame, added: DataFrame, prefix: tuple[str, ...] = ("c0", "c1")) -> DataFrame:
    """Kept and added edges in the input layout; added edges get intimacy 1.0."""
    cols = ["subgraph_id", *prefix, "src", "dst", "intimacy"]
    new = added.withColumn("intimacy", F.lit(1.0))
    both = new.select(*cols).unionByName(edges.select(*cols))
    return both.select("subgraph_id", _tabbed(*cols[1:]).alias("value"))


def write_augmented_edges(edges: DataFrame, added: DataFrame | None, path: str, prefix: tuple[str, ...] = ("c0", "c1")) -> None:
    empty = edges.limit(0) if added is None else added
    lines = augmented_lines(edges, empty, prefix)
    _write_text(lines, F.col("value"), path)


def materialize_subgraphs(
    parts: DataFrame, edges: DataFrame, nodes: DataFrame, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with their part as ``subgraph_id``; edges between parts are left out.

    With ``path``, both are written as parquet below it, one folder per subgraph, and read back.
    """
    part = F.col("part").cast("int")
    of = {k: parts.select(F.col("id").alias(k), part.alias(f"_{k}_part")) for k in ("id", "src", "dst")}
    node_rows = nodes.join(of["id"], "id").withColumnRenamed("_id_part", "subgraph_id")
    edge_rows = (
        edges.join(of["src"], "src")
        .join(of["dst"], "dst")
        .filter(F.col("_src_part") == F.col("_dst_part"))
        .withColumnRenamed("_src_part", "subgraph_id")
        .drop("_dst_part")
    )
    if path is None:
        return node_rows, edge_rows
    spark = nodes.sparkSession
    out = []
    for name, df in (("nodes", node_rows), ("edges", edge_rows)):
        target = f"{path}/{name}"
        df.hint("rebalance", "subgraph_id").write.mode("overwrite").partitionBy("subgraph_id").parquet(target)
        out.append(spark.read.parquet(target))
    return out[0], out[1]
