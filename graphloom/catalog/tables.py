"""Graphs and node tables derived from the given tables, in Spark and as SQL text.

Node ids: customers as they are, suppliers + 100000000, parts + 200000000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.placed import PlacedEdges, place_edges
from graphloom.scratch import dealt, tasks_for

SUPPLIER = 100_000_000
PART = 200_000_000

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- customer-supplier edges: weighted, bipartite, directed rows

TRADE_SQL = f"""
trade AS (
  SELECT o_custkey AS src, {SUPPLIER} + l_suppkey AS dst, CAST(SUM(l_quantity) AS BIGINT) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
)"""


def lines_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_with_customer(spark, sf_dir).select(
        F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst"), "l_quantity"
    )
    lines = dealt(lines, table(spark, sf_dir, "lineitem").count(), "src", "dst")
    return lines.groupBy("src", "dst").agg(F.sum("l_quantity").cast("bigint").alias("w"))


# ---- the same edges inside one nation; the nation is the subgraph

NATION_SQL = f"""{TRADE_SQL},
nation_nodes AS (
  SELECT CAST(c_nationkey AS INTEGER) AS subgraph_id, c_custkey AS id FROM customer
  UNION ALL SELECT CAST(s_nationkey AS INTEGER), {SUPPLIER} + s_suppkey FROM supplier
),
nation_edges AS (
  SELECT a.subgraph_id, t.src, t.dst, t.w
  FROM trade t JOIN nation_nodes a ON t.src = a.id JOIN nation_nodes b ON t.dst = b.id
  WHERE a.subgraph_id = b.subgraph_id
)"""


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("int").alias("subgraph_id"), F.col("c_custkey").alias("id")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("int").alias("subgraph_id"), (F.col("s_suppkey") + SUPPLIER).alias("id")
    )
    return customers.union(suppliers)


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nation_nodes(spark, sf_dir)
    ends = {end: nodes.select(F.col("id").alias(end), F.col("subgraph_id").alias(f"{end}_sub")) for end in ("src", "dst")}
    return (
        trade(spark, sf_dir)
        .join(ends["src"], "src")
        .join(ends["dst"], "dst")
        .filter("src_sub = dst_sub")
        .select(F.col("src_sub").alias("subgraph_id"), "src", "dst", "w")
    )


# ---- customer-supplier-part triangles: symmetric and not bipartite; three edges per line item

TRIANGLE_SQL = f"""
pairs AS (
  SELECT o_custkey AS c, {SUPPLIER} + l_suppkey AS s, {PART} + l_partkey AS p, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
triangles AS (
  SELECT src, dst, CAST(SUM(q) AS BIGINT) AS w FROM (
    SELECT c AS src, s AS dst, q FROM pairs UNION ALL SELECT s, c, q FROM pairs
    UNION ALL SELECT c, p, q FROM pairs UNION ALL SELECT p, c, q FROM pairs
    UNION ALL SELECT s, p, q FROM pairs UNION ALL SELECT p, s, q FROM pairs
  ) GROUP BY 1, 2
)"""


def triangles(spark: SparkSession, sf_dir: str, kept: bool | str = False) -> DataFrame:
    """Every edge in both directions. With ``kept`` the edges are written once, for callers that read them more than once.

    ``kept`` may name the end by which they are laid out, ``src`` if it is ``True``.
    """
    if kept:
        out = placed_triangles(spark, sf_dir, "src" if kept is True else kept).plain()
        out._is_cut = out._symmetric = True
        return out
    c, s, p = F.col("o_custkey"), F.col("l_suppkey") + SUPPLIER, F.col("l_partkey") + PART
    # both directions have the same weight: one of them is summed, smaller end first and nulls before all
    ends = F.array(*[_ordered(a, b) for a, b in [(c, s), (c, p), (s, p)]])
    pairs = lines_with_customer(spark, sf_dir).select(F.explode(ends).alias("e"), "l_quantity").select("e.a", "e.b", "l_quantity")
    sums = dealt(pairs, 3 * table(spark, sf_dir, "lineitem").count(), "a", "b").groupBy("a", "b").agg(F.sum("l_quantity").alias("q"))
    arc = lambda a, b, q: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), q.cast("bigint").alias("w"))
    # a loop is the sum of both directions
    arcs = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(arc("a", "b", 2 * F.col("q"))))
    return sums.select(F.explode(arcs.otherwise(F.array(arc("a", "b", F.col("q")), arc("b", "a", F.col("q"))))).alias("e")).select("e.*")


def placed_triangles(spark: SparkSession, sf_dir: str, end: str) -> PlacedEdges:
    """The edges of ``triangles`` written in buckets of ``end``, after one shuffle in which a line is sent to each of its three nodes."""
    c, s, p = F.col("o_custkey"), F.col("l_suppkey") + SUPPLIER, F.col("l_partkey") + PART
    at = lambda node, a, b: F.struct(node.alias("id"), a.alias("a"), b.alias("b"))
    ends = F.array(at(c, s, p), at(s, c, p), at(p, c, s))
    lines = lines_with_customer(spark, sf_dir).select(F.explode(ends).alias("e"), "l_quantity").select("e.id", "e.a", "e.b", "l_quantity")
    n = tasks_for(spark, 6 * table(spark, sf_dir, "lineitem").count())
    other = "dst" if end == "src" else "src"
    arcs = lines.repartition(n, "id").select(F.col("id").alias(end), F.explode(F.array("a", "b")).alias(other), "l_quantity")
    sums = arcs.groupBy(end, other).agg(F.sum("l_quantity").cast("bigint").alias("w")).select("src", "dst", "w")
    placed = place_edges(sums, end, buckets=n)
    placed.symmetric = True
    return placed


def _ordered(a: Column, b: Column) -> Column:
    swap = F.coalesce(a > b, b.isNull())
    return F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))


# ---- dense customer features with their label text and split

FEATURE_SQL = """
customer_features AS (
  SELECT CAST(c_nationkey AS INTEGER) AS subgraph_id, c_custkey AS id, c_acctbal AS f1,
         COALESCE(n_orders, 0.0) AS f2, COALESCE(spend, 0.0) AS f3,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '1' WHEN c_mktsegment = 'MACHINERY' THEN 'x' ELSE '0' END AS label,
         c_custkey % 10 < 7 AS is_train
  FROM customer LEFT JOIN (
    SELECT o_custkey, CAST(COUNT(*) AS DOUBLE) AS n_orders, SUM(o_totalprice) AS spend FROM orders GROUP BY 1
  ) ON c_custkey = o_custkey
)"""


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    )
    segment = F.col("c_mktsegment")
    return (
        table(spark, sf_dir, "customer")
        .join(spend, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_nationkey").cast("int").alias("subgraph_id"),
            F.col("c_custkey").alias("id"),
            F.array(
                F.col("c_acctbal"), F.coalesce("n_orders", F.lit(0.0)), F.coalesce("spend", F.lit(0.0))
            ).alias("features"),
            F.when(segment == "BUILDING", "1").when(segment == "MACHINERY", "x").otherwise("0").alias("label"),
            (F.col("c_custkey") % 10 < 7).alias("is_train"),
        )
    )


# ---- scored labels: score from the text length (ties occur), class = quality

SCORED_SQL = """
scored AS (
  SELECT l.doc_id AS id, d.source AS source, l.quality AS label,
         FLOOR(d.n_chars / 20.0) / 100.0 - 1.0 AS score,
         d.n_chars % 3 > 0 AS is_masked
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            "source",
            F.col("quality").alias("label"),
            (F.floor(F.col("n_chars") / 20.0) / 100.0 - 1.0).alias("score"),
            (F.col("n_chars") % 3 > 0).alias("is_masked"),
        )
    )


# ---- unit vectors

VECTOR_SQL = """
vectors AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS subgraph_id, embedding AS vec FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("subgraph_id"), F.col("embedding").alias("vec")
    )
