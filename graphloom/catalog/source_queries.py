"""Sources and sinks: tables are written in the text layouts and read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from graphloom.catalog.common import Catalog, long_form, with_
from graphloom.catalog.tables import (
    FEATURE_SQL,
    NATION_SQL,
    TRADE_SQL,
    VECTOR_SQL,
    customer_features,
    nation_edges,
    nation_nodes,
    table,
    trade,
    vectors,
)
from graphloom.operators import edges as E
from graphloom.scratch import new_path
from graphloom.sources import files, readers, writers

CATALOG = Catalog()
query = CATALOG.query


def written(df, name):
    """Write the text column ``value`` (below ``subgraph_id=`` folders if there is one)."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    if "subgraph_id" in df.columns:
        writer = df.hint("rebalance", "subgraph_id").write.partitionBy("subgraph_id")
    writer.text(path)
    return path


def tabbed(*cols):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value")


@query("read_edge_list", with_(TRADE_SQL) + "SELECT src, dst, CAST(w AS DOUBLE) AS w FROM trade")
def _(spark, d):
    lines = trade(spark, d).select(F.concat_ws("  ", F.col("w").cast("string"), F.col("dst").cast("string"), F.col("src").cast("string")).alias("value"))
    return readers.read_edge_list(spark, written(lines, "edge-list"), u_idx=2, v_idx=1, w_idx=0)


@query(
    "read_edge_list_unweighted", with_(TRADE_SQL) + "SELECT src, dst, 1.0::DOUBLE AS w FROM trade"
)
def _(spark, d):
    lines = trade(spark, d).select(F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return readers.read_edge_list(spark, written(lines, "edge-list"), u_idx=0, v_idx=1, delimiter=",")


@query(
    "read_subgraph_nodes",
    with_(FEATURE_SQL)
    + """, cells AS (
      SELECT subgraph_id, id, label, 0 AS idx, f1 AS x FROM customer_features
      UNION ALL SELECT subgraph_id, id, label, 1, 0.0 FROM customer_features
      UNION ALL SELECT subgraph_id, id, label, 2, f3 * 100 FROM customer_features)
    SELECT subgraph_id, CAST(id AS VARCHAR) AS id, label, CAST(idx AS INTEGER) AS idx,
      ROUND(CASE WHEN x < 0 OR x > 1e8::DOUBLE THEN 0.0::DOUBLE ELSE x END, 4) AS x FROM cells""",
)
def _(spark, d):
    # the second feature is text, the third is too large for some customers
    rows = customer_features(spark, d)
    lines = rows.select(
        "subgraph_id",
        tabbed(F.lit("0"), "id", F.get("features", F.lit(0)).cast("string"), F.lit("n/a"), (F.get("features", F.lit(2)) * 100).cast("string"), "label"),
    )
    return long_form(readers.read_subgraph_nodes(spark, written(lines, "nodes")), ["subgraph_id", "id", "label"], digits=4)


@query(
    "read_subgraph_edges",
    with_(NATION_SQL)
    + "SELECT subgraph_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(w AS DOUBLE) AS intimacy FROM nation_edges",
)
def _(spark, d):
    lines = nation_edges(spark, d).select("subgraph_id", tabbed(F.lit("a"), F.lit("b"), "src", "dst", "w"))
    return readers.read_subgraph_edges(spark, written(lines, "edges"), sep=None)


@query(
    "read_libsvm_nodes",
    """WITH tokens AS (
      SELECT event_id, user_id % 5 AS idx, value AS val FROM events
      UNION ALL SELECT event_id, user_id % 5, value * 1000 FROM events
      UNION ALL SELECT event_id, 6, 0.0 FROM events)
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(idx AS INTEGER) AS idx,
      ROUND(SUM(CASE WHEN val > 10000 THEN LN(val) ELSE val END), 6) AS val FROM tokens GROUP BY 1, 2""",
)
def _(spark, d):
    # the event type is no index and the last token has no value
    idx = (F.col("user_id") % 5 + 1).cast("string")
    token = lambda v: F.concat_ws(":", idx, v.cast("string"))
    lines = table(spark, d, "events").select(
        tabbed(F.lit("0"), "event_id", token(F.col("value")), F.concat_ws(":", "event_type", F.lit("3")), token(F.col("value") * 1000), F.lit("7"))
    )
    nodes = readers.parse_libsvm_nodes(readers.read_lines(spark, written(lines, "libsvm")), n_features=7)
    return readers.sparse_cells(nodes).withColumn("val", F.round("val", 6))


@query(
    "read_composite_edges",
    with_(TRADE_SQL)
    + """SELECT 'c' || chr(9) || src AS src, 's' || chr(9) || dst AS dst, CAST(w AS DOUBLE) AS intimacy FROM trade""",
)
def _(spark, d):
    lines = trade(spark, d).select(tabbed(F.lit("x"), F.lit("y"), F.lit("c"), "src", F.lit("s"), "dst", "w"))
    return readers.parse_composite_edges(readers.read_lines(spark, written(lines, "composite")))


@query("read_id_list", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority LIKE '1%'")
def _(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority LIKE '1%'").select(tabbed(F.lit("x"), "o_custkey"))
    return readers.read_id_list(spark, written(ids, "ids"))


@query(
    "read_word2vec_text",
    with_(VECTOR_SQL)
    + """SELECT id, CAST(i - 1 AS INTEGER) AS idx, ROUND(CAST(vec[i] AS DOUBLE), 5) AS x
    FROM vectors, range(1, 65) r(i)""",
)
def _(spark, d):
    rows = vectors(spark, d).select(F.concat_ws(" ", (F.col("id") + 1).cast("string"), F.concat_ws(" ", F.transform("vec", lambda x: x.cast("string")))).alias("value"))
    header = vectors(spark, d).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" 64")).alias("value"))
    path = written(header.union(rows), "word2vec")
    back = readers.read_word2vec_text(spark, path)
    return long_form(back.withColumn("vec", F.col("vec").cast("array<float>")), ["id"], "vec", 5)


@query("read_delimited_edges", with_(TRADE_SQL) + "SELECT src, dst, w FROM trade")
def _(spark, d):
    lines = trade(spark, d).select(F.concat_ws(readers.SOH, *[F.col(c).cast("string") for c in ("src", "dst", "w")]).alias("value"))
    return readers.read_delimited_edges(spark, written(lines, "delimited"))


EMB_SQL = """SELECT subgraph_id, CAST(id AS VARCHAR) AS id, CAST(i - 1 AS INTEGER) AS idx, ROUND(CAST(vec[i] AS DOUBLE), 5) AS x
    FROM vectors, range(1, 65) r(i)"""


@query("read_embeddings", with_(VECTOR_SQL) + EMB_SQL)
def _(spark, d):
    path = new_path(spark, "embeddings")
    writers.write_embeddings(vectors(spark, d), path)
    return long_form(readers.read_embeddings(spark, path), ["subgraph_id", "id"], "vec", 5)


@query("write_partition", with_(NATION_SQL) + "SELECT id, subgraph_id AS part FROM nation_nodes")
def _(spark, d):
    path = new_path(spark, "partition")
    writers.write_partition(nation_nodes(spark, d).select("id", F.col("subgraph_id").alias("part")), path)
    return spark.read.csv(path, sep="\t", schema="id BIGINT, part INT")


@query("write_levels", with_(NATION_SQL) + "SELECT id, id % 7 AS label FROM nation_nodes")
def _(spark, d):
    from graphloom.plans.partition import read_levels, write_level

    path = new_path(spark, "levels")
    nodes = nation_nodes(spark, d)
    for level, m in ((1, 97), (2, 7)):
        write_level(nodes.select("id", (F.col("id") % m).alias("label")), path, level)
    return read_levels(spark, path, 2)


@query("write_scores", "SELECT CAST(c_custkey AS VARCHAR) AS id, ROUND(c_acctbal / 1000, 6) AS p FROM customer")
def _(spark, d):
    path = new_path(spark, "scores")
    scores = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 1000, 6).alias("p"))
    writers.write_scores(scores, path)
    return spark.read.csv(path, sep="\t", schema="id STRING, p DOUBLE").withColumn("p", F.round("p", 6))


@query(
    "write_merged_embeddings",
    with_(VECTOR_SQL)
    + """SELECT '20210103' AS dt, CAST(id + shift AS VARCHAR) AS id, CAST(i - 1 AS INTEGER) AS idx, ROUND(CAST(vec[i] AS DOUBLE), 5) AS x
    FROM vectors, (SELECT unnest([0, 1000000]) AS shift), range(1, 65) r(i)""",
)
def _(spark, d):
    path = new_path(spark, "merged")
    one = vectors(spark, d).select("id", "vec")
    writers.write_merged_embeddings({"a": one, "b": one.withColumn("id", F.col("id") + 1000000)}, "20210103", path)
    schema = "dt STRING, id STRING, " + ", ".join(f"v{i} FLOAT" for i in range(1, 65))
    back = spark.read.csv(path, sep=readers.SOH, schema=schema)
    back = back.select("dt", "id", F.array(*[F.col(f"v{i}") for i in range(1, 65)]).alias("vec"))
    return long_form(back, ["dt", "id"], "vec", digits=5)


@query(
    "merge_embeddings",
    with_(VECTOR_SQL)
    + """SELECT source, '20210103' AS dt, CAST(id AS VARCHAR) AS id, CAST(i - 1 AS INTEGER) AS idx, ROUND(CAST(vec[i] AS DOUBLE), 6) AS x
    FROM (SELECT 'a' AS source, id, vec FROM vectors UNION ALL SELECT 'b', id, list_reverse(vec) FROM vectors), range(1, 65) r(i)""",
)
def _(spark, d):
    one = vectors(spark, d)
    merged = writers.merge_embeddings({"a": one, "b": one.withColumn("vec", F.reverse("vec"))}, "20210103", keep_source=True)
    return long_form(merged, ["source", "dt", "id"], "vec")


@query(
    "write_augmented_edges",
    with_(NATION_SQL)
    + """SELECT subgraph_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(w AS DOUBLE) AS intimacy FROM nation_edges
    UNION ALL SELECT subgraph_id, CAST(dst AS VARCHAR), CAST(src AS VARCHAR), 1.0::DOUBLE FROM nation_edges WHERE w % 2 = 0""",
)
def _(spark, d):
    edges = nation_edges(spark, d).select("subgraph_id", F.lit("a").alias("c0"), F.lit("b").alias("c1"), "src", "dst", F.col("w").cast("double").alias("intimacy"))
    path = new_path(spark, "augmented")
    writers.write_augmented_edges(edges, E.reverse_edges(edges.filter("intimacy % 2 = 0")), path)
    return readers.read_subgraph_edges(spark, path)


@query(
    "overwrite_partition",
    with_(NATION_SQL) + "SELECT id, subgraph_id + 1 AS part FROM nation_nodes",
)
def _(spark, d):
    path = new_path(spark, "partition")
    parts = nation_nodes(spark, d).select("id", F.col("subgraph_id").alias("part"))
    writers.write_partition(parts, path)
    writers.write_partition(parts.withColumn("part", F.col("part") + 1), path)
    return spark.read.csv(path, sep="\t", schema="id BIGINT, part INT")


@query(
    "running_size",
    """WITH sums AS (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS length,
      SUM(CAST(o_totalprice AS BIGINT)) OVER (ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
      FROM (SELECT o_orderkey, FLOOR(o_totalprice) AS o_totalprice FROM orders))
    SELECT o_orderkey, length, CAST(COALESCE(earlier, 0) AS BIGINT) AS before FROM sums WHERE COALESCE(earlier, 0) < 100000000""",
)
def _(spark, d):
    sized = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("length"), (-F.col("o_orderkey")).alias("_age"))
    return files.running_size(sized, 100_000_000, ties="o_orderkey").select("o_orderkey", "length", "before")
