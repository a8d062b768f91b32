"""Scalar transforms, feature preparation, adjacency normalisation, propagation and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.common import Catalog, draw_sql, long_form, with_
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
from graphloom.functions import scalars
from graphloom.functions.draws import portable_draw
from graphloom.operators import edges as E
from graphloom.operators import features as X
from graphloom.operators import similarity as M
from graphloom.plans import augment as A
from graphloom.plans import dgi as D
from graphloom.plans import gcn as G
from graphloom.scratch import cut

CATALOG = Catalog()
query = CATALOG.query

CELL_SQL = """
cells AS (
  SELECT subgraph_id, id, label, is_train, 0 AS idx, f1 AS x FROM customer_features
  UNION ALL SELECT subgraph_id, id, label, is_train, 1, f2 FROM customer_features
  UNION ALL SELECT subgraph_id, id, label, is_train, 2, f3 FROM customer_features
)"""


# ---- scalar transforms


@query(
    "clean_dense_feature",
    """SELECT c_custkey AS id, ROUND(CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END, 6) AS f0,
      ROUND(CASE WHEN c_acctbal * 20000 < 0 OR c_acctbal * 20000 > 1e8::DOUBLE THEN 0.0::DOUBLE ELSE c_acctbal * 20000 END, 2) AS f1,
      0.0::DOUBLE AS f2, CAST(c_nationkey AS DOUBLE) AS f3, 0.0::DOUBLE AS f4 FROM customer""",
)
def _(spark, d):
    # a signed number, a large number, a word, a padded whole number, infinity
    tokens = F.array(
        F.col("c_acctbal").cast("string"),
        (F.col("c_acctbal") * 20000).cast("string"),
        F.col("c_mktsegment"),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" ")),
        F.lit("inf"),
    )
    clean = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.clean_dense_feature(tokens).alias("f"))
    rounds = [6, 2, 6, 6, 6]
    return clean.select("id", *[F.round(F.get("f", F.lit(i)), r).alias(f"f{i}") for i, r in enumerate(rounds)])


@query(
    "clean_sparse_token",
    """SELECT event_id AS id, 0 AS token, CAST(user_id AS INTEGER) - 1 AS idx, ROUND(CASE WHEN value * 1000 > 10000 THEN LN(value * 1000) ELSE value * 1000 END, 6) AS val FROM events
    UNION ALL SELECT event_id, 1, CAST(user_id AS INTEGER) - 1, 0.0::DOUBLE FROM events
    UNION ALL SELECT event_id, 2, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM events""",
)
def _(spark, d):
    user = F.col("user_id").cast("string")
    tokens = F.array(
        F.concat_ws(":", user, (F.col("value") * 1000).cast("string")), F.concat_ws(":", user, "event_type"), F.concat_ws(":", "event_type", F.lit("1"))
    )
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.posexplode(tokens).alias("token", "t"))
    cell = scalars.clean_sparse_token("t")
    return rows.select("id", "token", cell.getField("idx").alias("idx"), F.round(cell.getField("val"), 6).alias("val"))


@query(
    "one_hot_label",
    with_(FEATURE_SQL)
    + """SELECT id, CASE WHEN label = '0' THEN 0 WHEN label = '1' THEN 1 END AS cls,
    CASE WHEN label = '0' THEN 1 ELSE 0 END AS is_0, CASE WHEN label = '1' THEN 1 ELSE 0 END AS is_1 FROM customer_features""",
)
def _(spark, d):
    hot = scalars.one_hot_label("label")
    return customer_features(spark, d).select("id", scalars.class_label("label").alias("cls"), F.get(hot, F.lit(0)).alias("is_0"), F.get(hot, F.lit(1)).alias("is_1"))


ID_SQL = "ids AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%')"


def _ids(spark, d):
    return table(spark, d, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("id"))


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"))


@query(
    "assign_split_train",
    with_(ID_SQL) + "SELECT c_custkey AS id, 'train' AS split, TRUE AS is_masked FROM customer WHERE c_custkey IN (SELECT id FROM ids)",
)
def _(spark, d):
    return X.assign_split(_customers(spark, d), _ids(spark, d), "train")


@query(
    "assign_split_eval",
    with_(ID_SQL)
    + """SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT id FROM ids) THEN 'eval' ELSE 'train' END AS split,
    c_custkey IN (SELECT id FROM ids) AS is_masked FROM customer""",
)
def _(spark, d):
    return X.assign_split(_customers(spark, d), _ids(spark, d), "eval")


@query("assign_split_test", "SELECT c_custkey AS id, 'test' AS split, TRUE AS is_masked FROM customer")
def _(spark, d):
    return X.assign_split(_customers(spark, d), None, "test")


@query("mask", with_(FEATURE_SQL) + "SELECT id, label = '1' AND f2 > 10 AS is_masked FROM customer_features")
def _(spark, d):
    test = (F.col("label") == "1") & (F.get("features", F.lit(1)) > 10)
    return X.mask_column(customer_features(spark, d), test).select("id", "is_masked")


@query(
    "range_split",
    """WITH p AS (SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS pos, c_nationkey AS label, COUNT(*) OVER () AS n FROM customer)
    SELECT id, pos, pos < 40 AS is_train, pos >= 40 AND pos < 90 AS is_val, pos >= n - 30 AS is_test,
      CASE WHEN pos < 40 THEN label END AS y_train, CASE WHEN pos >= 40 AND pos < 90 THEN label END AS y_val,
      CASE WHEN pos >= n - 30 THEN label END AS y_test FROM p""",
)
def _(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    placed = E.local_index(nodes, by=()).withColumnRenamed("local_idx", "pos")
    return X.range_split(placed, 40, 50, 30).drop("label")


LOGIT_SQL = """logits AS (SELECT id, f1 / 5000 AS a, f2 / 10 AS b, f3 / 1000000 AS c FROM customer_features)"""


def _logits(spark, d):
    scale = F.array(F.lit(5000.0), F.lit(10.0), F.lit(1000000.0))
    return customer_features(spark, d).select("id", F.zip_with("features", scale, lambda x, s: x / s).alias("l"))


@query(
    "predict_class",
    with_(FEATURE_SQL, LOGIT_SQL)
    + """SELECT id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS pred,
    CAST(a > 0 AS INTEGER) AS multi_0, CAST(c > 0 AS INTEGER) AS multi_2 FROM logits""",
)
def _(spark, d):
    multi = scalars.predict_multilabel("l")
    return _logits(spark, d).select("id", scalars.predict_class("l").alias("pred"), F.get(multi, F.lit(0)).alias("multi_0"), F.get(multi, F.lit(2)).alias("multi_2"))


@query(
    "softmax_sigmoid",
    with_(FEATURE_SQL, LOGIT_SQL)
    + """SELECT id, ROUND(EXP(a) / (EXP(a) + EXP(b) + EXP(c)), 6) AS p0, ROUND(EXP(c) / (EXP(a) + EXP(b) + EXP(c)), 6) AS p2,
    ROUND(1 / (1 + EXP(-a)), 6) AS s0 FROM logits""",
)
def _(spark, d):
    p = scalars.softmax("l")
    return _logits(spark, d).select(
        "id", F.round(F.get(p, F.lit(0)), 6).alias("p0"), F.round(F.get(p, F.lit(2)), 6).alias("p2"), F.round(scalars.sigmoid(F.get("l", F.lit(0))), 6).alias("s0")
    )


@query(
    "vector_text",
    with_(VECTOR_SQL)
    + """SELECT id, 64 AS n_tokens, ROUND(CAST(vec[1] AS DOUBLE), 5) AS v1, ROUND(CAST(vec[2] AS DOUBLE), 5) AS v2, ROUND(CAST(vec[64] AS DOUBLE), 5) AS v64 FROM vectors""",
)
def _(spark, d):
    text = vectors(spark, d).select("id", scalars.vec_to_string("vec").alias("t"))
    back = text.select("id", F.size(F.split("t", " ")).alias("n_tokens"), scalars.string_to_vec("t").alias("v"))
    wide = scalars.vec_to_columns(back, "v", 64)
    return wide.select("id", "n_tokens", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("v1", "v2", "v64")])


@query(
    "activations",
    with_(FEATURE_SQL, CELL_SQL)
    + "SELECT id, CAST(idx AS INTEGER) AS idx, GREATEST(x, 0.0::DOUBLE) AS relu, ROUND(CASE WHEN x < 0 THEN x * 0.25::DOUBLE ELSE x END, 6) AS leaky FROM cells",
)
def _(spark, d):
    pairs = F.arrays_zip(scalars.relu("features").alias("relu"), scalars.leaky("features", 0.25).alias("leaky"))
    return customer_features(spark, d).select("id", F.posexplode(pairs).alias("idx", "p")).select("id", "idx", "p.relu", F.round("p.leaky", 6).alias("leaky"))


@query(
    "layer_norm",
    with_(FEATURE_SQL, CELL_SQL)
    + """, s AS (SELECT id, AVG(x) AS mean, VAR_POP(x) AS var FROM cells GROUP BY 1)
    SELECT c.id, CAST(idx AS INTEGER) AS idx, ROUND((x - mean) / SQRT(var + 1e-9::DOUBLE) * (idx + 1) + 0.5::DOUBLE, 6) AS x FROM cells c JOIN s ON c.id = s.id""",
)
def _(spark, d):
    normed = scalars.layer_norm("features", offset=[0.5, 0.5, 0.5], scale=[1.0, 2.0, 3.0])
    return long_form(customer_features(spark, d).withColumn("features", normed), ["id"])


@query(
    "row_normalize",
    with_(FEATURE_SQL, CELL_SQL)
    + """, s AS (SELECT id, SUM(x) AS total FROM cells GROUP BY 1)
    SELECT c.id, CAST(idx AS INTEGER) AS idx, ROUND(CASE WHEN total = 0 THEN 0 ELSE x / total END, 6) AS x FROM cells c JOIN s ON c.id = s.id""",
)
def _(spark, d):
    return long_form(customer_features(spark, d).withColumn("features", scalars.row_normalize("features")), ["id"])


# ---- standardising and reading out


@query(
    "standardize",
    with_(FEATURE_SQL, CELL_SQL)
    + """, s AS (SELECT subgraph_id, idx, AVG(x) AS mean, STDDEV_POP(x) AS sd FROM cells GROUP BY 1, 2)
    SELECT c.subgraph_id, c.id, CAST(c.idx AS INTEGER) AS idx, ROUND(CASE WHEN sd = 0 THEN 0 ELSE (x - mean) / sd END, 6) AS x
    FROM cells c JOIN s ON c.subgraph_id = s.subgraph_id AND c.idx = s.idx""",
)
def _(spark, d):
    return long_form(X.standardize(customer_features(spark, d)), ["subgraph_id", "id"])


@query(
    "standardize_on_train",
    with_(FEATURE_SQL, CELL_SQL)
    + """, s AS (SELECT idx, AVG(x) AS mean, STDDEV_POP(x) AS sd FROM cells WHERE is_train GROUP BY 1)
    SELECT c.id, CAST(c.idx AS INTEGER) AS idx, ROUND((x - mean) / sd, 6) AS x FROM cells c JOIN s ON c.idx = s.idx""",
)
def _(spark, d):
    # a constant fourth feature must disappear
    nodes = customer_features(spark, d).withColumn("features", F.array_append("features", F.lit(7.0)))
    return long_form(X.standardize_on_train(nodes), ["id"])


@query(
    "readout_mean",
    with_(FEATURE_SQL, CELL_SQL)
    + "SELECT subgraph_id, CAST(idx AS INTEGER) AS idx, ROUND(AVG(x), 4) AS x FROM cells GROUP BY 1, 2",
)
def _(spark, d):
    return long_form(X.readout_mean(customer_features(spark, d)), ["subgraph_id"], digits=4)


@query(
    "readout_mean_masked",
    with_(FEATURE_SQL, CELL_SQL)
    + """SELECT subgraph_id, CAST(idx AS INTEGER) AS idx, ROUND(SUM(CASE WHEN is_train THEN x ELSE 0 END) / SUM(CAST(is_train AS INTEGER)), 4) AS x
    FROM cells GROUP BY 1, 2 HAVING SUM(CAST(is_train AS INTEGER)) > 0""",
)
def _(spark, d):
    out = long_form(X.readout_mean(customer_features(spark, d), mask="is_train"), ["subgraph_id"], digits=4)
    return out.filter("x IS NOT NULL")


# ---- adjacency and propagation

LOOPED_SQL = """
looped AS (
  SELECT subgraph_id, src, dst, SUM(w) AS w FROM (
    SELECT subgraph_id, src, dst, CAST(w AS DOUBLE) AS w FROM nation_edges
    UNION ALL SELECT subgraph_id, id, id, 1.0::DOUBLE FROM nation_nodes) GROUP BY 1, 2, 3
),
deg AS (SELECT subgraph_id, src AS id, SUM(w) AS d FROM looped GROUP BY 1, 2)"""
SYM_SQL = """
adj AS (
  SELECT l.subgraph_id, l.dst AS row, l.src AS col, l.w / SQRT(a.d + 1e-20::DOUBLE) / SQRT(b.d + 1e-20::DOUBLE) AS val
  FROM looped l JOIN deg a ON a.subgraph_id = l.subgraph_id AND a.id = l.src
  JOIN deg b ON b.subgraph_id = l.subgraph_id AND b.id = l.dst
)"""
SUB = ["subgraph_id"]


def _adjacency(spark, d, kind="sym_selfloop", **kw):
    return X.normalize_adjacency(nation_edges(spark, d), nation_nodes(spark, d), kind, by=SUB, **kw)


def _rounded(adj):
    return adj.withColumn("val", F.round("val", 6))


@query("normalize_sym_selfloop", with_(NATION_SQL, LOOPED_SQL, SYM_SQL) + "SELECT subgraph_id, row, col, ROUND(val, 6) AS val FROM adj")
def _(spark, d):
    return _rounded(_adjacency(spark, d))


@query(
    "normalize_sym",
    with_(NATION_SQL)
    + """, twoway AS (SELECT subgraph_id, src, dst, w FROM nation_edges UNION ALL SELECT subgraph_id, dst, src, w FROM nation_edges),
    dg AS (SELECT subgraph_id, src AS id, SUM(w) AS d FROM twoway GROUP BY 1, 2)
    SELECT l.subgraph_id, l.dst AS row, l.src AS col, ROUND(l.w / SQRT(a.d) / SQRT(b.d), 6) AS val FROM twoway l
    JOIN dg a ON a.subgraph_id = l.subgraph_id AND a.id = l.src JOIN dg b ON b.subgraph_id = l.subgraph_id AND b.id = l.dst""",
)
def _(spark, d):
    both = E.both_directions(nation_edges(spark, d))
    return _rounded(X.normalize_adjacency(both, nation_nodes(spark, d), "sym", by=SUB))


@query(
    "normalize_row",
    with_(NATION_SQL)
    + """SELECT e.subgraph_id, e.src AS row, e.dst AS col, ROUND(e.w / GREATEST(1.0::DOUBLE, g.d), 6) AS val FROM nation_edges e
    JOIN (SELECT subgraph_id, src, SUM(w) AS d FROM nation_edges GROUP BY 1, 2) g ON e.subgraph_id = g.subgraph_id AND e.src = g.src""",
)
def _(spark, d):
    return _rounded(_adjacency(spark, d, "row"))


@query(
    "normalize_diag_enhance",
    with_(NATION_SQL, LOOPED_SQL)
    + """SELECT l.subgraph_id, l.src AS row, l.dst AS col,
      ROUND(l.w / (a.d + 1e-20::DOUBLE) * CASE WHEN l.src = l.dst THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS val
    FROM looped l JOIN deg a ON a.subgraph_id = l.subgraph_id AND a.id = l.src""",
)
def _(spark, d):
    return _rounded(_adjacency(spark, d, "diag_enhance", diag_lambda=0.5))


# customers have their features, suppliers [s_acctbal, 1, 0]
NODE_FEATURE_SQL = """
node_cells AS (
  SELECT subgraph_id, id, idx, x / 997.3371::DOUBLE AS x FROM cells
  UNION ALL SELECT CAST(s_nationkey AS INTEGER), 100000000 + s_suppkey, i,
    CASE i WHEN 0 THEN s_acctbal / 997.3371::DOUBLE WHEN 1 THEN 1.0 ELSE 0.0 END FROM supplier, range(0, 3) r(i)
),
passed AS (
  SELECT a.subgraph_id, a.row AS id, c.idx, SUM(a.val * c.x) AS x FROM adj a
  JOIN node_cells c ON a.subgraph_id = c.subgraph_id AND a.col = c.id GROUP BY 1, 2, 3
)"""
NODE_CTES = (NATION_SQL, LOOPED_SQL, SYM_SQL, FEATURE_SQL, CELL_SQL, NODE_FEATURE_SQL)


def node_features(spark, d):
    customers = customer_features(spark, d).select(
        "subgraph_id", "id", F.transform("features", lambda x: x / 997.3371).alias("features")
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("int").alias("subgraph_id"),
        (F.col("s_suppkey") + 100000000).alias("id"),
        F.array(F.col("s_acctbal") / 997.3371, F.lit(1.0), F.lit(0.0)).alias("features"),
    )
    return customers.union(suppliers)


@query("message_pass", with_(*NODE_CTES) + "SELECT subgraph_id, id, CAST(idx AS INTEGER) AS idx, ROUND(x, 6) AS x FROM passed")
def _(spark, d):
    return long_form(X.message_pass(_adjacency(spark, d), node_features(spark, d), SUB), ["subgraph_id", "id"])


@query("message_pass_wide", with_(*NODE_CTES) + "SELECT subgraph_id, id, CAST(idx AS INTEGER) AS idx, ROUND(x, 6) AS x FROM passed")
def _(spark, d):
    return long_form(X.message_pass(_adjacency(spark, d), node_features(spark, d), SUB, dim=3), ["subgraph_id", "id"])


# six inputs [A.X, X] to two outputs
# many digits, so that no result lies halfway between two rounded values
WEIGHT = [
    [0.371328417, -0.213377921],
    [0.913372811, 0.517713391],
    [-0.131771913, 0.713119337],
    [0.217733119, 0.531197713],
    [-0.519911737, 0.971331177],
    [0.117713939, -0.371779133],
]
DGI_WEIGHT = WEIGHT[:3]


def _weight_sql(rows, first=0):
    cells = ", ".join(f"({first + i}, {j}, {v}::DOUBLE)" for i, r in enumerate(rows) for j, v in enumerate(r))
    return f"(VALUES {cells}) AS wt(i, j, v)"


@query(
    "gcn_layer",
    with_(*NODE_CTES)
    + f""", inputs AS (SELECT subgraph_id, id, idx, x FROM passed UNION ALL SELECT subgraph_id, id, idx + 3, x FROM node_cells),
    mixed AS (SELECT subgraph_id, id, j, SUM(x * v) AS y FROM inputs JOIN {_weight_sql(WEIGHT)} ON inputs.idx = wt.i GROUP BY 1, 2, 3),
    stats AS (SELECT subgraph_id, id, AVG(y) AS mean, VAR_POP(y) AS var FROM mixed GROUP BY 1, 2)
    SELECT m.subgraph_id, m.id, CAST(j AS INTEGER) AS idx,
      ROUND(GREATEST((y - mean) / SQRT(var + 1e-9::DOUBLE) * 2.0::DOUBLE + 0.5::DOUBLE, 0.0::DOUBLE), 4) AS x
    FROM mixed m JOIN stats s ON m.subgraph_id = s.subgraph_id AND m.id = s.id""",
)
def _(spark, d):
    out = G.gcn_layer(
        _adjacency(spark, d), node_features(spark, d), WEIGHT, SUB, norm=([0.5, 0.5], [2.0, 2.0]), act=scalars.relu
    )
    return long_form(out, ["subgraph_id", "id"], digits=4)


@query(
    "gcn_layer_bias",
    with_(*NODE_CTES)
    + f""", mixed AS (SELECT subgraph_id, id, j, SUM(x * v) + 0.1::DOUBLE AS y FROM passed JOIN {_weight_sql(DGI_WEIGHT)} ON passed.idx = wt.i GROUP BY 1, 2, 3)
    SELECT subgraph_id, id, CAST(j AS INTEGER) AS idx, ROUND(CASE WHEN y < 0 THEN 0.25::DOUBLE * y ELSE y END, 6) AS x FROM mixed""",
)
def _(spark, d):
    out = G.gcn_layer(
        _adjacency(spark, d), node_features(spark, d), DGI_WEIGHT, SUB, concat_self=False, bias=[0.1, 0.1],
        act=lambda v: scalars.leaky(v, 0.25),
    )
    return long_form(out, ["subgraph_id", "id"])


@query(
    "embed_dgi",
    with_(NATION_SQL, LOOPED_SQL, FEATURE_SQL, CELL_SQL)
    + f""", node_cells AS (
      SELECT subgraph_id, id, idx, x / 997.3371::DOUBLE AS x FROM cells
      UNION ALL SELECT CAST(s_nationkey AS INTEGER), 100000000 + s_suppkey, i,
        CASE i WHEN 0 THEN s_acctbal / 997.3371::DOUBLE WHEN 1 THEN 1.0 ELSE 0.0 END FROM supplier, range(0, 3) r(i)),
    row_total AS (SELECT subgraph_id, id, SUM(x) AS t FROM node_cells GROUP BY 1, 2),
    normed AS (SELECT c.subgraph_id, c.id, c.idx, CASE WHEN t = 0 THEN 0 ELSE x / t END AS x FROM node_cells c
      JOIN row_total r ON c.subgraph_id = r.subgraph_id AND c.id = r.id),
    adj AS (SELECT l.subgraph_id, l.dst AS row, l.src AS col, l.w / SQRT(a.d) / SQRT(b.d) AS val
      FROM looped l JOIN deg a ON a.subgraph_id = l.subgraph_id AND a.id = l.src
      JOIN deg b ON b.subgraph_id = l.subgraph_id AND b.id = l.dst),
    passed AS (SELECT a.subgraph_id, a.row AS id, c.idx, SUM(a.val * c.x) AS x FROM adj a
      JOIN normed c ON a.subgraph_id = c.subgraph_id AND a.col = c.id GROUP BY 1, 2, 3),
    mixed AS (SELECT subgraph_id, id, j, SUM(x * v) + 0.1::DOUBLE AS y FROM passed JOIN {_weight_sql(DGI_WEIGHT)} ON passed.idx = wt.i GROUP BY 1, 2, 3)
    SELECT subgraph_id, id, CAST(j AS INTEGER) AS idx, ROUND(CASE WHEN y < 0 THEN 0.25::DOUBLE * y ELSE y END, 5) AS x FROM mixed""",
)
def _(spark, d):
    import numpy as np

    model = D.init_dgi(3, 2, seed=0)
    model.params |= {"w": np.array(DGI_WEIGHT), "b": np.array([0.1, 0.1]), "a": np.array([0.25])}
    z = D.propagated(node_features(spark, d), nation_edges(spark, d), 3, SUB)
    return long_form(D.embed_dgi(model, z), ["subgraph_id", "id"], "vec", 5)


BILINEAR = [[0.513771937, -0.217739113, 0.131177993], [0.271133917, 0.971133779, -0.511739137], [0.737911331, 0.519371177, 0.231719377]]


@query(
    "bilinear_score",
    with_(FEATURE_SQL, CELL_SQL)
    + f""", scaled AS (SELECT subgraph_id, id, idx, x / 1000 AS x FROM cells),
    summary AS (SELECT subgraph_id, idx, AVG(x) AS c FROM scaled GROUP BY 1, 2),
    wc AS (SELECT subgraph_id, i, SUM(v * c) AS y FROM summary JOIN {_weight_sql(BILINEAR)} ON summary.idx = wt.j GROUP BY 1, 2)
    SELECT s.subgraph_id, s.id, ROUND(SUM(s.x * wc.y) + 0.5::DOUBLE, 4) AS score FROM scaled s
    JOIN wc ON s.subgraph_id = wc.subgraph_id AND s.idx = wc.i GROUP BY 1, 2""",
)
def _(spark, d):
    nodes = customer_features(spark, d).withColumn("features", F.transform("features", lambda x: x / 1000))
    scores = X.bilinear_score(nodes, X.readout_mean(nodes), BILINEAR, 0.5)
    return scores.withColumn("score", F.round("score", 4))


@query(
    "shuffle_features",
    with_(FEATURE_SQL)
    + f""", p AS (SELECT subgraph_id, id, ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY id) AS rn FROM customer_features),
    q AS (SELECT subgraph_id, f1, f2, ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY {draw_sql('id', 'id', 4)}, id) AS rn FROM customer_features)
    SELECT p.subgraph_id, p.id, f1, f2 FROM p JOIN q ON p.subgraph_id = q.subgraph_id AND p.rn = q.rn""",
)
def _(spark, d):
    out = X.shuffle_features(customer_features(spark, d), order=portable_draw("id", "id", 4))
    return out.select("subgraph_id", "id", F.get("features", F.lit(0)).alias("f1"), F.get("features", F.lit(1)).alias("f2"))


@query(
    "khop_pairs",
    with_(NATION_SQL)
    + """, twoway AS (SELECT subgraph_id, src, dst FROM nation_edges UNION SELECT subgraph_id, dst, src FROM nation_edges),
    base AS (SELECT * FROM twoway UNION SELECT subgraph_id, src, src FROM twoway)
    SELECT DISTINCT a.subgraph_id, a.src, b.dst FROM base a JOIN base b ON a.subgraph_id = b.subgraph_id AND a.dst = b.src""",
)
def _(spark, d):
    return X.khop_pairs(E.both_directions(nation_edges(spark, d)), 2, SUB)


@query(
    "attention_bias",
    with_(NATION_SQL)
    + """, even AS (SELECT subgraph_id, src, dst FROM nation_edges WHERE w % 2 = 0),
    hop AS (SELECT * FROM even UNION SELECT subgraph_id, dst, src FROM even
      UNION SELECT subgraph_id, src, src FROM even UNION SELECT subgraph_id, dst, dst FROM even),
    there AS (SELECT DISTINCT a.subgraph_id, a.src, c.dst FROM hop a JOIN hop b ON a.subgraph_id = b.subgraph_id AND a.dst = b.src
      JOIN hop c ON b.subgraph_id = c.subgraph_id AND b.dst = c.src)
    SELECT e.subgraph_id, e.src, e.dst, CASE WHEN t.src IS NULL THEN -1e9::DOUBLE ELSE 0.0::DOUBLE END AS bias
    FROM nation_edges e LEFT JOIN there t ON t.subgraph_id = e.subgraph_id AND t.src = e.src AND t.dst = e.dst""",
)
def _(spark, d):
    # every edge, by the edges of even weight
    edges = cut(nation_edges(spark, d))
    return X.attention_bias(edges.select(*SUB, "src", "dst"), E.both_directions(edges.filter("w % 2 = 0")), 3, SUB)


@query(
    "pack_graphs",
    with_(NATION_SQL)
    + """, n_max AS (SELECT MAX(n) + 2 AS n FROM (SELECT COUNT(*) AS n FROM nation_nodes GROUP BY subgraph_id)),
    placed AS (SELECT subgraph_id, id, CAST(ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY id) - 1 AS INTEGER) AS pos FROM nation_nodes),
    sized AS (SELECT subgraph_id, CAST(COUNT(*) AS INTEGER) AS size FROM nation_nodes GROUP BY 1)
    SELECT s.subgraph_id, CAST(i AS INTEGER) AS pos, s.size, CASE WHEN i < s.size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask,
      COALESCE(CAST(p.id AS DOUBLE), 0.0::DOUBLE) AS f1
    FROM sized s JOIN range(0, (SELECT n FROM n_max)) r(i) ON TRUE LEFT JOIN placed p ON p.subgraph_id = s.subgraph_id AND p.pos = i""",
)
def _(spark, d):
    nodes = nation_nodes(spark, d).withColumn("features", F.array(F.col("id").cast("double")))
    n_max = nodes.groupBy("subgraph_id").count().agg(F.max("count")).first()[0] + 2
    slots, _, sizes = X.pack_graphs(nodes, nation_edges(spark, d), n_max, dim=1)
    return slots.join(sizes, "subgraph_id").select("subgraph_id", "pos", "size", "mask", F.get("features", F.lit(0)).alias("f1"))


@query(
    "pack_graph_cells",
    with_(NATION_SQL)
    + """, placed AS (SELECT subgraph_id, id, CAST(ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY id) - 1 AS INTEGER) AS pos FROM nation_nodes)
    SELECT e.subgraph_id, a.pos AS row, b.pos AS col, 1.0::DOUBLE AS val FROM nation_edges e
    JOIN placed a ON a.subgraph_id = e.subgraph_id AND a.id = e.src JOIN placed b ON b.subgraph_id = e.subgraph_id AND b.id = e.dst""",
)
def _(spark, d):
    nodes = nation_nodes(spark, d).withColumn("features", F.array(F.lit(1.0)))
    n_max = nodes.groupBy("subgraph_id").count().agg(F.max("count")).first()[0]
    return X.pack_graphs(nodes, nation_edges(spark, d), n_max, dim=1)[1]


# ---- similarity and augmentation

TOP_SQL = """
wide AS (SELECT id, subgraph_id, CAST(vec AS DOUBLE[]) AS v FROM vectors),
sims AS (
  SELECT a.subgraph_id, a.id, b.id AS other, ROUND(LIST_COSINE_SIMILARITY(a.v, b.v), 9) AS sim
  FROM wide a JOIN wide b ON a.subgraph_id = b.subgraph_id AND a.id <> b.id
),
top AS (SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY sim DESC, other) AS INTEGER) AS rank FROM sims) WHERE rank <= 5)"""


@query("top_k_similar", with_(VECTOR_SQL, TOP_SQL) + "SELECT subgraph_id, id, other, ROUND(sim, 6) AS sim, rank FROM top")
def _(spark, d):
    return M.top_k_similar(vectors(spark, d), 5).withColumn("sim", F.round("sim", 6))


# edges between vectors of one group, from the line items
VEC_EDGE_SQL = """
picked AS (SELECT DISTINCT l_partkey % n AS src, (l_suppkey * 7 + l_linenumber) % n AS dst FROM lineitem, (SELECT COUNT(*) AS n FROM vectors)),
vec_edges AS (SELECT a.subgraph_id, e.src, e.dst FROM picked e JOIN vectors a ON e.src = a.id JOIN vectors b ON e.dst = b.id
  WHERE a.subgraph_id = b.subgraph_id AND e.src <> e.dst)"""


def _vec_edges(spark, d):
    vecs = vectors(spark, d).select("id", "subgraph_id")
    n = vecs.count()
    picked = table(spark, d, "lineitem").select(
        (F.col("l_partkey") % n).alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % n).alias("dst")
    )
    one, two = vecs.toDF("src", "a"), vecs.toDF("dst", "b")
    kept = picked.distinct().join(one, "src").join(two, "dst").filter("a = b AND src <> dst")
    return kept.select(F.col("a").alias("subgraph_id"), "src", "dst")


EDGE_SIM_SQL = """
edge_sims AS (SELECT e.subgraph_id, e.src, e.dst, ROUND(LIST_COSINE_SIMILARITY(a.v, b.v), 9) AS sim
  FROM vec_edges e JOIN wide a ON e.src = a.id JOIN wide b ON e.dst = b.id)"""


@query("edge_similarity", with_(VECTOR_SQL, VEC_EDGE_SQL, TOP_SQL, EDGE_SIM_SQL) + "SELECT subgraph_id, src, dst, ROUND(sim, 6) AS sim FROM edge_sims")
def _(spark, d):
    return M.edge_similarity(_vec_edges(spark, d), vectors(spark, d), SUB).withColumn("sim", F.round(F.round("sim", 9), 6))


@query(
    "augment_by_similarity",
    with_(
        VECTOR_SQL,
        VEC_EDGE_SQL,
        TOP_SQL,
        EDGE_SIM_SQL,
        """thr AS (SELECT subgraph_id, sim AS t FROM (SELECT subgraph_id, sim, ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY sim) - 1 AS pos,
          COUNT(*) OVER (PARTITION BY subgraph_id) AS n FROM edge_sims) WHERE pos = CAST(FLOOR(CAST(0.05 AS DOUBLE) * n) AS BIGINT))""",
    )
    + """SELECT e.subgraph_id, e.src, e.dst, 'kept' AS kind FROM edge_sims e JOIN thr ON e.subgraph_id = thr.subgraph_id WHERE e.sim >= thr.t
    UNION ALL SELECT t.subgraph_id, t.id, t.other, 'added' FROM top t
    WHERE t.id IN (SELECT src FROM vec_edges UNION SELECT dst FROM vec_edges)
      AND NOT EXISTS (SELECT 1 FROM vec_edges e WHERE (e.src = t.id AND e.dst = t.other) OR (e.src = t.other AND e.dst = t.id))""",
)
def _(spark, d):
    kept, added = A.augment_by_similarity(_vec_edges(spark, d), vectors(spark, d))
    return E.apply_augmentation(kept.withColumn("kind", F.lit("kept")), added.withColumn("kind", F.lit("added")))


# ---- set operations and key joins


@query(
    "apply_augmentation",
    with_(TRADE_SQL)
    + "SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, CAST(1 AS BIGINT) FROM trade",
)
def _(spark, d):
    edges = trade(spark, d)
    added = E.reverse_edges(edges).withColumn("w", F.lit(1).cast("bigint"))
    return E.apply_augmentation(edges, added)


@query(
    "stack_sources",
    """WITH a AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS INTEGER) AS label FROM supplier),
    b AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer)
    SELECT id, x, label, CAST(ROW_NUMBER() OVER (ORDER BY id) - 1 AS BIGINT) AS pos FROM a
    UNION ALL SELECT id, x, NULL, CAST(ROW_NUMBER() OVER (ORDER BY id) - 1 + (SELECT COUNT(*) FROM a) AS BIGINT) FROM b""",
)
def _(spark, d):
    labelled = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("int").alias("label"))
    others = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return X.stack_sources(labelled, others)


@query(
    "merge_graphs",
    with_(NATION_SQL)
    + """SELECT source, subgraph_id, COUNT(*) AS n_edges, CAST(SUM(w) AS BIGINT) AS w FROM (
      SELECT 'one' AS source, subgraph_id, w FROM nation_edges UNION ALL SELECT 'two', subgraph_id, 2 * w FROM nation_edges) GROUP BY 1, 2""",
)
def _(spark, d):
    edges = nation_edges(spark, d)
    merged = E.merge_graphs({"one": edges, "two": E.reverse_edges(edges).withColumn("w", 2 * F.col("w"))})
    return merged.groupBy("source", "subgraph_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("w"))


@query("attach_scores", "SELECT c_custkey AS id, c_name, c_acctbal / 2 AS p FROM customer")
def _(spark, d):
    customers = table(spark, d, "customer")
    scores = customers.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 2).alias("p"))
    return E.attach_scores(customers.select(F.col("c_custkey").alias("id"), "c_name"), scores)


@query(
    "unique_nodes",
    "SELECT o_custkey AS id, MAX(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return X.unique_nodes(rows, by=(), order="o_orderkey")
