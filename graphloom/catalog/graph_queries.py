"""Edge-table operators, label propagation, coarsening and pruning on the trade graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.common import Catalog, draw_sql, with_
from graphloom.catalog.tables import (
    NATION_SQL,
    TRADE_SQL,
    TRIANGLE_SQL,
    nation_edges,
    nation_nodes,
    placed_triangles,
    table,
    trade,
    triangles,
)
from graphloom.functions import scalars
from graphloom.functions.draws import portable_draw
from graphloom.operators import edges as E
from graphloom.operators import labels as L
from graphloom.operators import ordering as O
from graphloom.operators import sampling as S
from graphloom.plans import partition as G
from graphloom.plans import prune as R
from graphloom.scratch import cut

CATALOG = Catalog()
query = CATALOG.query


# ---- projections


@query("log_weight", with_(TRADE_SQL) + "SELECT src, dst, ROUND(LN(1.1::DOUBLE + w), 6) AS w FROM trade")
def _(spark, d):
    return trade(spark, d).select("src", "dst", F.round(scalars.log_weight("w"), 6).alias("w"))


@query(
    "default_weight",
    with_(TRADE_SQL)
    + "SELECT src, dst, COALESCE(CASE WHEN w % 7 > 0 THEN CAST(w AS DOUBLE) END, 1.0::DOUBLE) AS w FROM trade",
)
def _(spark, d):
    holes = F.when(F.col("w") % 7 > 0, F.col("w").cast("double"))
    return E.with_default_weight(trade(spark, d).withColumn("w", holes))


SELF_LOOP_SQL = """loops AS (
  SELECT a.l_suppkey % 50 AS src, a.l_partkey % 50 AS dst, CAST(a.l_quantity AS BIGINT) AS w FROM lineitem a
)"""


def _small_ids(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_quantity").cast("bigint").alias("w")
    )


@query("drop_self_loops", with_(SELF_LOOP_SQL) + "SELECT src, dst, w FROM loops WHERE src <> dst")
def _(spark, d):
    return E.drop_self_loops(_small_ids(spark, d))


@query("reverse_edges", with_(TRADE_SQL) + "SELECT dst AS src, src AS dst, w FROM trade")
def _(spark, d):
    return E.reverse_edges(trade(spark, d))


@query(
    "both_directions",
    with_(TRADE_SQL) + "SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade",
)
def _(spark, d):
    return E.both_directions(trade(spark, d))


@query(
    "add_self_loops",
    with_(NATION_SQL)
    + """SELECT subgraph_id, src, dst, SUM(w) AS w FROM (
      SELECT subgraph_id, src, dst, CAST(w AS DOUBLE) AS w FROM nation_edges
      UNION ALL SELECT subgraph_id, id, id, 1.0::DOUBLE FROM nation_nodes) GROUP BY ALL""",
)
def _(spark, d):
    return E.add_self_loops(nation_edges(spark, d), nation_nodes(spark, d), by=["subgraph_id"])


@query(
    "init_labels",
    with_(TRADE_SQL) + "SELECT id, id AS label FROM (SELECT src AS id FROM trade UNION SELECT dst FROM trade)",
)
def _(spark, d):
    return E.init_labels(trade(spark, d))


@query(
    "composite_key",
    with_(TRADE_SQL)
    + """SELECT k AS node_key, SPLIT_PART(k, chr(9), 1) AS a, SPLIT_PART(k, chr(9), 2) AS b
    FROM (SELECT CAST(src AS VARCHAR) || chr(9) || CAST(dst AS VARCHAR) AS k FROM trade)""",
)
def _(spark, d):
    keyed = trade(spark, d).select(
        scalars.composite_key(F.col("src").cast("string"), F.col("dst").cast("string")).alias("node_key")
    )
    a, b = scalars.split_composite_key("node_key")
    return keyed.select("node_key", a.alias("a"), b.alias("b"))


@query(
    "local_index",
    with_(NATION_SQL)
    + """SELECT subgraph_id, id, CAST(ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY id) - 1 AS BIGINT) AS local_idx
    FROM nation_nodes""",
)
def _(spark, d):
    return E.local_index(nation_nodes(spark, d))


@query(
    "dense_ids",
    with_(TRADE_SQL)
    + """SELECT id, CAST(ROW_NUMBER() OVER (ORDER BY id) AS BIGINT) AS idx
    FROM (SELECT src AS id FROM trade UNION SELECT dst FROM trade)""",
)
def _(spark, d):
    return E.dense_ids(E.distinct_nodes(trade(spark, d)))


# ---- aggregations


@query(
    "out_strength",
    with_(TRADE_SQL)
    + "SELECT src, COUNT(*) AS degree, CAST(SUM(w) AS BIGINT) AS strength FROM trade GROUP BY 1",
)
def _(spark, d):
    return E.out_strength(trade(spark, d))


@query("degree", with_(TRIANGLE_SQL) + "SELECT src, CAST(SUM(w) AS BIGINT) AS degree FROM triangles GROUP BY 1")
def _(spark, d):
    return E.degree(triangles(spark, d))


@query(
    "sum_duplicate_edges",
    f"""SELECT o_custkey AS src, l_suppkey AS dst, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return E.sum_duplicate_edges(
        rows.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("w"))
    )


@query(
    "symmetrize_max",
    with_(SELF_LOOP_SQL)
    + """SELECT src, dst, MAX(w) AS w FROM (SELECT src, dst, w FROM loops UNION ALL SELECT dst, src, w FROM loops)
    GROUP BY 1, 2""",
)
def _(spark, d):
    return E.symmetrize_max(_small_ids(spark, d))


@query(
    "distinct_nodes",
    with_(NATION_SQL)
    + "SELECT subgraph_id, src AS id FROM nation_edges UNION SELECT subgraph_id, dst FROM nation_edges",
)
def _(spark, d):
    return E.distinct_nodes(nation_edges(spark, d), by=["subgraph_id"])


@query(
    "graph_counts",
    with_(TRADE_SQL)
    + """SELECT (SELECT COUNT(*) FROM (SELECT src FROM trade UNION SELECT dst FROM trade)) AS n_nodes,
    (SELECT COUNT(*) FROM trade) AS n_edges""",
)
def _(spark, d):
    return E.graph_counts(trade(spark, d))


INCIDENT_SQL = "incident AS (SELECT src AS id, w FROM trade UNION ALL SELECT dst, w FROM trade)"


@query("incident_weights", with_(TRADE_SQL, INCIDENT_SQL) + "SELECT id, w FROM incident")
def _(spark, d):
    return E.incident_weights(trade(spark, d))


@query(
    "node_weight_range",
    with_(TRADE_SQL, INCIDENT_SQL) + "SELECT id, MIN(w) AS min_w, MAX(w) AS max_w FROM incident GROUP BY 1",
)
def _(spark, d):
    return E.node_weight_range(trade(spark, d))


@query(
    "nnz",
    with_(NATION_SQL)
    + """SELECT subgraph_id, COUNT(CASE WHEN w % 3 <> 0 THEN 1 END) AS nnz FROM nation_edges GROUP BY 1""",
)
def _(spark, d):
    return E.nnz(nation_edges(spark, d).withColumn("w", F.col("w") % 3), by=["subgraph_id"])


# ---- joins


@query(
    "induced_edges",
    with_(TRADE_SQL)
    + """SELECT src, dst, w FROM trade
    WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
      AND dst IN (SELECT 100000000 + s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def _(spark, d):
    rich = (
        table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
        .union(table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey") + 100000000))
    )
    return E.induced_edges(trade(spark, d), rich)


@query(
    "flag_members",
    """SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS is_member
    FROM customer""",
)
def _(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority LIKE '1%'").select("o_custkey")
    return E.flag_members(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), ids)


CANDIDATE_SQL = """candidates AS (
  SELECT DISTINCT 100000000 + l_suppkey AS src, l_partkey % (SELECT COUNT(*) FROM customer) AS dst FROM lineitem
)"""


@query(
    "new_pairs_only",
    with_(TRADE_SQL, CANDIDATE_SQL)
    + """SELECT src, dst FROM candidates c WHERE NOT EXISTS (
      SELECT 1 FROM trade t WHERE (t.src = c.src AND t.dst = c.dst) OR (t.src = c.dst AND t.dst = c.src))""",
)
def _(spark, d):
    n = table(spark, d, "customer").count()
    pairs = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") + 100000000).alias("src"), (F.col("l_partkey") % n).alias("dst")
    )
    return E.new_pairs_only(pairs.distinct(), trade(spark, d))


@query(
    "threshold_join",
    with_(TRADE_SQL, INCIDENT_SQL, "mean AS (SELECT id, AVG(w) AS t FROM incident GROUP BY 1)")
    + """SELECT e.src, e.dst, e.w FROM trade e JOIN mean a ON a.id = e.src JOIN mean b ON b.id = e.dst
    WHERE e.w >= a.t OR e.w >= b.t""",
)
def _(spark, d):
    edges = trade(spark, d)
    means = E.incident_weights(edges).groupBy("id").agg(F.avg("w").alias("threshold"))
    return E.threshold_join(edges, means, value="w", how="or")


MAPPING_SQL = """mapping AS (
  SELECT id, (id % 997) * (id % 2) AS label FROM (SELECT src AS id FROM triangles UNION SELECT dst FROM triangles)
)"""


def _mapping(edges):
    # half of the nodes share label 0, the others are spread over many labels
    return E.distinct_nodes(edges).withColumn("label", (F.col("id") % 997) * (F.col("id") % 2))


@query(
    "relabel_edges",
    with_(TRIANGLE_SQL, MAPPING_SQL)
    + """SELECT a.label AS src, b.label AS dst, e.w FROM triangles e
    JOIN mapping a ON e.src = a.id JOIN mapping b ON e.dst = b.id""",
)
def _(spark, d):
    edges = triangles(spark, d, kept="dst")
    return E.relabel_edges(edges, _mapping(edges))


@query(
    "coarse_edges",
    with_(TRIANGLE_SQL, MAPPING_SQL)
    + """SELECT a.label AS src, b.label AS dst, CAST(SUM(e.w) AS BIGINT) AS w, COUNT(*) AS n FROM triangles e
    JOIN mapping a ON e.src = a.id JOIN mapping b ON e.dst = b.id WHERE a.label <> b.label GROUP BY 1, 2""",
)
def _(spark, d):
    edges = triangles(spark, d, kept="dst")
    return E.coarse_edges(edges, _mapping(edges))


@query(
    "coarse_node_weight",
    with_(TRIANGLE_SQL, MAPPING_SQL) + "SELECT label AS id, COUNT(*) AS node_w FROM mapping GROUP BY 1",
)
def _(spark, d):
    return E.coarse_node_weight(_mapping(triangles(spark, d)))


@query(
    "left_join_default",
    """SELECT c_custkey AS id, COALESCE(n, 1) AS node_w FROM customer LEFT JOIN (
      SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def _(spark, d):
    weights = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("node_w"))
    return E.left_join_default(
        table(spark, d, "customer").select(F.col("c_custkey").alias("id")), weights, "id", {"node_w": F.lit(1).cast("bigint")}
    )


@query(
    "compose_levels",
    with_(TRIANGLE_SQL, MAPPING_SQL) + "SELECT id, label % 7 AS label FROM mapping",
)
def _(spark, d):
    fine = _mapping(triangles(spark, d))
    coarse = fine.select(F.col("label").alias("id")).distinct().withColumn("label", F.col("id") % 7)
    return E.compose_levels(fine, coarse)


# ---- rank and order statistics


@query(
    "node_weight_threshold",
    with_(TRADE_SQL, INCIDENT_SQL)
    + """SELECT id, w AS threshold FROM (
      SELECT id, w, ROW_NUMBER() OVER (PARTITION BY id ORDER BY w) - 1 AS pos, COUNT(*) OVER (PARTITION BY id) AS n
      FROM incident) WHERE pos = CAST(FLOOR(CAST(0.9 AS DOUBLE) * n) AS BIGINT)""",
)
def _(spark, d):
    return R.node_weight_threshold(trade(spark, d), 0.9)


@query(
    "order_statistics",
    with_(NATION_SQL)
    + """, ranked AS (
      SELECT subgraph_id, w, ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY w) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY subgraph_id) AS n FROM nation_edges)
    SELECT subgraph_id, MAX(CASE WHEN pos = CAST(FLOOR(CAST(0.05 AS DOUBLE) * n) AS BIGINT) THEN w END) AS low,
      MAX(CASE WHEN pos = CAST(FLOOR((1 - CAST(0.05 AS DOUBLE)) * n) AS BIGINT) THEN w END) AS high, MAX(n) AS n
    FROM ranked GROUP BY 1""",
)
def _(spark, d):
    return O.order_statistics(nation_edges(spark, d), "w", {"low": 0.05, "high": 1 - 0.05}, by=["subgraph_id"])


@query(
    "adjacency_list",
    with_(TRADE_SQL)
    + "SELECT src, CAST(0 AS BIGINT) AS part, STRING_AGG(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS neighbours FROM trade GROUP BY 1",
)
def _(spark, d):
    return E.adjacency_list(trade(spark, d))


# ---- pruning


@query(
    "prune_by_weight",
    with_(
        TRADE_SQL,
        INCIDENT_SQL,
        """thr AS (SELECT id, w AS t FROM (
          SELECT id, w, ROW_NUMBER() OVER (PARTITION BY id ORDER BY w) - 1 AS pos, COUNT(*) OVER (PARTITION BY id) AS n
          FROM incident) WHERE pos = CAST(FLOOR(CAST(0.9 AS DOUBLE) * n) AS BIGINT))""",
    )
    + """SELECT e.src, e.dst, e.w FROM trade e JOIN thr a ON a.id = e.src JOIN thr b ON b.id = e.dst
    WHERE e.w >= a.t AND e.w >= b.t""",
)
def _(spark, d):
    return R.prune_by_weight(trade(spark, d), 0.9)


def pagerank_ctes(edges: str, steps: int) -> list[str]:
    """Unrolled PageRank over ``edges(subgraph_id, src, dst, w)``; gives ``pr{steps}``."""
    ctes = [
        f"""und AS (SELECT subgraph_id, LEAST(src, dst) AS a, GREATEST(src, dst) AS b, MAX(w) AS w FROM {edges} GROUP BY 1, 2, 3)""",
        """arcs AS (SELECT subgraph_id, a AS src, b AS dst, w FROM und UNION ALL
          SELECT subgraph_id, b, a, w FROM und WHERE a <> b)""",
        """shares AS (SELECT subgraph_id, src, dst, w / SUM(w) OVER (PARTITION BY subgraph_id, src) AS share FROM arcs)""",
        """pr0 AS (SELECT subgraph_id, id, n, 1.0::DOUBLE / n AS rank FROM (
          SELECT subgraph_id, src AS id, COUNT(*) OVER (PARTITION BY subgraph_id) AS n
          FROM (SELECT DISTINCT subgraph_id, src FROM arcs)))""",
    ]
    for i in range(1, steps + 1):
        ctes.append(
            f"""pr{i} AS MATERIALIZED (SELECT p.subgraph_id, p.id, p.n,
              0.85::DOUBLE * COALESCE(f.flow, 0) + (1 - 0.85::DOUBLE) / p.n AS rank
              FROM pr{i - 1} p LEFT JOIN (
                SELECT s.subgraph_id, s.dst AS id, SUM(q.rank * s.share) AS flow
                FROM shares s JOIN pr{i - 1} q ON s.subgraph_id = q.subgraph_id AND s.src = q.id GROUP BY 1, 2
              ) f ON p.subgraph_id = f.subgraph_id AND p.id = f.id)"""
        )
    return ctes


LOGGED_SQL = """logged AS (SELECT subgraph_id, src, dst, LN(1.1::DOUBLE + w) AS w FROM nation_edges)"""


def _logged(spark, d):
    return nation_edges(spark, d).withColumn("w", scalars.log_weight("w"))


@query(
    "pagerank",
    with_(NATION_SQL, LOGGED_SQL, *pagerank_ctes("logged", 10))
    + "SELECT subgraph_id, id, ROUND(rank, 9) AS rank FROM pr10",
)
def _(spark, d):
    ranks = R.pagerank(_logged(spark, d), by=["subgraph_id"], tol=None, max_iter=10)
    return ranks.withColumn("rank", F.round("rank", 9))


@query(
    "prune_by_pagerank",
    with_(
        NATION_SQL,
        LOGGED_SQL,
        *pagerank_ctes("logged", 10),
        "ranks AS (SELECT subgraph_id, id, ROUND(rank, 9) AS rank FROM pr10)",
        """low AS (SELECT subgraph_id, rank AS t FROM (SELECT subgraph_id, rank,
          ROW_NUMBER() OVER (PARTITION BY subgraph_id ORDER BY rank) - 1 AS pos,
          COUNT(*) OVER (PARTITION BY subgraph_id) AS n FROM ranks)
          WHERE pos = CAST(FLOOR(CAST(0.5 AS DOUBLE) * n) AS BIGINT))""",
    )
    + """SELECT e.subgraph_id, e.src, e.dst, ROUND(e.w, 6) AS w FROM logged e
    JOIN ranks a ON a.subgraph_id = e.subgraph_id AND a.id = e.src
    JOIN ranks b ON b.subgraph_id = e.subgraph_id AND b.id = e.dst
    JOIN low l ON l.subgraph_id = e.subgraph_id WHERE a.rank >= l.t OR b.rank >= l.t""",
)
def _(spark, d):
    kept = R.prune_by_pagerank(_logged(spark, d), q=0.5, by=["subgraph_id"], tol=None, max_iter=10, digits=9)
    return kept.withColumn("w", F.round("w", 6))


# ---- sampling


def sample_sql(edges: str, seed: int, upper: int = 100) -> str:
    return f"""SELECT e.src, e.dst, e.w FROM {edges} e JOIN (
      SELECT src, COUNT(*) AS degree, SUM(w) AS strength FROM {edges} GROUP BY 1) s ON e.src = s.src
    WHERE CAST(e.w AS DOUBLE) / s.strength > 0.1::DOUBLE
       OR {draw_sql('e.src', 'e.dst', seed)} < LEAST({float(upper)}::DOUBLE / s.degree, 0.2::DOUBLE)"""


@query("sample_edges", with_(TRIANGLE_SQL) + sample_sql("triangles", 3))
def _(spark, d):
    return S.sample_edges(triangles(spark, d, kept=True), seed=3, draw=portable_draw)


@query(
    "sample_subgraphs",
    with_(
        "ids AS (SELECT DISTINCT c_nationkey AS subgraph_id FROM customer)",
        """ranked AS (SELECT subgraph_id, ROW_NUMBER() OVER (ORDER BY subgraph_id) - 1 AS pos, COUNT(*) OVER () AS k FROM ids)""",
    )
    + f"""SELECT CAST(i AS BIGINT) AS draw_no, CAST(subgraph_id AS INTEGER) AS subgraph_id
    FROM range(CAST(FLOOR(0.5::DOUBLE * (SELECT COUNT(*) FROM ids)) AS BIGINT)) r(i)
    JOIN ranked ON pos = CAST(FLOOR({draw_sql('i', 'i', 5)} * k) AS BIGINT)""",
)
def _(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("subgraph_id"))
    return S.sample_subgraphs(ids, 0.5, seed=5, draw=portable_draw)


BATCH_SQL = f"""{NATION_SQL},
batches AS (SELECT subgraph_id, CAST((ROW_NUMBER() OVER (ORDER BY {draw_sql('subgraph_id', 'subgraph_id', 2)}, subgraph_id) - 1) // 4 AS INTEGER) AS batch_id
  FROM (SELECT DISTINCT subgraph_id FROM nation_nodes)),
batched AS (SELECT n.id, b.batch_id FROM nation_nodes n JOIN batches b ON n.subgraph_id = b.subgraph_id),
batch_edges AS (SELECT a.batch_id, t.src, t.dst, t.w FROM trade t JOIN batched a ON t.src = a.id JOIN batched b ON t.dst = b.id
  WHERE a.batch_id = b.batch_id)"""


@query(
    "make_batches",
    with_(BATCH_SQL)
    + """SELECT e.batch_id, e.src, e.dst, ROUND(e.w / GREATEST(1.0::DOUBLE, g.degree), 9) AS val, z.nnz
    FROM batch_edges e JOIN (SELECT batch_id, src, SUM(w) AS degree FROM batch_edges GROUP BY 1, 2) g
      ON e.batch_id = g.batch_id AND e.src = g.src
    JOIN (SELECT batch_id, COUNT(CASE WHEN w <> 0 THEN 1 END) AS nnz FROM batch_edges GROUP BY 1) z ON e.batch_id = z.batch_id""",
)
def _(spark, d):
    from graphloom.operators.features import normalize_adjacency

    order = portable_draw("subgraph_id", "subgraph_id", 2)
    nodes, edges = S.make_batches(nation_nodes(spark, d), trade(spark, d), block_size=4, order=order)
    edges = cut(edges)  # read by the degrees, the cells and their number
    adj = normalize_adjacency(edges, nodes, "row", by=["batch_id"])
    return adj.join(E.nnz(edges, ["batch_id"]), "batch_id").select(
        "batch_id", F.col("row").alias("src"), F.col("col").alias("dst"), F.round("val", 9).alias("val"), "nnz"
    )


# ---- label propagation and coarsening


@query(
    "label_sizes",
    with_(TRIANGLE_SQL, MAPPING_SQL)
    + "SELECT label, COUNT(*) AS size, COUNT(*) >= 100 AS frozen FROM mapping GROUP BY 1",
)
def _(spark, d):
    return E.label_sizes(_mapping(triangles(spark, d)), cap=100)


STATE_SQL = """state AS (SELECT m.id, m.label, s.size, s.size >= 100 AS frozen FROM mapping m
  JOIN (SELECT label, COUNT(*) AS size FROM mapping GROUP BY 1) s ON m.label = s.label)"""
MESSAGE_SQL = """messages AS (SELECT e.src AS id, s.label, s.frozen, s.size, e.w FROM triangles e JOIN state s ON e.dst = s.id)"""
SCORE_SQL = """scores AS (SELECT id, label, ROUND(SUM(w / CAST(size AS DOUBLE)), 9) AS score FROM messages WHERE NOT frozen GROUP BY 1, 2)"""
BEST_SQL = """best AS (SELECT id, label AS new_label, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn FROM scores) WHERE rn = 1)"""


def _state(spark, d):
    edges = triangles(spark, d, kept="dst")
    return edges, L.label_state(_mapping(edges), 100)


@query("send_labels", with_(TRIANGLE_SQL, MAPPING_SQL, STATE_SQL, MESSAGE_SQL) + "SELECT id, label, frozen, size, w FROM messages")
def _(spark, d):
    return L.send_labels(*_state(spark, d))


@query("label_scores", with_(TRIANGLE_SQL, MAPPING_SQL, STATE_SQL, MESSAGE_SQL, SCORE_SQL) + "SELECT id, label, ROUND(score, 6) AS score FROM scores")
def _(spark, d):
    edges, state = _state(spark, d)
    return L.label_scores(L.send_labels(edges, state), L.known_rows(edges)).withColumn("score", F.round("score", 6))


@query("argmax_label", with_(TRIANGLE_SQL, MAPPING_SQL, STATE_SQL, MESSAGE_SQL, SCORE_SQL, BEST_SQL) + "SELECT id, new_label, ROUND(score, 6) AS score FROM best")
def _(spark, d):
    edges, state = _state(spark, d)
    return L.argmax_label(L.label_scores(L.send_labels(edges, state), L.known_rows(edges))).withColumn("score", F.round("score", 6))


@query(
    "update_labels",
    with_(TRIANGLE_SQL, MAPPING_SQL, STATE_SQL, MESSAGE_SQL, SCORE_SQL, BEST_SQL)
    + """SELECT s.id, CASE WHEN s.frozen OR b.new_label IS NULL THEN s.label ELSE b.new_label END AS label
    FROM state s LEFT JOIN best b ON s.id = b.id""",
)
def _(spark, d):
    edges, state = _state(spark, d)
    return L.update_labels(state, L.argmax_label(L.label_scores(L.send_labels(edges, state), L.known_rows(edges))))


def lp_ctes(edges: str, start: str, prefix: str, k: int, steps: int) -> list[str]:
    """Unrolled label propagation; gives ``{prefix}{steps}(id, label)``."""
    ctes = [
        f"{prefix}0 AS (SELECT id, label FROM {start})",
        f"{prefix}cap AS (SELECT GREATEST(2, COUNT(*) // {k}) AS cap FROM {start})",
    ]
    for i in range(1, steps + 1):
        prev = f"{prefix}{i - 1}"
        ctes.append(
            f"""{prefix}s{i} AS MATERIALIZED (SELECT m.id, m.label, z.size, z.size >= (SELECT cap FROM {prefix}cap) AS frozen
              FROM {prev} m JOIN (SELECT label, COUNT(*) AS size FROM {prev} GROUP BY 1) z ON m.label = z.label)"""
        )
        ctes.append(
            f"""{prefix}{i} AS MATERIALIZED (SELECT s.id, CASE WHEN s.frozen OR b.label IS NULL THEN s.label ELSE b.label END AS label
              FROM {prefix}s{i} s LEFT JOIN (
                SELECT id, label FROM (
                  SELECT id, label, ROW_NUMBER() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn FROM (
                    SELECT e.src AS id, t.label, ROUND(SUM(e.w / CAST(t.size AS DOUBLE)), 9) AS score
                    FROM {edges} e JOIN {prefix}s{i} t ON e.dst = t.id WHERE NOT t.frozen GROUP BY 1, 2)) WHERE rn = 1
              ) b ON s.id = b.id)"""
        )
    return ctes


START_SQL = "start AS (SELECT id, id AS label FROM (SELECT src AS id FROM triangles UNION SELECT dst FROM triangles))"


@query("lp_iteration", with_(TRIANGLE_SQL, START_SQL, *lp_ctes("triangles", "start", "lp", 64, 1)) + "SELECT id, label FROM lp1")
def _(spark, d):
    edges = triangles(spark, d, kept="dst")
    labels = cut(E.init_labels(edges), "labels")
    return L.lp_iteration(edges, labels, G.size_cap(labels.count(), 64))


@query("label_propagation", with_(TRIANGLE_SQL, START_SQL, *lp_ctes("triangles", "start", "lp", 64, 3)) + "SELECT id, label FROM lp3")
def _(spark, d):
    return G.label_propagation(placed_triangles(spark, d, "dst"), k=64, iterations=3)


def coarsen_ctes(k: int, rounds: int, steps: int) -> list[str]:
    """Unrolled coarsening of ``triangles``; gives ``levelled(id, label)`` and ``coarse_arcs``."""
    ctes = [TRIANGLE_SQL, START_SQL, "graph0 AS (SELECT src, dst, w FROM triangles)"]
    start = "start"
    for r in range(rounds):
        ctes.append(f"work{r} AS MATERIALIZED ({sample_sql(f'graph{r}', r)})")
        ctes += lp_ctes(f"work{r}", start, f"r{r}x", k, steps)
        ctes.append(
            f"""graph{r + 1} AS MATERIALIZED (SELECT a.label AS src, b.label AS dst, CAST(SUM(e.w) AS BIGINT) AS w
              FROM work{r} e JOIN r{r}x{steps} a ON e.src = a.id JOIN r{r}x{steps} b ON e.dst = b.id
              WHERE a.label <> b.label GROUP BY 1, 2)"""
        )
        start = f"start{r + 1}"
        ctes.append(f"{start} AS (SELECT DISTINCT label AS id, label FROM r{r}x{steps})")
    ctes.append(f"last AS ({sample_sql(f'graph{rounds}', rounds)})")
    ctes.append(
        "coarse_arcs AS (SELECT src, dst, MAX(w) AS w FROM (SELECT src, dst, w FROM last UNION ALL SELECT dst, src, w FROM last) GROUP BY 1, 2)"
    )
    chain = f"SELECT r0.id, r{rounds - 1}.label FROM r0x{steps} r0 " + " ".join(
        f"JOIN r{r}x{steps} r{r} ON r{r - 1}.label = r{r}.id" for r in range(1, rounds)
    )
    ctes.append(f"levelled AS ({chain})")
    return ctes


@query("coarsen", with_(*coarsen_ctes(16, 2, 3)) + """SELECT a.src, COALESCE(n.node_w, 1) AS node_w, a.dst, a.w FROM coarse_arcs a
    LEFT JOIN (SELECT label, COUNT(*) AS node_w FROM levelled GROUP BY 1) n ON a.src = n.label""")
def _(spark, d):
    coarse = G.coarsen(triangles(spark, d, kept=True), k=16, rounds=2, draw=portable_draw)
    weights = coarse.nodes.withColumnRenamed("id", "src")
    return E.left_join_default(coarse.edges, weights, "src", {"node_w": F.lit(1).cast("bigint")}).select("src", "node_w", "dst", "w")


@query("project_partition", with_(*coarsen_ctes(16, 2, 3)) + "SELECT id, CAST(label % 16 AS INTEGER) AS part FROM levelled")
def _(spark, d):
    coarse = G.coarsen(triangles(spark, d, kept=True), k=16, rounds=2, draw=portable_draw)
    parts = coarse.nodes.select("id", (F.col("id") % 16).cast("int").alias("part"))
    return G.project_partition(coarse.levels, coarse.rounds, parts, 16)


@query(
    "balanced_parts",
    with_(TRIANGLE_SQL)
    + """SELECT CAST(COUNT(*) AS BIGINT) AS total_w, TRUE AS each_once, TRUE AS in_range, TRUE AS within_slack, TRUE AS cut_below_random
    FROM (SELECT src FROM triangles UNION SELECT dst FROM triangles)""",
)
def _(spark, d):
    # all sweeps; no part above the slack and the heaviest node, and less weight between parts than 0.95 of a random cut's
    coarse = G.coarsen(triangles(spark, d, kept=True), k=8, rounds=1, lp_iterations=2)
    parts = cut(G.balanced_parts(coarse.edges, coarse.nodes, k=8), "parts")
    total, heaviest = coarse.nodes.agg(F.sum("node_w"), F.max("node_w")).first()
    load = parts.groupBy("part").agg(F.sum("node_w").alias("load")).agg(F.max("load")).first()[0]
    crossing = G.edge_cut(coarse.edges, parts.select("id", "part")).first()
    fits, good = load <= 1.05 * total / 8 + heaviest, crossing["cut_w"] <= 0.95 * (1 - 1 / 8) * crossing["total_w"]
    given = coarse.nodes.select(F.col("id").alias("coarse_id"))
    matched = parts.join(given, F.col("id") == F.col("coarse_id"), "full")
    once = (F.count("id") == F.count("coarse_id")) & (F.count(F.lit(1)) == F.count_distinct("id"))
    checks = [F.bool_and(F.col("part").between(0, 7)).alias("in_range"), F.lit(fits).alias("within_slack"), F.lit(good).alias("cut_below_random")]
    return matched.agg(F.sum("node_w").alias("total_w"), once.alias("each_once"), *checks)


@query(
    "partition_graph",
    with_(TRIANGLE_SQL)
    + "SELECT src AS id, TRUE AS in_range, TRUE AS within_slack FROM (SELECT src FROM triangles UNION SELECT dst FROM triangles)",
)
def _(spark, d):
    parts = cut(G.partition_graph(triangles(spark, d, kept=True), k=8, rounds=2, sweeps=6, slack=0.05), "parts")
    fits = parts.groupBy("part").agg((F.count(F.lit(1)) <= G.part_limit(parts.count(), 8, 0.05)).alias("within_slack"))
    return parts.join(fits, "part").select("id", F.col("part").between(0, 7).alias("in_range"), "within_slack")


@query(
    "materialize_subgraphs",
    with_(NATION_SQL)
    + """SELECT subgraph_id, src, dst, w FROM nation_edges""",
)
def _(spark, d):
    from graphloom.sources.writers import materialize_subgraphs

    parts = nation_nodes(spark, d).select("id", F.col("subgraph_id").alias("part"))
    _, edges = materialize_subgraphs(parts, trade(spark, d), nation_nodes(spark, d).select("id"))
    return edges.select("subgraph_id", "src", "dst", "w")
