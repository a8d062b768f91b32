"""Hand-worked micro graphs and properties of partitioning and pruning."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import ordering as O
from graphloom.operators import labels as L
from graphloom.operators import sampling as S
from graphloom.plans import partition as G
from graphloom.plans import prune as R
from graphloom.scratch import cut


def graph(spark, pairs, both=True):
    pairs = [p if len(p) == 3 else (*p, 1.0) for p in pairs]
    df = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in pairs], "src long, dst long, w double")
    return E.both_directions(df) if both else df


TWO_TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


def brute_lp(pairs, cap, iterations):
    arcs = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    label = {v: v for a, b, _ in arcs for v in (a, b)}
    for _ in range(iterations):
        size = {}
        for v in label.values():
            size[v] = size.get(v, 0) + 1
        new = {}
        for u in label:
            score = {}
            for a, b, w in arcs:
                if a == u and size[label[b]] < cap:
                    score[label[b]] = score.get(label[b], 0) + w / size[label[b]]
            best = min(((-round(s, 9), v) for v, s in score.items()), default=(0, None))[1]
            new[u] = label[u] if size[label[u]] >= cap or best is None else best
        label = new
    return sorted(label.items())


@pytest.mark.parametrize("iterations", [1, 2, 3])
def test_label_propagation_by_hand(spark, rows, iterations):
    edges = graph(spark, TWO_TRIANGLES)
    got = G.label_propagation(edges, k=2, iterations=iterations)
    assert rows(got, "id", "label") == brute_lp(TWO_TRIANGLES, 3, iterations)


def test_smallest_label_wins_a_tie(spark, rows):
    scores = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.1), (2, 0, 0.0)], "id long, label long, score double")
    assert rows(L.argmax_label(scores), "id", "new_label") == [(1, 3), (2, 0)]


def test_node_that_hears_nothing_keeps_its_label(spark, rows):
    # 9 is only ever a destination: it sends no edge, so it hears nothing
    edges = graph(spark, [(1, 9), (2, 9)], both=False)
    labels = G.label_propagation(edges, k=1, iterations=2)
    assert [r[0] for r in rows(labels, "id", "label")] == [1, 2, 9]
    assert dict(rows(labels, "id", "label"))[9] == 9


def test_sampling_keeps_heavy_edges(spark, rows):
    star = graph(spark, [(0, 1, 100.0)] + [(0, i, 1.0) for i in range(2, 40)], both=False)
    kept = rows(S.sample_edges(star, nbr_upper=1, w_ratio=0.5, save_ratio=0.1, seed=1), "dst")
    assert (1,) in kept and len(kept) < 15
    again = rows(S.sample_edges(star.repartition(3), nbr_upper=1, w_ratio=0.5, save_ratio=0.1, seed=1), "dst")
    assert kept == again


def test_weight_threshold_takes_position_without_interpolation(spark, rows):
    star = graph(spark, [(0, i, float(i)) for i in range(1, 7)], both=False)
    got = dict(rows(R.node_weight_threshold(star, 0.9)))
    assert got[0] == 6.0  # position int(0.9 * 6) = 5 of 1..6
    assert got[3] == 3.0


def brute_pagerank(pairs, alpha=0.85, steps=100):
    w = {}
    for a, b, x in pairs:
        w[(min(a, b), max(a, b))] = max(x, w.get((min(a, b), max(a, b)), x))
    nodes = sorted({v for p in w for v in p})
    out = {v: [] for v in nodes}
    for (a, b), x in w.items():
        out[a].append((b, x))
        if a != b:
            out[b].append((a, x))
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(steps):
        new = dict.fromkeys(nodes, 0.0)
        lost = 0.0
        for v in nodes:
            total = sum(x for _, x in out[v])
            if total == 0:
                lost += rank[v]
            else:
                for u, x in out[v]:
                    new[u] += rank[v] * x / total
        rank = {v: alpha * (new[v] + lost / len(nodes)) + (1 - alpha) / len(nodes) for v in nodes}
    return rank


@pytest.mark.parametrize("by", [[], ["subgraph_id"]])
def test_pagerank(spark, by):
    # a loop, a repeated edge, both orientations, and a pair whose only edge weighs nothing
    pairs = [(1, 2, 1.0), (2, 1, 3.0), (2, 3, 0.5), (3, 3, 2.0), (1, 3, 1.0), (1, 3, 0.2), (4, 5, 0.0)]
    edges = graph(spark, pairs, both=False).withColumn("subgraph_id", F.lit(4))
    got = {r["id"]: r["rank"] for r in R.pagerank(edges, by=by, tol=None, max_iter=12).collect()}
    want = brute_pagerank(pairs, steps=12)
    assert sum(got.values()) == pytest.approx(1.0)
    assert got == pytest.approx(want, abs=1e-9)


def test_pagerank_stops_by_itself(spark):
    pairs = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)]
    ranks = R.pagerank(graph(spark, pairs, both=False), tol=1e-6).collect()
    assert [r["rank"] for r in ranks] == pytest.approx([1 / 3] * 3)


def test_prune_by_pagerank_drops_only_when_both_ends_are_low(spark, rows):
    # a hub with leaves, and a light pair hanging off a leaf
    pairs = [(0, i, 5.0) for i in range(1, 9)] + [(8, 9, 0.1), (9, 10, 0.1), (10, 11, 0.1)]
    edges = graph(spark, pairs, both=False).withColumn("subgraph_id", F.lit(0))
    ranks = brute_pagerank(pairs, steps=12)
    low = sorted(ranks.values())[int(0.4 * len(ranks))]
    want = sorted((a, b) for a, b, _ in pairs if ranks[a] >= low - 1e-12 or ranks[b] >= low - 1e-12)
    assert rows(R.prune_by_pagerank(edges, q=0.4, by=["subgraph_id"], tol=None, max_iter=12, digits=9), "src", "dst") == want


def test_coarsening_keeps_every_node(spark, rows):
    # an isolated pair has no outside edge and must stay together
    edges = graph(spark, TWO_TRIANGLES + [(20, 21)])
    coarse = G.coarsen(edges, k=2, rounds=2, nbr_upper=1000, w_ratio=0.01, save_ratio=0.99)
    labels = dict(rows(G.composed_labels(coarse.levels, 2), "id", "label"))
    assert sorted(labels) == [1, 2, 3, 4, 5, 6, 20, 21]
    assert sum(r["node_w"] for r in coarse.nodes.collect()) == 8
    parts = dict(rows(G.project_partition(coarse.levels, 2, coarse.nodes.filter("false").withColumn("part", F.lit(0)), 4)))
    by_label = {}
    for node, label in labels.items():
        by_label.setdefault(label, set()).add(parts[node])
    assert all(len(p) == 1 for p in by_label.values())


def test_weighted_cap(spark, rows):
    edges = graph(spark, TWO_TRIANGLES + [(20, 21)])
    coarse = G.coarsen(edges, k=2, rounds=2, w_ratio=0.01, save_ratio=0.99, weighted_cap=True)
    assert sum(r["node_w"] for r in coarse.nodes.collect()) == 8


def test_coarsen_rejects_bad_settings(spark):
    with pytest.raises(ValueError):
        G.coarsen(graph(spark, TWO_TRIANGLES), k=2, w_ratio=1.5)


@pytest.fixture(scope="module")
def planted(spark):
    """Four blocks of 50 nodes with dense inside and few outside edges."""
    rng = random.Random(5)
    pairs = set()
    for b in range(4):
        for i in range(50):
            for j in rng.sample(range(50), 8):
                if i != j:
                    pairs.add((b * 50 + min(i, j), b * 50 + max(i, j)))
    for _ in range(40):
        a, b = rng.sample(range(200), 2)
        pairs.add((min(a, b), max(a, b)))
    return sorted(pairs)


def test_partition_of_planted_blocks(spark, rows, planted):
    edges = graph(spark, planted)
    k = 4
    parts = G.partition_graph(edges, k=k, rounds=2, sweeps=15, seed=3)
    got = dict(rows(parts, "id", "part"))
    assert sorted(got) == list(range(200))
    assert set(got.values()) <= set(range(k))
    loads = [list(got.values()).count(p) for p in range(k)]
    assert max(loads) <= G.part_limit(200, k, 0.05) == 52
    cut = G.edge_cut(edges, parts).first()
    assert cut["cut_w"] < 0.5 * cut["total_w"] * (1 - 1 / k)


def test_partition_does_not_depend_on_shuffle_partitions(spark, rows, planted):
    edges = graph(spark, planted)
    results = []
    for n in ("3", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            results.append(rows(G.partition_graph(edges, k=4, rounds=1, lp_iterations=2, sweeps=3), "id", "part"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_one_direction_input(spark, rows):
    one = graph(spark, TWO_TRIANGLES, both=False)
    parts = G.partition_graph(one, k=2, rounds=1, sweeps=2, undirected=True)
    assert parts.count() == 6


def test_new_pairs_checks_both_directions(spark, rows):
    edges = graph(spark, [(1, 2), (3, 4)], both=False)
    cand = spark.createDataFrame([(2, 1), (1, 3), (3, 1), (4, 3)], "src long, dst long")
    assert rows(E.new_pairs_only(cand, edges)) == [(1, 3), (3, 1)]
    assert rows(E.new_pairs_only(cand, edges, dedupe=True)) == [(1, 3)]


def test_symmetrize_takes_the_larger_weight(spark, rows):
    edges = graph(spark, [(1, 2, 1), (2, 1, 4), (2, 3, 2)], both=False)
    assert rows(E.symmetrize_max(edges)) == [(1, 2, 4.0), (2, 1, 4.0), (2, 3, 2.0), (3, 2, 2.0)]


def test_rebalance_moves_the_least_attached(spark, rows):
    # part 0 has eight nodes in a clique of seven and a loose one, the others have two each
    pairs = [(a, b) for a in range(7) for b in range(a)] + [(8, 9), (10, 11)]
    parts = spark.createDataFrame([(i, 0) for i in range(8)] + [(8, 1), (9, 1), (10, 2), (11, 2)], "id long, part int")
    got = dict(rows(G.rebalance(parts, graph(spark, pairs), 3, slack=0.0), "id", "part"))
    loads = [list(got.values()).count(p) for p in range(3)]
    assert sorted(got) == list(range(12)) and loads == [4, 4, 4] and got[7] != 0
    assert all(got[i] == p for i, p in ((8, 1), (9, 1), (10, 2), (11, 2)))
    assert rows(G.rebalance(parts, graph(spark, pairs), 3, slack=1.0), "id", "part") == rows(parts, "id", "part")


def test_text_ids_are_ranked(spark, rows):
    df = spark.createDataFrame([("a", f"x\t{i}") for i in range(30)] + [("b", "x\t1"), ("b", "x\t1")], "g string, id string")
    got = rows(O.rank_rows(df, key="id", by=["g"]), "g", "rank", "total")
    assert got == sorted([("a", i, 30) for i in range(30)] + [("b", 0, 2), ("b", 1, 2)])
    edges = spark.createDataFrame([("x\t1", "x\t2"), ("x\t1", "x\t10")], "src string, dst string")
    assert rows(E.adjacency_list(edges)) == [("x\t1", 0, "x\t10 x\t2")]
    assert len(rows(E.adjacency_list(edges, chunk=1))) == 2


def test_neighbour_lists_have_no_default_cut(spark, rows):
    edges = graph(spark, [(0, i) for i in range(1, 300)], both=False)
    assert rows(E.adjacency_list(edges)) == [(0, 0, " ".join(map(str, range(1, 300))))]


def test_long_neighbour_lists_continue_in_parts(spark, rows):
    edges = graph(spark, [(0, i) for i in range(1, 26)], both=False)
    got = rows(E.adjacency_list(edges, chunk=10))
    assert [(s, p) for s, p, _ in got] == [(0, 0), (0, 1), (0, 2)]
    assert " ".join(t for _, _, t in got).split() == [str(i) for i in range(1, 26)]


def test_subgraph_sampling(spark, rows):
    ids = spark.range(40).select(F.col("id").cast("int").alias("subgraph_id"))
    drawn = rows(S.sample_subgraphs(ids, 0.5, seed=2))
    assert [n for n, _ in drawn] == list(range(20))
    once = rows(S.sample_subgraphs(ids, 0.5, seed=2, replace=False))
    assert len({s for _, s in once}) == 20


# ---- edges that stay


def test_only_the_state_is_shuffled(spark):
    from graphloom.operators.placed import place_edges

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = graph(spark, TWO_TRIANGLES)
        placed = place_edges(edges, "dst")
        state = cut(edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
        met = placed.meet(state)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan, plan
        assert met.count() == edges.count()
        placed.release()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hub", [1, 3])
def test_hubs_are_dealt_over_buckets(spark, rows, hub):
    from graphloom.operators.placed import place_edges

    star = [(0, i, 1.0 + i % 3) for i in range(1, 12)] + TWO_TRIANGLES
    edges = graph(spark, star)
    placed = place_edges(edges, "dst", hub=hub)
    assert placed.hubs is not None and placed.edges.where("_salt > 0").count() > 0
    assert rows(placed.plain().select("src", "dst", "w")) == rows(edges.select("src", "dst", "w"))
    want = rows(G.label_propagation(edges, k=2, iterations=3), "id", "label")
    assert rows(G.label_propagation(placed, k=2, iterations=3), "id", "label") == want
    placed.release()
