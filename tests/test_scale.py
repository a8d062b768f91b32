"""Sums over edges whose groups have few rows: shuffled once, into tasks of bounded rows, with the same result."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import scratch
from graphloom.catalog import tables as T
from graphloom.operators import labels as L
from graphloom.operators import placed, walks
from graphloom.operators.edges import distinct_nodes
from graphloom.operators.placed import place_edges
from graphloom.plans import augment, gcn, packed, skipgram
from graphloom.plans import partition as G
from graphloom.plans.skipgram import PairBlocks
from graphloom.scratch import cut

LINES = [(1, 1, 1, 2), (1, 1, 1, 3), (1, 2, 1, 4), (2, 1, 2, 5), (2, None, 2, 6), (2, 3, None, 7), (3, None, None, 8), (4, 1, 1, 9), (9, 1, 1, 99), (5, 4, 4, 10)]
ORDERS = [(1, 7), (2, 8), (3, None), (4, T.SUPPLIER + 1), (5, T.PART + 4), (5, 8)]


@pytest.fixture
def trade_tables(spark, tmp_path):
    spark.createDataFrame([(*ends, float(q)) for *ends, q in LINES], "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def six_ways():
    add = lambda a, b: None if a is None else a + b
    weight = Counter()
    for order, s, p, q in LINES:
        for key, c in ORDERS:
            if key == order:
                ends = (c, add(s, T.SUPPLIER), add(p, T.PART))
                for i in range(3):
                    for j in range(3):
                        if i != j:
                            weight[ends[i], ends[j]] += q
    return weight


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kept", [False, True])
@pytest.mark.parametrize("per_task", [2, 1_000_000])
def test_triangles_from_one_direction(spark, trade_tables, monkeypatch, kept, per_task):
    monkeypatch.setattr(scratch, "ROWS_PER_TASK", per_task)
    edges = T.triangles(spark, trade_tables, kept)
    got = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert got == six_ways() and edges.count() == len(got)
    assert ("l_orderkey" in plan(edges)) != kept  # a kept graph is not worked out again


def test_many_pairs_are_summed_in_tasks_of_bounded_rows(spark, trade_tables, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_PER_TASK", 2)
    for edges, rows in ((T.triangles(spark, trade_tables), 3 * len(LINES)), (T.trade(spark, trade_tables), len(LINES))):
        assert edges.select(F.spark_partition_id()).rdd.getNumPartitions() == max(rows // 2, 4)
    pairs = {(r["src"], r["dst"]): r["w"] for r in T.trade(spark, trade_tables).collect()}
    assert pairs[7, T.SUPPLIER + 1] == 5 and pairs[None, None] == 8 and len(pairs) == 9


def test_labels_are_heard_in_one_shuffle(spark, rows, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_PER_TASK", 10)
    heard = [(i % 7, i * i % 23, i % 5 == 0, 1 + i % 3, float(i)) for i in range(400)]
    messages = spark.createDataFrame(heard, "id long, label long, frozen boolean, size long, w double")
    total = Counter()
    for i, label, frozen, size, w in heard:
        if not frozen:
            total[i, label] += w / size
    scores = L.label_scores(messages, 400)
    assert {(r["id"], r["label"]): round(r["score"], 6) for r in scores.collect()} == {k: round(v, 6) for k, v in total.items()}
    # no sums per message before the shuffle, and few rows of a node after it
    assert plan(scores).split("Exchange")[-1].count("HashAggregate") == 0
    assert scores.rdd.getNumPartitions() == 40
    spread = scores.groupBy("id", F.spark_partition_id()).count().groupBy("id").count()
    assert max(r["count"] for r in spread.collect()) <= L.LABEL_PARTS


def test_placed_edges_know_their_number(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    for hub in (1, 10):
        placed = place_edges(edges, "dst", hub=hub)
        assert L.known_rows(placed) == 3
        placed.release()
    assert L.known_rows(edges) is None and L.known_rows(scratch.cut(edges)) == 3


# ---- edges laid out where they are read


def node_shuffles(df):
    """The exchanges of a plan."""
    return plan(df).count("Exchange hashpartitioning")


@pytest.mark.parametrize("hub", [3, 1_000_000])
def test_kept_triangles_lie_by_an_end(spark, trade_tables, monkeypatch, hub):
    monkeypatch.setattr(placed, "HUB_EDGES", hub)
    monkeypatch.setattr(scratch, "ROWS_PER_TASK", 10)
    for end in ("src", "dst"):
        edges = T.triangles(spark, trade_tables, kept=end)
        assert {(r["src"], r["dst"]): r["w"] for r in edges.collect()} == six_ways() and L.known_rows(edges) == len(six_ways())
        assert {r[0] for r in distinct_nodes(edges).collect()} == {a for a, _ in six_ways()}
        if hub > 3:
            assert placed.lies_by(edges, end) and node_shuffles(edges.groupBy(end).count()) == 0 and node_shuffles(distinct_nodes(edges)) == 0
            assert node_shuffles(T.triangles(spark, trade_tables, kept=end).groupBy("src", "dst").count()) == 0


def test_first_labels_are_not_sent(spark, trade_tables, rows, monkeypatch):
    arcs = T.placed_triangles(spark, trade_tables, "dst")
    plain = [(a, b, w) for (a, b), w in six_ways().items() if a is not None and b is not None]
    edges = spark.createDataFrame(plain, "src long, dst long, w long")
    sent, real = [], G.lp_iteration
    monkeypatch.setattr(G, "lp_iteration", lambda *a: (sent.append(a), real(*a))[1])
    for k, steps in ((1, 1), (1, 3), (3, 2)):
        want = rows(G.label_propagation(edges, k, steps), "id", "label")
        assert len(sent) == steps
        assert rows(G.label_propagation(arcs, k, steps).where("id is not null"), "id", "label") == want
        assert len(sent) == 2 * steps - 1
        sent.clear()
    # a node's row and its best score are all that is shuffled
    labels = scratch.cut(edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    assert node_shuffles(L.first_step(arcs.heard(), labels)) == 1
    arcs.release()


def test_coarse_graph_lies_by_src(spark, rows, monkeypatch):
    pairs = [(a, b) for a in range(24) for b in range(24) if a != b and (a // 6 == b // 6 or (a + b) % 11 == 0)]
    edges = scratch.cut(spark.createDataFrame([(a, b, float(1 + (a * b) % 3)) for a, b in pairs], "src long, dst long, w double"))
    seen, real = [], G.sample_edges
    monkeypatch.setattr(G, "sample_edges", lambda graph, *a: (seen.append(graph), real(graph, *a))[1])
    G.coarsen(edges, k=4, rounds=2, w_ratio=0.01, save_ratio=0.99)
    assert [placed.lies_by(g, "src") for g in seen] == [False, True, True]
    assert all(node_shuffles(g.groupBy("src").count()) == 0 for g in seen[1:])


# ---- skip-gram pairs in blocks


@pytest.mark.parametrize("size", [3, 8, 1000])
@pytest.mark.parametrize("grouped", [True, False])
def test_pair_gradients_do_not_depend_on_blocks(spark, size, grouped):
    rng = random.Random(size)
    pairs = {(g, i, j): (rng.random(), rng.random()) for g in (0, 1) for i in range(5) for j in range(12 if i == 0 else 4)}
    data = [(g, f"{g}n{i}", f"{g}n{j}", *w) for (g, i, j), w in pairs.items()]
    odd = [(0, None, "0n1", 1.0, 1.0), (0, "0n1", None, 1.0, 1.0)]
    df = spark.createDataFrame(data + odd, "g int, center string, context string, pos double, neg double")
    by = ["g"] if grouped else []
    blocks = PairBlocks(df if grouped else df.drop("g"), by, size)
    ends = {(e, r) for _, c, k, *_ in data for e, r in ((c, 0), (k, 1))}
    vecs = {(e, r): np.array([rng.uniform(-1, 1), rng.uniform(-1, 1)]) for e, r in sorted(ends)}
    assert {(r["id"], r["role"]) for r in blocks.nodes().collect()} == ends
    state = spark.createDataFrame([(int(e[0]), e, r, *map(float, v)) for (e, r), v in vecs.items()], "g int, id string, role int, x0 double, x1 double")
    want = {k: np.zeros(2) for k in vecs}
    for _, c, k, pos, neg in data:
        pull = pos - (pos + neg) / (1 + np.exp(-(vecs[c, 0] @ vecs[k, 1])))
        want[c, 0] += pull * vecs[k, 1]
        want[k, 1] += pull * vecs[c, 0]
    got = {(r["id"], r["role"]): (r["g0"], r["g1"]) for r in blocks.gradients(state, ["x0", "x1"], ["g0", "g1"]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    # a block is sent each of its nodes once, and the pairs stay in their buckets
    assert blocks.needs.groupBy(*blocks.keys, "id", "role").count().where("count > 1").isEmpty()
    assert plan(blocks.gradients(state, ["x0", "x1"], ["g0", "g1"])).count("SelectedBucketsCount") <= 1
    assert size < 1000 or blocks.packed.count() == (2 if grouped else 1)
    blocks.release()


def test_block_gradients_over_several_goes(monkeypatch):
    monkeypatch.setattr(skipgram, "AT_ONCE", 4)
    rng = np.random.default_rng(3)
    c, k = np.sort(rng.integers(0, 5, 50)).astype(np.int32), rng.integers(0, 7, 50).astype(np.int32)
    pos, neg, x, y = rng.random(50), rng.random(50), rng.normal(size=(5, 3)), rng.normal(size=(7, 3))
    to_x, to_y = np.zeros_like(x), np.zeros_like(y)
    for i, j, p, n in zip(c, k, pos, neg):
        pull = p - (p + n) / (1 + np.exp(-(x[i] @ y[j])))
        to_x[i] += pull * y[j]
        to_y[j] += pull * x[i]
    got = skipgram.pair_gradients(c, k, pos, neg, x, y)
    assert np.allclose(got[0], to_x) and np.allclose(got[1], to_y)


@pytest.mark.parametrize("dense", [0.0, 9.0])
def test_products_of_all_cells_and_of_pairs_give_one_gradient(monkeypatch, dense):
    monkeypatch.setattr(skipgram, "DENSE", dense)
    monkeypatch.setattr(skipgram, "CELLS", 20)
    monkeypatch.setattr(skipgram, "AT_ONCE", 6)
    rng = np.random.default_rng(5)
    c, k = np.sort(rng.integers(0, 9, 60)), rng.integers(0, 7, 60)  # some pairs come twice
    pos, neg, x, y = rng.random(60), rng.random(60), rng.normal(size=(10, 3)), rng.normal(size=(7, 3))
    to_x, to_y = np.zeros_like(x), np.zeros_like(y)
    for i, j, p, n in zip(c, k, pos, neg):
        pull = p - (p + n) / (1 + np.exp(-(x[i] @ y[j])))
        to_x[i] += pull * y[j]
        to_y[j] += pull * x[i]
    got = skipgram.pair_gradients(c, k, pos, neg, x, y)
    assert np.allclose(got[0], to_x) and np.allclose(got[1], to_y)


def odd_graph(spark):
    data = [(g, f"n{i}", f"n{(i * 7 + j) % 30}", 0.5 + (i * j) % 4) for g in (0, 1, 2) for i in range(30) for j in range(1, 4 + g)]
    data += [(0, "n3", "sink", 9.0), (0, "n3", "n4", 0.0), (1, None, "n1", 1.0), (1, "n1", None, 1.0), (None, "n1", "n2", 1.0), (2, "n1", "n2", 2.0)]
    return spark.createDataFrame(data, "g int, src string, dst string, w double")


@pytest.mark.parametrize("walkers", [5, 1000])
def test_walks_in_tasks_are_those_of_joins(spark, monkeypatch, walkers):
    monkeypatch.setattr(walks, "HELD_WALKERS", walkers)
    written, real = [], walks.cut
    monkeypatch.setattr(walks, "cut", lambda df, name="cut": (written.append(name), real(df, name))[1])
    edges = odd_graph(spark)
    found = {most: sorted(map(tuple, walks.random_walks(edges, 3, 7, seed=1, by=["g"], cut_every=3, most=most).collect()), key=repr) for most in (0, 120)}
    assert "walkers" in written
    del written[:]
    found[None] = sorted(map(tuple, walks.random_walks(edges, 3, 7, seed=1, by=["g"]).collect()), key=repr)
    assert not {"walkers", "walk-cells"} & set(written)  # no join a step
    assert found[None] == found[0] == found[120]
    assert len(found[None]) == (30 * 3 + 4) * 3 and {1, 7} <= {len(r[3]) for r in found[None]}


@pytest.mark.parametrize("at_once", [1, 1 << 22])
def test_pairs_of_walks_by_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(walks, "COUNTED", at_once)
    rng = random.Random(8)
    paths = [(g, [rng.choice([*"abcde", None]) for _ in range(rng.randint(0, 9))]) for g in (0, 1, None) for _ in range(20)]
    want = {}
    for g, path in paths:
        for i, a in enumerate(path):
            for j, b in enumerate(path):
                if 0 < abs(i - j) <= 4:
                    want[g, a, b] = want.get((g, a, b), 0) + (5 - abs(i - j)) / 4
    df = spark.createDataFrame([*paths, (0, None)], "g int, path array<string>")
    got = {tuple(r)[:3]: r["n"] for r in walks.skipgram_pairs(df, 4, ["g"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert len([*walks._pair_counter(["g"], 4)(iter(df.toArrow().to_batches()))]) >= (1 if at_once > 1 else 30)


@pytest.mark.parametrize("by", [["g"], []])
def test_vectors_trained_in_tasks_are_those_of_blocks(spark, monkeypatch, by):
    pairs = walks.skipgram_pairs(walks.random_walks(odd_graph(spark), 3, 7, seed=1, by=["g"]), 4, ["g"])
    pairs = pairs.unionByName(spark.createDataFrame([(0, "n1", None, 1.0), (0, None, "n1", 2.0), (None, "n1", "n2", 1.0)], pairs.schema))
    pairs = cut(pairs if by else pairs.where("g = 0").drop("g"))
    most_pairs = pairs.groupBy(*by).count().agg(F.max("count")).first()[0]
    vectors = lambda most: {tuple(r)[:-1]: r["vec"] for r in augment.fit_skipgram(pairs, 4, 5, seed=2, by=by, most=most).collect()}
    want = vectors(0)
    monkeypatch.setattr(augment, "PairBlocks", None)  # no blocks, and no job an epoch
    got = vectors(None)
    monkeypatch.undo()
    for some in (got, vectors(most_pairs - 1)):
        assert some.keys() == want.keys() and all(np.allclose(some[k], want[k], atol=1e-9) for k in want)


def test_walkers_carry_the_nodes_since_the_last_cut(spark, rows, monkeypatch):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 30, 1.0 + j) for i in range(30) for j in range(1, 4)] + [(3, 99, 9.0)], "src long, dst long, w double")
    written, real = [], walks.cut
    monkeypatch.setattr(walks, "cut", lambda df, name="cut": (written.append((name, made := real(df, name))), made)[1])
    whole = rows(walks.random_walks(edges, 2, 12, seed=1, cut_every=50), "start", "walk_no", "path")
    got = rows(walks.random_walks(edges, 2, 12, seed=1, cut_every=3), "start", "walk_no", "path")
    assert got == whole and len(got) == 62 and {len(p) for *_, p in got} >= {1, 12}
    pieces = [df for name, df in written if name == "walkers"]
    assert len(pieces) == 3 and max(df.agg(F.max(F.size("path"))).first()[0] for df in pieces) <= 4
    table = next(df for name, df in written if name == "walk-cells")
    assert {"_length", "_n_cells"} <= set(table.columns)  # a step needs no second join


# ---- packed subgraphs


def packed_row(n, degree, rng):
    row, col = np.sort(rng.integers(0, n, n * degree)).astype(np.int32), rng.integers(0, n, n * degree).astype(np.int32)
    arrays = {"z": rng.normal(size=(n, 3)), "target": np.eye(2)[rng.integers(0, 2, n)], "masked": np.ones(n, np.uint8), "hash": np.arange(n)}
    return {"number": 0, "n": n} | {k: a.tobytes() for k, a in (arrays | {"row": row, "col": col, "val": rng.random(n * degree)}).items()}


def packed_gradient(row, hidden, dropout=0.0):
    model = gcn.init_gcn(3, 2, 4, hidden, True, True, 0)
    run = packed.packed_gradients([model.layer(i) for i in range(1, 5)], "softmax", 2, 1, dropout, 1, gcn._forward_rows, gcn._backward_rows)
    return np.frombuffer(next(run(iter([pa.RecordBatch.from_pylist([row])])))["part"][0].as_py())


@pytest.mark.parametrize("aside", [0, 1 << 30])
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradient_does_not_depend_on_blocks(monkeypatch, aside, dropout):
    row = packed_row(50, 3, np.random.default_rng(2))
    whole = packed_gradient(row, 8, dropout)
    monkeypatch.setattr(packed, "ROWS", 7)
    monkeypatch.setattr(packed, "EDGES", 5)
    monkeypatch.setattr(packed, "ASIDE", aside)
    assert np.allclose(packed_gradient(row, 8, dropout), whole, rtol=0, atol=1e-12)


def test_a_packed_subgraph_holds_two_layers(monkeypatch):
    for name, value in (("ROWS", 500), ("EDGES", 500), ("ASIDE", 0)):
        monkeypatch.setattr(packed, name, value, raising=False)
    n, hidden = 20_000, 64
    row = packed_row(n, 2, np.random.default_rng(2))
    tracemalloc.start()
    packed_gradient(row, hidden)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n * hidden * 8


# ---- predictions in one task a subgraph


def odd_subgraphs(spark):
    rng = random.Random(3)
    nodes = [(g, f"n{i}", [rng.uniform(-1, 1) for _ in range(3)]) for g in (0, 1, 2) for i in range(12)]
    nodes += [(None, "a", [1.0, 2.0, 3.0]), (None, "b", [1.0, 2.0, 0.0]), (1, None, [1.0, 0.5, 3.0]), (2, "n1", [0.1, 0.2, 0.3]), (0, "lone", [1.0, 2.0, -3.0]), (1, "nul", [1.0, None, 2.0])]
    arcs = [(g, f"n{i}", f"n{(i * 5 + j) % 12}", rng.random()) for g in (0, 1, 2) for i in range(12) for j in range(3)]
    arcs += [(None, "a", "b", 1.0), (0, None, "n1", 1.0), (0, "n1", None, 1.0), (0, "n2", "gone", 1.0), (0, "gone", "n2", 1.0), (1, "n2", "n3", 0.5), (1, "n2", "n3", 0.5), (2, "n4", "n5", None)]
    return spark.createDataFrame(nodes, "subgraph_id int, id string, features array<double>"), spark.createDataFrame(arcs, "subgraph_id int, row string, col string, val double")


@pytest.mark.parametrize("precalc, paired", [(True, 1 << 25), ("skip", 1 << 25), (False, 100)])
def test_predictions_in_tasks_are_those_of_joins(spark, monkeypatch, precalc, paired):
    nodes, adj = odd_subgraphs(spark)
    model = gcn.init_gcn(3, 2, 4, 20, True, precalc, 5)
    joined, real = [], gcn._joined_scores
    monkeypatch.setattr(gcn, "_joined_scores", lambda *args: (joined.append(args), real(*args))[1])

    def scores(most):
        rows = gcn.predict_gcn(model, nodes, adj, most=most).collect()
        return sorted(((r["subgraph_id"], r["id"], *[x if x is None else round(x, 8) for x in [*r["logits"], r["p"]]]) for r in rows), key=repr)

    want, some = scores(0), scores(47)  # nodes with a repeated or null id have more
    assert len(joined) == 2 and want == some and len(want) == (42 if precalc == "skip" else 43)
    assert any(r[2] is None for r in want) and any(r[0] is None for r in want)
    monkeypatch.setattr(packed, "ROWS", 5)
    monkeypatch.setattr(gcn, "aggregate_neighbours", lambda adj, x, by, dim, concat_self=True, features="features", real=gcn.aggregate_neighbours: real(adj, x, by, dim, concat_self, features) if dim < 20 else pytest.fail("a wide layer was joined"))
    assert scores(packed.MOST) == want and len(joined) == 2


def test_a_large_subgraph_waits_in_files_and_one_layer_is_held(monkeypatch, tmp_path):
    rng = np.random.default_rng(2)
    n, m = 6_000, 18_000
    model = gcn.init_gcn(3, 2, 5, 64, True, True, 5)
    nodes = pa.table({"g": pa.array(np.ones(n, int)), "id": pa.array(np.arange(n)), "z": pa.array(list(rng.normal(size=(n, 3))))})
    edges = pa.table({"g": pa.array(np.ones(m, int)), "row": pa.array(rng.integers(0, n, m)), "col": pa.array(rng.integers(0, n, m)), "val": pa.array(rng.random(m))})
    run = packed.subgraph_scores([model.layer(i) for i in range(1, 6)], "g", gcn._forward_rows)
    monkeypatch.setattr(packed, "ROWS", 256)
    monkeypatch.setattr(packed.tempfile, "tempdir", str(tmp_path))
    peaks, found = [], []
    for limit in (1 << 25, 0):
        monkeypatch.setattr(packed, "PAIRED", limit)
        tracemalloc.start()
        found.append(run(nodes, edges))
        peaks.append(tracemalloc.get_traced_memory()[1] / (n * 64 * 8))  # in outputs of one layer
        tracemalloc.stop()
    assert found[0].equals(found[1]) and peaks[0] < 3.2 and peaks[1] < peaks[0] - 0.5
    assert not list(tmp_path.iterdir())


def test_a_layer_that_is_joined_is_removed_after_the_next(spark, monkeypatch):
    nodes, adj = odd_subgraphs(spark)
    kept, dropped = [], []
    real_write, real_drop = scratch._write, scratch.drop_path
    monkeypatch.setattr(scratch, "_write", lambda df, path: (kept.append(path), real_write(df, path))[1])
    monkeypatch.setattr(scratch, "drop_path", lambda spark, path: (dropped.append(path), real_drop(spark, path))[1])
    gcn.predict_gcn(gcn.init_gcn(3, 2, 4, 20, True, True, 5), nodes, adj, most=0).collect()
    layers = [p for p in kept if "/predict-" in p]
    assert len(layers) == 4 and dropped == layers[:-1]
