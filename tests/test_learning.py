"""Walks, similarity, and trainers against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.network import Adam
from graphloom.operators import edges as E
from graphloom.operators import features as X
from graphloom.operators import similarity as M
from graphloom.operators import walks as K
from graphloom.plans import augment as A
from graphloom.plans import classify as C
from graphloom.plans import dgi as D
from graphloom.plans import gcn as G
from graphloom.plans import params as P

SUB = ["subgraph_id"]


# ---- walks


def test_walks_follow_edges_and_weights(spark):
    # from 0, node 1 is three times as likely as node 2; 3 is a sink
    edges = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0), (2, 3, 0.0)], "src long, dst long, w double")
    walks = K.random_walks(edges, num_walks=400, length=5, seed=3, cut_every=2).collect()
    assert len(walks) == 4 * 400
    allowed = {(0, 1), (0, 2), (1, 0), (2, 0)}
    firsts = []
    for r in walks:
        assert r["path"][0] == r["start"]
        assert all(p in allowed for p in zip(r["path"], r["path"][1:]))
        assert len(r["path"]) == (1 if r["start"] == 3 else 5)
        firsts += [b for a, b in zip(r["path"], r["path"][1:]) if a == 0]
    assert abs(firsts.count(1) / len(firsts) - 0.75) < 0.04


def test_draw_table_covers_the_line(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(g, i, rng.choice([0.001, 1.0, 50.0])) for g in range(3) for i in range(40)], "g int, item int, w double")
    cells, lines = K.draw_table(items, ["g"], "item", "w")
    length = {r["g"]: (r["length"], r["n_cells"]) for r in lines.collect()}
    by_group = {}
    for r in cells.collect():
        n, c = length[r["g"]]
        assert r["lo"] * c // n <= r["cell"] <= (r["hi"] - 1) * c // n
        by_group.setdefault(r["g"], set()).add((r["lo"], r["hi"]))
    for g, spans in by_group.items():
        spans = sorted(spans)
        assert spans[0][0] == 0 and spans[-1][1] == length[g][0]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_walks_do_not_depend_on_shuffle_partitions(spark, rows):
    edges = E.both_directions(spark.createDataFrame([(i, (i * 7 + j) % 30, 1.0 + j) for i in range(30) for j in range(1, 4)], "src long, dst long, w double"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(K.random_walks(edges, 2, 6, seed=1), "start", "walk_no", "path"))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_skipgram_pairs(spark, rows):
    walks = spark.createDataFrame([([1, 2, 3],)], "path array<long>")
    got = {(a, b): n for a, b, n in rows(K.skipgram_pairs(walks, window=2), "center", "context", "n")}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (2, 3): 1.0, (3, 2): 1.0, (1, 3): 0.5, (3, 1): 0.5}


def test_node2vec_tells_blocks_apart(spark):
    rng = random.Random(4)
    pairs = {(b * 12 + i, b * 12 + j) for b in range(2) for i in range(12) for j in rng.sample(range(12), 5) if i < j}
    pairs |= {(0, 12)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src long, dst long, w double")
    vecs = {r["id"]: np.array(r["vec"]) for r in A.node2vec(edges, dim=6, walk_length=8, num_walks=5, window=4, epochs=8).collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vecs.items()}
    sims = {True: [], False: []}
    for a in unit:
        for b in unit:
            if a < b:
                sims[a // 12 == b // 12].append(float(unit[a] @ unit[b]))
    assert np.mean(sims[True]) > np.mean(sims[False]) + 0.3


# ---- similarity


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_top_k_similar_is_exact_over_blocks(spark, block_rows):
    rng = np.random.default_rng(1)
    data = []
    for g, n in ((0, 60), (1, 9), (2, 1)):
        centers = rng.normal(size=(3, 5))
        for i in range(n):
            v = centers[i % 3] + 0.2 * rng.normal(size=5)
            data.append((g, g * 1000 + i, [float(x) for x in v]))
    data += [(0, 500, data[0][2]), (0, 501, [0.0] * 5)]  # a copy and a zero vector
    df = spark.createDataFrame(data, "subgraph_id int, id long, vec array<double>")
    got = {}
    for r in M.top_k_similar(df, 4, block_rows=block_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["sim"]))
    for g, i, v in data:
        want = []
        for g2, j, u in data:
            if g2 == g and j != i:
                norm = np.linalg.norm(v) * np.linalg.norm(u)
                want.append((-round(float(np.dot(v, u) / norm), 9) if norm else 0.0, j))
        want = sorted(want)[:4]
        assert [o for _, o, _ in sorted(got.get(i, []))] == [j for _, j in want]


def test_clustered_vectors_spare_most_blocks(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    data = [(0, i, [float(x) for x in centers[i % 12] + 0.02 * rng.normal(size=16)]) for i in range(2400)]
    df = spark.createDataFrame(data, "subgraph_id int, id long, vec array<double>")
    units = df.select("subgraph_id", "id", M.unit_vector("vec").alias("v"))
    blocked = M._with_blocks(units, SUB, 100)
    block = ["subgraph_id", "cell", "part"]
    blocked = blocked.transform(M.cut)
    own = blocked.select(*block, F.col("cell").alias("other_cell"), F.col("part").alias("other_part"), "id", "v")
    first = M._best_between(own, own, block, 3)
    blocks = blocked.select(*block).distinct().count()
    sent = M._sent(blocked, first, SUB, 3).count()
    assert blocks >= 24 and sent < 0.35 * 2400 * (blocks - 1)
    got = {r["id"]: r["other"] for r in M.top_k_similar(df, 3, block_rows=100).where("rank = 1").collect()}
    x = np.array([v for _, _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -2)
    assert got == {i: int(j) for i, j in enumerate(sims.argmax(axis=1))}


def test_string_ids_without_groups(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, vec array<double>")
    got = {r["id"]: r["other"] for r in M.top_k_similar(df, 1, by=()).collect()}
    assert got == {"a": "b", "b": "a", "c": "b"}


# ---- features


def test_constant_column_and_single_row(spark):
    df = spark.createDataFrame([(0, 1, [0.1, 5.0]), (0, 2, [0.1, 7.0]), (1, 3, [4.0, 4.0])], "subgraph_id int, id int, features array<double>")
    got = {r["id"]: r["features"] for r in X.standardize(df).collect()}
    assert got == {1: [0.0, -1.0], 2: [0.0, 1.0], 3: [0.0, 0.0]}


def test_normaliser_of_a_directed_graph_is_the_transpose(spark):
    a = np.array([[0, 1, 0], [0, 0, 2], [4, 0, 0]], float)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]], "src int, dst int, w double")
    nodes = spark.range(3).select(F.col("id").cast("int").alias("id"))
    full = a + np.eye(3)
    d = 1 / np.sqrt(full.sum(axis=1) + 1e-20)
    want = ((full * d[None, :]).T) * d[None, :]
    got = np.zeros((3, 3))
    for r in X.normalize_adjacency(edges, nodes).collect():
        got[r["row"], r["col"]] = r["val"]
    assert np.allclose(got, want)


def test_pack_rejects_a_graph_that_is_too_large(spark):
    nodes = spark.createDataFrame([(0, i, [1.0]) for i in range(4)], "subgraph_id int, id int, features array<double>")
    edges = spark.createDataFrame([(0, 0, 1)], "subgraph_id int, src int, dst int")
    with pytest.raises(Exception, match="more than 3"):
        X.pack_graphs(nodes, edges, 3, 1)[0].collect()


def test_repeated_node_ids(spark, rows):
    df = spark.createDataFrame([(0, 1, "a", 1), (0, 1, "b", 2), (0, 2, "c", 1)], "subgraph_id int, id int, x string, n int")
    assert rows(X.unique_nodes(df, order="n"), "id", "x") == [(1, "b"), (2, "c")]
    with pytest.raises(Exception, match="repeated node id"):
        X.unique_nodes(df).collect()


# ---- trainers

GRAPHS = {0: [(0, 1), (1, 2), (2, 3), (3, 4)], 7: [(10, 11), (11, 12)]}


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    data, arcs = [], []
    for g, pairs in GRAPHS.items():
        ids = sorted({v for p in pairs for v in p})
        for n, i in enumerate(ids):
            target = [0.0, 0.0] if i == 3 else [float(n % 2 == 0), float(n % 2)]
            data.append((g, i, [float(x) for x in rng.normal(size=3)], target, i != 1))
        arcs += [(g, a, b, 1.0 + a % 3) for a, b in pairs] + [(g, b, a, 1.0 + a % 3) for a, b in pairs]
    nodes = spark.createDataFrame(data, "subgraph_id int, id int, features array<double>, target array<double>, is_masked boolean")
    edges = spark.createDataFrame(arcs, "subgraph_id int, src int, dst int, w double")
    return nodes, edges, X.normalize_adjacency(edges, nodes, by=SUB), data


def dense_graph(adj, data):
    at = {d[1]: i for i, d in enumerate(data)}
    a = np.zeros((len(data), len(data)))
    for r in adj.collect():
        a[at[r["row"]], at[r["col"]]] = r["val"]
    return a


def numpy_loss(model, params, a, data, precalc):
    x = np.array([d[2] for d in data])
    y, mask, group = np.array([d[3] for d in data]), np.array([d[4] for d in data]), np.array([d[0] for d in data])
    h = x
    for i in range(1, model.n_layers + 1):
        if i == 1 and precalc == "skip":
            z = h
        elif i == 1 and precalc:
            z = a @ h
        else:
            z = np.hstack([a @ h, h])
        out = z @ params[f"w{i}"]
        if f"scale{i}" in params:
            out = (out - out.mean(1, keepdims=True)) / np.sqrt(out.var(1, keepdims=True) + 1e-9)
            out = out * params[f"scale{i}"] + params[f"offset{i}"]
        h = out if i == model.n_layers else np.maximum(out, 0)
    lse = np.log(np.exp(h).sum(1, keepdims=True))
    loss = (y * (lse - h)).sum(1)
    return np.mean([loss[mask & (group == g)].mean() for g in np.unique(group)]), h


@pytest.mark.parametrize("precalc, norm", [(True, True), (False, False), ("skip", True)])
def test_gcn_gradients(spark, small, precalc, norm):
    nodes, _, adj, data = small
    a = dense_graph(adj, data)
    model = G.init_gcn(3, 2, layers=3, hidden=4, norm=norm, precalc=precalc, seed=5)
    rng = np.random.default_rng(0)
    for k, v in model.params.items():
        if k.startswith("offset"):
            model.params[k] = v + 0.1 * rng.normal(size=v.shape)
    counts = nodes.filter("is_masked").groupBy("subgraph_id").count()
    targets = nodes.join(counts, "subgraph_id").select(
        "subgraph_id", "id", "target", F.when(F.col("is_masked"), 0.5 / F.col("count")).otherwise(0.0).alias("share")
    )
    z1 = G.first_input(nodes, adj, 3, precalc, SUB)
    zs = G._inputs(model, z1, adj, SUB, 0.0, 0)
    loss, _, grads = G._gradients(model, zs, targets, adj, SUB, 0.0, 0)
    want, logits = numpy_loss(model, model.params, a, data, precalc)
    assert loss == pytest.approx(want)
    assert set(grads) == set(model.params)
    for name, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
            up, down = ({k: v.copy() for k, v in model.params.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            slope = (numpy_loss(model, up, a, data, precalc)[0] - numpy_loss(model, down, a, data, precalc)[0]) / 2e-6
            assert g[at] == pytest.approx(slope, abs=1e-5), (name, at)
    got = {r["id"]: r["logits"] for r in G.predict_gcn(model, nodes, adj).collect()}
    assert np.allclose([got[d[1]] for d in data], logits)


def test_gcn_learns(spark, small):
    nodes, _, adj, _ = small
    model = G.fit_gcn(nodes, adj, layers=2, hidden=8, epochs=4, lr=0.05, weight_decay=1e-4, validation=(nodes, adj), early_stopping=2)
    losses = [h["loss"] for h in model.history]
    assert losses[-1] < losses[0] and "val_loss" in model.history[0]
    batched = G.fit_gcn(nodes, adj, layers=2, hidden=4, epochs=1, groups_per_step=1, dropout=0.2)
    assert len(batched.history) == 1


def test_params_round_trip(spark, tmp_path):
    params = {"w": np.arange(6.0).reshape(2, 3), "b": np.array([1.5])}
    P.save_params(spark, params, str(tmp_path / "p"))
    back = P.load_params(spark, str(tmp_path / "p"))
    assert all(np.array_equal(params[k], back[k]) for k in params)


def numpy_dgi(p, z, zc, group):
    def enc(v):
        pre = v @ p["w"] + p["b"]
        return np.where(pre > 0, pre, p["a"][0] * pre)

    total = []
    for g in np.unique(group):
        h, hc = enc(z[group == g]), enc(zc[group == g])
        c = 1 / (1 + np.exp(-h.mean(0)))
        s, sc = h @ p["d"] @ c + p["d0"], hc @ p["d"] @ c + p["d0"]
        total.append((np.logaddexp(0, -s).sum() + np.logaddexp(0, sc).sum()) / (2 * len(h)))
    return float(np.mean(total))


@pytest.mark.parametrize("corruption", ["shuffle", "edges"])
def test_dgi_gradients(spark, small, corruption):
    nodes, edges, _, _ = small
    nodes = nodes.withColumn("features", F.transform("features", lambda x: F.abs(x)))
    other = edges.filter("src % 2 = 0")
    rows = D.views(nodes, edges, SUB, corruption, other if corruption == "edges" else None, seed=1)
    table = rows.collect()
    z, zc, group = (np.array([r[c] for r in table]) for c in ("z", "zc", "subgraph_id"))
    params = D.init_dgi(3, 4, seed=2).params
    params["b"] = params["b"] + 0.05
    loss, grads = D.dgi_step(rows, params, SUB, 2)
    assert loss == pytest.approx(numpy_dgi(params, z, zc, group))
    for name, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 5)]:
            up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            slope = (numpy_dgi(up, z, zc, group) - numpy_dgi(down, z, zc, group)) / 2e-6
            assert g[at] == pytest.approx(slope, abs=1e-5), (name, at)


def test_dgi_learns_and_embeds(spark, small):
    nodes, edges, _, _ = small
    nodes = nodes.withColumn("features", F.transform("features", lambda x: F.abs(x)))
    rows = D.views(nodes, edges, SUB)
    model = D.fit_dgi(rows, hidden=4, lr=0.02, epochs=6)
    assert min(model.history) < model.history[0]
    emb = D.embed_dgi(model, rows).collect()
    assert len(emb) == nodes.count() and all(len(r["vec"]) == 4 and all(map(math.isfinite, r["vec"])) for r in emb)


def test_classifier_and_probe(spark):
    rng = np.random.default_rng(6)
    data, arcs = [], []
    for i in range(60):
        label = i % 2
        data.append((0, i, [float(label * 2 - 1 + 0.3 * rng.normal()), float(rng.normal())], None if i == 59 else label, i < 40))
        arcs.append((0, i, (i + 2) % 60, 1.0))
    nodes = spark.createDataFrame(data, "subgraph_id int, id int, features array<double>, label int, is_masked boolean")
    edges = E.both_directions(spark.createDataFrame(arcs, "subgraph_id int, src int, dst int, w double"))
    adj = X.normalize_adjacency(edges, nodes, by=SUB)
    _, scored = C.fit_node_classifier(nodes, adj, hops=2)
    right = [(r["logits"][1] > r["logits"][0]) == (r["id"] % 2) for r in scored.collect()]
    assert len(right) == 60 and np.mean(right) > 0.9
    emb = nodes.filter("label IS NOT NULL").select("id", F.col("features").alias("vec"), "label", F.col("is_masked").alias("is_train"))
    runs = C.logistic_probe(emb, repeats=3, steps=40, lr=0.1).collect()
    assert len(runs) == 3 and all(r["accuracy"] > 0.8 for r in runs)


def test_functions_sent_to_executors_need_no_installed_package():
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    from graphloom.functions.network import softmax_rows, stack

    blob = cloudpickle.dumps(lambda pdf: softmax_rows(stack(pdf)))
    assert b"graphloom" not in blob or pickle.loads(blob)
    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); import pandas as pd; print(f(pd.Series([[0.0, 0.0]])))"
    out = subprocess.run([sys.executable, "-c", code], input=blob, capture_output=True, cwd="/", check=True)
    assert b"0.5" in out.stdout


def steps_agree(spark, small, kind, dropout, hidden, precalc):
    nodes, _, adj, _ = small
    model = G.init_gcn(3, 2, layers=3, hidden=hidden, norm=True, precalc=precalc, seed=5, kind=kind)
    z1 = G.first_input(nodes, adj, 3, precalc, SUB)
    packed = G.pack_subgraphs(z1, nodes, adj, "subgraph_id")
    joined = G.pack_subgraphs(z1, nodes, adj, "subgraph_id", most=0)
    mixed = G.pack_subgraphs(z1, nodes, adj, "subgraph_id", most=10)
    assert (len(packed.large), len(joined.large), len(mixed.large)) == (0, 2, 1)
    want = G.gcn_step(model, joined, [0, 1], "subgraph_id", dropout, 9)
    for other in (packed, mixed):
        got = G.gcn_step(model, other, [0, 1], "subgraph_id", dropout, 9)
        assert got[:2] == pytest.approx(want[:2])
        assert all(np.allclose(got[2][k], want[2][k], atol=1e-12) for k in model.params)
    return want


@pytest.mark.parametrize("kind, dropout, hidden, precalc", [("softmax", 0.0, 4, True), ("sigmoid", 0.3, 4, False), ("softmax", 0.2, 20, "skip")])
def test_packed_steps_are_those_of_the_joins(spark, small, kind, dropout, hidden, precalc):
    loss, right, grads = steps_agree(spark, small, kind, dropout, hidden, precalc)
    assert loss > 0 and 0 <= right <= 1 and all(np.abs(g).sum() > 0 for k, g in grads.items() if k.startswith("w"))


@pytest.mark.parametrize("kind", ["softmax", "sigmoid"])
def test_slopes_of_the_losses(kind):
    from graphloom.plans.packed import top

    rng = np.random.default_rng(1)
    out, y, share = rng.normal(size=(6, 3)), np.eye(3)[[0, 1, 2, 2, 1, 0]], rng.random((6, 1))
    grad = top(kind, out, y, share)[2]
    for at in np.ndindex(out.shape):
        step = np.zeros_like(out)
        step[at] = 1e-6
        slope = (top(kind, out + step, y, share)[0] - top(kind, out - step, y, share)[0]) / 2e-6
        assert grad[at] == pytest.approx(slope, abs=1e-7)


def test_an_epoch_steps_from_subgraph_to_subgraph(spark, small):
    """Against the same steps taken by hand, in order of the subgraphs' ids."""
    nodes, _, adj, _ = small
    start = G.init_gcn(3, 2, layers=2, hidden=4, norm=True, precalc=True, seed=5)
    packed = G.pack_subgraphs(G.first_input(nodes, adj, 3, True, SUB), nodes, adj, "subgraph_id")
    params, adam, losses = dict(start.params), Adam(0.01), []
    for number in (0, 1):
        loss, _, grads = G.gcn_step(G.GcnModel(params, 2), packed, [number], "subgraph_id")
        params = adam.step(params, grads)
        losses.append(loss)
    model = G.fit_gcn(nodes, adj, epochs=1, shuffle=False, start=G.GcnModel(dict(start.params), 2))
    assert all(np.allclose(model.params[k], params[k]) for k in params)
    record = model.history[0]
    assert (record["first_loss"], record["last_loss"]) == pytest.approx(tuple(losses)) and record["loss"] == pytest.approx(np.mean(losses))


def test_a_saved_model_predicts_the_same(spark, small, tmp_path):
    nodes, _, adj, _ = small
    model = G.fit_gcn(nodes, adj, layers=3, hidden=4, epochs=1, precalc=False, kind="sigmoid", validation=(nodes, adj))
    assert {"val_loss", "val_accuracy", "val_micro_f1", "val_macro_f1"} <= set(model.history[0])
    G.save_gcn(spark, model, str(tmp_path / "model"))
    back = G.load_gcn(spark, str(tmp_path / "model"))
    assert (back.n_layers, back.norm, back.precalc, back.kind) == (3, True, False, "sigmoid")
    rows = [{r["id"]: r["logits"] for r in G.predict_gcn(m, nodes, adj).collect()} for m in (model, back)]
    assert rows[0] == rows[1]


def test_sums_of_vectors(spark):
    from graphloom.operators.vectors import sum_vectors

    rng = np.random.default_rng(2)
    data = [("ab"[i % 2] if i % 7 else None, int(rng.integers(0, 30)) if i % 3 else 5, [float(x) for x in rng.normal(size=40)], float(i % 4)) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, id int, x array<double>, w double").repartition(5)
    want: dict = {}
    for g, i, x, w in data:
        want[g, i] = want.get((g, i), 0) + w * np.array(x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r["g"], r["id"]): r["vec"] for r in sum_vectors(rows, ["g", "id"], "x", "w").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert sum_vectors(rows.where("false"), ["g"], "x").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5])
def test_pairs_within_reach_by_breadth_first_search(spark, rows, k):
    rng = random.Random(k)
    arcs = [("ab"[rng.randrange(2)], rng.randrange(12), rng.randrange(12), float(rng.randrange(3))) for _ in range(30)]
    pairs = [(g, a, b) for g in "ab" for a in range(13) for b in range(0, 13, 2)]
    edges = spark.createDataFrame(arcs, "g string, src int, dst int, w double")
    want = []
    for g, a, b in pairs:
        seen = {a} if any(a in arc[1:3] and arc[0] == g for arc in arcs) else set()
        for _ in range(k):
            seen |= {y for h, x, y, w in arcs if h == g and x in seen and w}
        if b in seen:
            want.append((g, a, b))
    asked = spark.createDataFrame(pairs + pairs[:9], "g string, src int, dst int")
    assert rows(X.reachable_pairs(asked, edges, k, ["g"])) == sorted(want)


def test_a_hub_does_not_pair_its_neighbours(spark):
    spokes = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    pairs = spark.range(1, 2001).select(F.col("id").alias("src"), (100_002 - F.col("id")).alias("dst"))
    bias = X.attention_bias(pairs, E.both_directions(spokes), 2)
    assert bias.where("bias = 0").count() == 1999 and bias.count() == 2000  # one dst is no node
