"""Ranks and order statistics against plain Python, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import metrics as M
from graphloom.operators import ordering as O


@pytest.fixture(params=[100, 200_000])
def hot_rows(request, monkeypatch):
    """With and without groups that are split into slots."""
    monkeypatch.setattr(O, "HOT_ROWS", request.param)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 50}"
        data.append((group, i, rng.choice([0.0, 1.0, rng.gauss(0, 5), float(rng.randint(-3, 3))])))
    return spark.createDataFrame(data, "g string, id long, v double"), data


def test_rank_rows(skewed, rows, hot_rows):
    df, data = skewed
    got = {i: r for i, r in rows(O.rank_rows(df, key="id", by=["g"]), "id", "rank")}
    seen = {}
    for g, i, _ in sorted(data, key=lambda t: t[1]):
        assert got[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


def test_hashed_ranks_are_a_permutation(skewed, rows):
    df, data = skewed
    keyed = df.withColumn("h", O.hash_key("id", seed=3))
    ranked = O.rank_rows(keyed, key="h", by=["g"], ties=["id"], hashed=True)
    for g, ranks in ranked.groupBy("g").agg(F.sort_array(F.collect_list("rank"))).collect():
        assert ranks == list(range(len(ranks)))
    by_hash = [r[0] for r in ranked.filter("g = 'hot'").orderBy("rank").select("h").collect()]
    assert by_hash == sorted(by_hash)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 0.95])
def test_order_statistics(skewed, rows, hot_rows, q):
    df, data = skewed
    groups = {}
    for g, _, v in data:
        groups.setdefault(g, []).append(v)
    want = sorted((g, sorted(v)[int(q * len(v))], len(v)) for g, v in groups.items())
    assert rows(O.order_statistics(df, "v", {"x": q}, by=["g"])) == want


def test_no_slot_holds_the_hot_group(skewed):
    df, _ = skewed
    # distinct keys of the hot group are spread over all slots
    slots = O.with_value_slot(df, "id").filter("g = 'hot'").groupBy("_slot").count().collect()
    assert len(slots) == O.slot_count(df)
    assert max(r["count"] for r in slots) < 1000


def test_prefix_sum_without_groups(spark, rows):
    df = spark.createDataFrame([(i, i * 10) for i in range(1, 8)], "k long, v long")
    assert rows(O.prefix_sum(df, "v", "k"), "k", "before", "total") == [
        (i, sum(range(1, i)) * 10, 280) for i in range(1, 8)
    ]


def test_empty_input(spark, rows):
    empty = spark.createDataFrame([], "g string, v double")
    assert rows(O.order_statistics(empty, "v", {"x": 0.5}, by=["g"])) == []


def test_skewed_partition_of_a_join_with_an_aggregate_is_split(spark):
    """Half of all edges leave one hub: its partition must be read by several tasks."""
    from graphloom.operators import sampling as S

    hub = spark.range(60000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("src"), F.col("id").alias("dst"), F.lit(1).alias("w"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = S.sample_edges(hub, seed=1)
        kept.write.format("noop").mode("overwrite").save()
        kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan or "isSkew=true" in plan or "(skew" in plan


def test_roc_auc_with_ties(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 20) / 4.0, rng.randint(0, 1)) for _ in range(400)]
    pos = [s for s, y in data if y]
    neg = [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = M.roc_auc(spark.createDataFrame(data, "score double, label int")).first()
    assert got["auc"] == pytest.approx(want)
    assert (got["n_pos"], got["n_neg"]) == (len(pos), len(neg))


def test_report_counts_a_class_that_is_only_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "label int, pred int")
    report = {r["name"]: r for r in M.class_report(df).collect()}
    assert report["2"]["support"] == 0 and report["2"]["recall"] == 0.0
    assert report["macro avg"]["f1"] == pytest.approx((0.5 + 2 / 3 + 0.0) / 3)
    assert report["micro avg"]["f1"] == pytest.approx(0.5)


def test_empty_mask_counts_for_nothing(spark):
    df = spark.createDataFrame(
        [("a", [0.0, 1.0], [0.0, 1.0], True), ("b", [5.0, 1.0], [0.0, 1.0], False)],
        "subgraph_id string, logits array<double>, target array<double>, is_masked boolean",
    )
    out = M.evaluate(df).first()
    assert out["accuracy"] == 1.0 and out["micro_f1"] == 1.0
