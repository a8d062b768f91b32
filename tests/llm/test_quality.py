import pytest
from pyspark.sql import functions as F

from graphloom.llm.rule_ensemble import Bound, compiled, fit, measured, quality_scores, tree_rules
from graphloom.llm.rule_ledger import BASE, BITS, PROSE, Policy, ablation, keep_passing, ledger, passes


def brute(text):
    text = text or ""
    words = text.encode().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)} if len(runs) < 3000 else set()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_letters": sum(c.isascii() and c.isalpha() for c in text),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_bangs": text.count("!"),
    }


def test_measures(odd_docs, odd_rows):
    got = ledger(odd_docs).collect()
    assert len(got) == len(odd_rows)
    want = sorted(str(sorted(brute(t).items())) for _, t in odd_rows if not t or len(t) < 10_000)
    found = [r.asDict() for r in got if r.n_words < 1000]
    assert sorted(str(sorted((k, v) for k, v in r.items() if k not in ("doc_id", "failed_bits"))) for r in found) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[13].n_dup_lines == 3 and by_id[13].failed_bits & BITS["repeated_lines"]
    assert by_id[1].failed_bits == BITS["short"] == by_id[2].failed_bits


def test_ablation_counts_from_bits(spark):
    bits = [0, 0, 1, 1, 2, 3, 4, 4, 4, 5]
    entries = spark.createDataFrame([(b,) for b in bits], "failed_bits long")
    policies = [BASE, Policy("wide", 2, ("short", "symbols"))]
    got = {(r.policy, r.rule): (r.documents, r.rejected, r.failing, r.only_this_rule) for r in ablation(entries, policies).collect()}
    assert got == {
        ("base", "short"): (10, 5, 4, 3),
        ("base", "repetition"): (10, 5, 2, 1),
        ("wide", "short"): (10, 7, 4, 3),
        ("wide", "symbols"): (10, 7, 4, 3),
    }
    assert ablation(entries.where("false"), policies).count() == 0


def test_rows_that_pass_keep_their_columns(odd_docs, no_docs):
    kept = keep_passing(odd_docs)
    assert kept.schema == odd_docs.schema
    entries = ledger(odd_docs)
    want = entries.where(passes(F.col("failed_bits"), PROSE)).select("doc_id").collect()
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, want))
    assert keep_passing(no_docs).count() == 0 and ledger(no_docs).count() == 0


TREES = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=3
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 <= -1.5E-4)
      Predict: 0.0
     Else (feature 0 > -1.5E-4)
      Predict: 1.0
    Else (feature 2 > 0.5)
     If (feature 2 <= 2.0)
      Predict: 1.0
     Else (feature 2 > 2.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 3.0)
     Predict: 0.0
    Else (feature 1 > 3.0)
     Predict: 1.0
"""


def test_rules_are_the_ways_to_the_nodes():
    low, high = Bound(2, False, 0.5), Bound(2, True, 0.5)
    assert tree_rules(TREES) == [
        (low,),
        (Bound(0, False, -1.5e-4), low),
        (Bound(0, True, -1.5e-4), low),
        (high,),
        (Bound(2, False, 2.0), high),
        (Bound(2, True, 2.0),),
        (Bound(1, False, 3.0),),
        (Bound(1, True, 3.0),),
    ]


def test_held_out_documents_are_told_apart(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    scores = quality_scores(spark.read.parquet(f"{path}/documents.parquet"), labels)
    assert scores.columns == ["doc_id", "held_out", "score", "predicted"] and scores.count() == 1000
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_odd_documents_and_labels(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(9, 1, None), (4, 0, 1), (4, None, 1), (None, 1, 1), (77, 1, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")
    for marked in (labels, labels.where("false"), labels.where("quality = 1")):
        rows = quality_scores(odd_docs, marked).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_scores(no_docs, labels).count() == 0


def test_compiled_scores_are_those_of_the_model(spark):
    rows = [([float(i % 7), float(i % 5), 0.0], int(i % 7 > 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "stats array<double>, label int")
    model = fit(df, trees=4, depth=2)
    assert model.rules and all(0 <= b.statistic <= 2 for _, r in model.rules for b in r)
    got = df.select("label", compiled(model, F.col("stats")).alias("p")).collect()
    assert all((r.p >= 0.5) == (r.label == 1) for r in got)


@pytest.mark.parametrize("text", [None, "", "one", "a b " * 50_000])
def test_statistics_are_finite(spark, text):
    row = measured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert all(abs(x) < 1e6 for x in row.stats)
