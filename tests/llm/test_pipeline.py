import hashlib

import corpus_pipeline
from graphloom.llm.anchored_pii import redact
from graphloom.llm.merge_dropout import decode
from graphloom.llm.rule_ledger import PROSE, ledger, passes
from pyspark.sql import functions as F
from tests.llm.test_duplicates import brute as groups
from tests.llm.test_leaks import brute as leaks


def test_stages_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in ledger(docs).where(passes(F.col("failed_bits"), PROSE)).collect()}
    left = {i: t for i, t in rows.items() if i in good}
    least = groups(list(left.items()), 80)
    left = {i: t for i, t in left.items() if least[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    near = [(i, t) for i, t in left.items() if len(t) < 4000]
    dirty = {d for d, *_ in leaks(near, items)} | {i for i, t in left.items() if any(x in t for _, x in items)}
    want = {i: redact(t) for i, t in left.items() if i not in dirty}
    out = corpus_pipeline.run(spark, path)
    assert all(r.lossless for r in out.collect())
    assert {r.doc_id: r.text for r in decode(out).collect()} == want


def test_stages_keep_the_columns(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes, name
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs):
    path = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == odd_docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() <= 17


def test_the_same_rows_again(spark):
    def digest():
        rows = sorted(str(r) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
        return hashlib.sha256("".join(rows).encode()).hexdigest()

    assert digest() == digest()
