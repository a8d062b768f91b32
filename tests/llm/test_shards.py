import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.extendible_hashing import shard_documents, shards


def address(key):
    return bin(int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def brute(sizes, limit):
    """Shortest fitting prefix of each key's address."""
    out = {}
    for key, size in sizes.items():
        for depth in range(61):
            prefix = address(key)[:depth]
            total = sum(s for k, s in sizes.items() if address(k).startswith(prefix))
            if total <= limit:
                out[key] = (prefix, total)
                break
    return out


@pytest.mark.parametrize("limit", [300, 2000, 50_000])
def test_prefixes_are_the_shortest_that_fit(spark, limit):
    rng = random.Random(limit)
    sizes = {i: rng.randrange(0, 250) for i in range(300)}
    rows = spark.createDataFrame(list(sizes.items()), "id long, size long")
    got = shards(rows, "id", F.col("size"), limit).collect()
    assert {r.key: (r.shard, r.shard_bytes) for r in got} == brute(sizes, limit) and len(got) == 300
    assert all(r.depth == len(r.shard) and r.page == 0 and r.shard_bytes <= limit for r in got)


def test_a_hot_key_is_split_by_its_rows(spark):
    rows = spark.createDataFrame([(7, f"row {i}", 100) for i in range(200)] + [(i, "x", 100) for i in range(100)], "id long, text string, size long")
    got = shards(rows, "id", F.col("size"), 1000).collect()
    assert len(got) == 300 and all(r.shard_bytes <= 1000 for r in got) and any(r.depth > 60 for r in got)


def test_equal_rows_go_to_pages(spark):
    rows = spark.createDataFrame([(1, "same", 100)] * 95 + [(2, "large", 5000)], "id long, text string, size long").repartition(5)
    got = shards(rows, "id", F.col("size"), 1000).collect()
    pages = {}
    for r in got:
        pages.setdefault((r.shard, r.page), []).append(r)
    assert len(got) == 96 and sum(len(p) for p in pages.values()) == 96
    for (_, page), members in pages.items():
        assert all(r.shard_bytes == sum(m.bytes for m in members) for r in members)
        assert len(members) <= 10 and (members[0].shard_bytes <= 1000 or len(members) == 1)
    assert len([p for p in pages if len(p[0]) == 120]) == 11


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = shard_documents(odd_docs, 10_000).collect()
    assert sorted((str(r.doc_id), r.bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in odd_rows)
    assert all(r.shard_bytes <= 10_000 or r.bytes > 10_000 for r in got)
    assert shard_documents(no_docs).count() == 0


def test_no_python_on_the_way(spark, odd_docs):
    plan = shard_documents(odd_docs.select("doc_id", "text"), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
