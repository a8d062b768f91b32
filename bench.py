"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query runs twice; the second run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "prune_by_weight",
    "label_propagation",
    "pagerank",
    "message_pass",
    "standardize",
    "roc_auc",
    "top_k_similar",
    "sample_edges",
    "coarsen",
    "gcn_epoch",
)


def gcn_epoch(spark, sf_dir):
    """One epoch over the nations, a step each, with five layers of 128: the job of the published times."""
    from graphloom.catalog.learning_queries import _labelled, _sym
    from graphloom.plans.gcn import fit_gcn

    model = fit_gcn(_labelled(spark, sf_dir), _sym(spark, sf_dir), epochs=1)
    return spark.createDataFrame([(model.history[0]["seconds"], model.history[0]["loss"])], "seconds double, loss double")


def main() -> None:
    from graphloom.catalog import registry
    from graphloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = registry.queries() | {"gcn_epoch": gcn_epoch}
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.time()
            df = queries[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
            # the epoch alone, without reading and packing the graph
            if name == "gcn_epoch":
                seconds[name] = round(df.first()["seconds"], 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_sec", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
