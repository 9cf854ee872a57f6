"""Headline queries, each from a cold start, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vigilog.plans.activity_queries import Activity
from vigilog.plans.queries import QUERIES
from vigilog.session import local_session

HEADLINE = [
    "sessions_by_verdict", "event_flags", "fired_combos", "rescore_all_rulesets", "paired_actions", "session_cards",
    "redacted_texts", "chain_breaks", "ghost_changes", "token_index", "turns", "review_findings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        if name not in QUERIES:
            continue
        spark.catalog.clearCache()
        Activity.forget()
        start = time.time()
        QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
