"""Times the headline queries, one run each after a warm-up of the session, and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofbase.plans import QUERIES
from proofbase.session import local_session

HEADLINE = (
    "K05_postings J05_L02_term_search F17_F18_bm25 V01_code_search P19_P20_A13_V02_outcomes W02_F43_L05_V04_passages W08_F24_quotations F02_normalize_text A09_V09_completeness "
    "A17_F41_U07_content_groups J02_J03_code_relatives J09_citation_status J12_W14_P25_L10_first_seen A06_usage_rollup W12_V13_streaks T01_tumbling_batch T02_sessions L08_P26_budget"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    # a folder of its own, so the index is built in the time of K05_postings and found by the queries after it
    shared = tempfile.mkdtemp(prefix="proofbase-bench-")
    spark = local_session(cores, 8, shared)
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    QUERIES["A06_usage_rollup"](spark, sf_dir).count()
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    shutil.rmtree(shared)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
