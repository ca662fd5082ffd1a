"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS name the tables and the cores.

Each query runs once to warm up and compile, then `RUNS` times; the best time counts. Every row and column of a
result is computed (Spark's noop sink), none is collected.
"""

from __future__ import annotations

import json
import os
import time

from textorium.plans import registry
from textorium.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = 2
HEADLINE = (
    "flagship_monthly_frames", "d03_temporal_week_avg", "d04_domain_aggregate", "d06_aggregate_grid", "e06_top_stories",
    "d12_theme_days", "c19_theme_cooccurrence", "h03_keyword_counts",
    "c09_e09_j04_exact_top_k", "j10_h34_two_stage_matching",
    "e01_rolling_daily", "e02_rolling_documents_per_day",
    "c04_d22_country_aggregate", "c05_d24_f09_party_scores",
    "h11_h12_canonical_urls", "h08_h09_h10_domains",
    "b05_clean", "i01_sentence_chunks", "g02_g03_dedupe_text", "k03_k04_stratified_sample",
)


def timed(spark, name: str) -> float:
    began = time.time()
    registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    spark = local_session(CPUS, CPUS, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        timed(spark, name)
        took[name] = round(min(timed(spark, name) for _ in range(RUNS)), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
