"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import time

from coursebank.plans import catalog
from coursebank.session import build_session

HEADLINE = (
    "d1_dashboard", "d3_bloom_distribution", "d6_batch_summary", "d7_monthly_revenue", "d20_credit_balance",
    "e1_visible_batches", "c1_top_users", "k1_settlement", "k6_adjusted_credits", "d8_bleu_report",
    "corpus_clean", "a6_merged_pages", "j8_sectioning", "d18_top_terms", "level_gate_report", "qa_quality",
    "reply_intake", "c16_corpus_attribution", "i30_attribution", "j14_assignment",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["d2_raw_label_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
