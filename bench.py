"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder      (default /root/testdata/sf0.1)
BENCH_CPUS     local cores      (default 8)

`build` writes the processed tables from the raw ones as the queries keep them (mails without
bodies, no corpus), `index` writes the TF-IDF index. The queries after them read these tables, as an installation does.
"""

from __future__ import annotations

import json
import os
import sys
import time

from orderlens import catalog
from orderlens.session import READER_PARTITIONS, local_session

HEADLINES = [
    "email_fact", "document_fact", "order_rollup", "complaints_by_order", "nearest_purchase",
    "order_fact", "customer_dim", "event_timeline", "customer_daily", "risk_features",
    "retrieval_corpus", "quality_metrics", "headline_kpis", "monthly_trend", "lifecycle_flow",
    "issue_customer_zscores", "overview_risk", "latest_orders", "complaint_change",
    "relationship_check", "binary_metrics", "best_thresholds", "time_ranks", "keyword_counts",
    "order_references", "tfidf_candidates", "retrieve_evidence", "evidence_summaries",
    "precision_recall", "training_record",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    # Each test table is one file of one row group.
    spark.conf.set(READER_PARTITIONS, cores)
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        begin = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)

    spark.range(1_000_000).selectExpr("sum(id)").collect()
    timed("build", lambda: dict(catalog.built(spark, folder)))
    timed("index", lambda: catalog.text_index(spark, folder))
    for name in HEADLINES:
        query = catalog.QUERIES[name]
        timed(name, lambda: query(spark, folder).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
