"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up, then ``$BENCH_RUNS`` times (2 by default); the median counts.
All rows and columns of the result are computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tapeworks.plans import CATALOG
from tapeworks.session import build_session

QUERIES = [
    "ohlcv_1m", "ohlc_daily", "ohlcv_1m_stream", "fact_trade", "fact_quote", "incremental_by_date", "dedupe_by_key",
    "upsert_latest", "ingest_trade", "sequences", "lag1_fit", "model_metrics", "tick_sequences", "ar_fit", "tick_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or QUERIES:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
