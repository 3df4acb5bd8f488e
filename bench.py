"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS``
(default all cores).  The tables are first copied to one file per core, untimed, as a small
table is a single row group that one core would read.  Each query runs to the end into a sink that discards rows; the
first run warms the JVM, the better of the two runs after it counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from newsweave.session import build_session
from workload import catalog

TABLES = ["documents", "pages", "events", "supplier", "customer", "nation", "part"]
HEADLINE = [
    "refresh_articles",
    "dedup_latest",
    "publication_dates",
    "clean_snippet",
    "text_relevance",
    "score_articles",
    "match_phrases",
    "match_phrases_by_grams",
    "absolute_dates",
    "arabic_dates",
    "query_plan",
    "new_articles",
    "registry_refresh",
    "chain_lookup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = sf_dir
    sf_dir = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        df = spark.read.parquet(f"{source}/{name}.parquet")
        df.repartition(int(cpus)).write.parquet(f"{sf_dir}/{name}.parquet")
    queries = catalog()
    seconds = {}
    for name in HEADLINE:
        run = queries[name][0]
        times = []
        for _ in range(3):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": source.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
