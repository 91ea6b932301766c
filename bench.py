"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query
runs once to warm up and then ``BENCH_RUNS`` times; the median counts. The
statement chain is rebuilt for each run, so no run profits from staged tables of
an earlier one.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fundlens.plans import catalog, statement_queries as Q
from fundlens.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

CHAIN = {
    "canonical_extractions": lambda u: u.canonical,
    "running_balances": lambda u: u.transactions,
    "submission_underwriting_summary": lambda u: u.submission_summary,
}
PLAIN = [
    "running_order_totals", "fanned_out_documents", "upserted_documents", "document_transitions",
    "validated_ready_events", "delivery_decisions", "resolved_attribution", "journey_funnel",
    "flattened_submissions", "verified_artifacts", "document_chunks", "packed_attachments",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    runs = []
    for attempt in range(RUNS + 1):
        started = time.perf_counter()
        action()
        if attempt:
            runs.append(time.perf_counter() - started)
    return round(statistics.median(runs), 3)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.all_queries()
    seconds = {}
    for name, pick in CHAIN.items():
        def rebuild():
            chain = Q.chain(spark, SF_DIR, fresh=True)
            consume(pick(chain))
            chain.discard()

        seconds[name] = timed(rebuild)
    for name in PLAIN:
        run = registered[name][0]
        seconds[name] = timed(lambda: consume(run(spark, SF_DIR)))
    print(
        json.dumps({
            "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            "spark": spark.version, "cpus": CPUS, "shuffle_partitions": int(CPUS), "runs": RUNS,
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
