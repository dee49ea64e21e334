"""Times the headline queries and prints one JSON line.

Every query runs to completion twice into a sink that discards rows; the second
run is reported, so class loading and code generation do not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

from contactloom.session import local_session

HEADLINE = [
    "static_emails",
    "emails_from_result_json",
    "harvested_emails",
    "extract_emails",
    "site_emails",
    "page_links",
    "company_record",
    "dedupe_first",
    "dedupe_first_large",
    "insert_new_emails",
    "update_methods",
    "match_replies",
    "apply_check_results",
    "check_batches",
    "email_stats",
    "metric_report",
    "emails_by_domain",
    "top_domains",
    "expand_queries",
    "find_emails",
    "bulk_find",
    "complete_workflow",
    "stream_dedupe",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from registered.queries import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names or HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
