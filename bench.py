"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

from gazette.plans.catalog import QUERIES
from gazette.session import local_session

HEADLINE = [
    "feed_first_k", "feed_counts", "batch_dedup", "new_articles", "already_processed",
    "rss_entries", "entry_date", "image_resolve", "image_override", "article_content",
    "clean_content", "unescape_text", "chunk_capped", "topic_groups", "payload_parse",
    "page_record", "ledger_append", "ledger_retention", "ledger_remove", "purge_report",
    "similar_titles", "near_dup_content", "embedding_neighbors", "commercial_flag",
    "lead_summary", "top_tag", "prompt_budget", "source_summary", "tag_rollup", "enrich",
    "article_pipeline", "stream_dedup", "stream_intake",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("topic_groups")  # starts the executor threads
    times = {name: run(name) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
