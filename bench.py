"""Time the headline jobs and print one JSON line.

The receipt texts are rendered once from the tables and written; that time is reported apart,
because it belongs to the test data. Every job runs once to warm up and once for the clock."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.operators import duplicates, extract, replies, review  # noqa: E402
from tillroll.plans.batch import extract_batch, process_batch  # noqa: E402
from tillroll.sources.shared import stage  # noqa: E402
from tillroll.sources.store import ReviewStore  # noqa: E402
from workload import inputs  # noqa: E402
from workload.queries import QUERIES  # noqa: E402
from workload.receipts import receipt_texts  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    start = time.time()
    texts = stage(receipt_texts(spark, SF_DIR).repartition(int(CPUS)), "texts")
    rows = texts.count()
    fixture_sec = time.time() - start
    answers = stage(inputs.responses(spark, SF_DIR).repartition(int(CPUS)), "responses")
    mixed = stage(inputs.mixed_keys(spark, SF_DIR).repartition(int(CPUS)), "mixed")
    tables = tempfile.mkdtemp(prefix="run-")

    def resolved():
        attempts = replies.classify_responses(answers)
        return replies.failure_scope(replies.resolve_attempts(attempts, "run_id", "source_file"))

    jobs = {
        "receipts": lambda: run(extract.read_receipts(texts)),
        "line_items": lambda: run(extract.explode_items(extract.read_receipts(texts))),
        "mark_duplicates": lambda: run(extract_batch(texts)),
        "run_summary": lambda: run(review.run_summary(review.flag_for_review(extract_batch(texts)))),
        "process_batch": lambda: run(process_batch(texts, ReviewStore(spark, tables, owner="bench"), 1)),
        "reply_receipts": lambda: run(replies.receipts_from_responses(resolved())),
        "mark_duplicates_any": lambda: run(duplicates.mark_duplicates_any(mixed)),
    }
    for name in ("document_receipts", "document_amounts", "duplicates_by_hash", "run_summary_by_tick", "review_queue", "review_stats"):
        jobs[name] = lambda name=name: run(QUERIES[name](spark, SF_DIR))

    seconds = {}
    for name, job in jobs.items():
        job()
        start = time.time()
        job()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "texts": rows,
                "texts_per_sec": round(rows / seconds["receipts"]),
                "fixture_sec": round(fixture_sec, 3),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
