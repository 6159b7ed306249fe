"""Which rows a person must see, what a run did, and the state of the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reason and alert texts, and the length of the run list.
FAILED, DUPLICATE, NO_DATA = "extraction_failed: ", "duplicate_of: ", "no_data_extracted: "
FAILED_DEFAULT, NO_DATA_DEFAULT = "extraction_failed", "no total extracted"
ALERT_TEXT = "%d receipt(s) need review — run #%d. Check the dashboard: %s"
LISTED_RUNS = 50
DASHBOARD = "table flagged"


def review_reason(receipts: DataFrame) -> Column:
    """Why a row needs review, null if it does not: failed, else duplicate, else no total."""
    joined = F.nullif(F.array_join("warnings", "; "), F.lit(""))
    duplicate = F.nullif(F.col("duplicate_of"), F.lit(""))
    return (
        F.when(
            F.col("extraction_failed"),
            F.concat(F.lit(FAILED), F.coalesce(joined, F.lit(FAILED_DEFAULT))),
        )
        .when(duplicate.isNotNull(), F.concat(F.lit(DUPLICATE), duplicate))
        .when(
            F.col("total").isNull(),
            F.concat(F.lit(NO_DATA), F.coalesce(joined, F.lit(NO_DATA_DEFAULT))),
        )
    )


def flag_for_review(receipts: DataFrame) -> DataFrame:
    return receipts.withColumn("reason", review_reason(receipts))


def summary_metrics() -> dict[str, Column]:
    """What a run counts of its receipts. A failed duplicate counts as both."""
    return {
        "files_processed": F.count(F.lit(1)),
        "flagged_count": F.count(F.when(F.col("reason").isNotNull(), F.lit(1))),
        "duplicate_count": F.count(F.when(F.col("duplicate_of") != "", F.lit(1))),
    }


def run_summary(flagged_receipts: DataFrame, *by: str) -> DataFrame:
    """Counts per run (or over all rows)."""
    return flagged_receipts.groupBy(*by).agg(*[c.alias(name) for name, c in summary_metrics().items()])


def item_id(run_id: Column, source_file: Column) -> Column:
    """The run and 128 bits of the file's name: the same file of the same run has the same id
    however often the run is repeated, and a lookup needs to open that run only."""
    return F.concat(run_id.cast("bigint").cast("string"), F.lit("-"), F.md5(source_file))


def flagged_items(flagged_receipts: DataFrame, created_at: Column) -> DataFrame:
    """The review rows of receipts that carry run_id and reason."""
    return flagged_receipts.where(F.col("reason").isNotNull()).select(
        item_id(F.col("run_id"), F.col("source_file")).alias("item_id"),
        "source_file", "vendor", "date", "total", "reason",
        created_at.cast("timestamp").alias("created_at"),
        "run_id",
    )


def recent_runs(runs: DataFrame, limit: int = LISTED_RUNS) -> DataFrame:
    """The latest runs, newest first."""
    return runs.orderBy(F.desc("run_id")).limit(limit)


def with_review_state(flagged: DataFrame, review_log: DataFrame) -> DataFrame:
    """Flagged rows with `reviewed`; the log may hold an item any number of times."""
    reviewed = review_log.groupBy("item_id").agg(F.max("reviewed_at").alias("reviewed_at"))
    return flagged.join(reviewed, "item_id", "left").withColumn(
        "reviewed", F.col("reviewed_at").isNotNull()
    ).drop("reviewed_at")


def review_queue(
    flagged: DataFrame, review_log: DataFrame, only_unreviewed: bool = False
) -> DataFrame:
    """The queue, newest first."""
    if only_unreviewed:
        rows = flagged.join(review_log, "item_id", "left_anti").withColumn("reviewed", F.lit(False))
    else:
        rows = with_review_state(flagged, review_log)
    return rows.orderBy(F.desc("run_id"), F.desc("source_file"))


def flagged_by_id(flagged: DataFrame, review_log: DataFrame, ids: DataFrame) -> DataFrame:
    """Every asked id with its item, or with nulls where the id is unknown. Both tables are
    reduced to the asked ids first, the items by the run that their ids name."""
    asked = ids.select("item_id").distinct()
    of_run = asked.withColumn("run_id", F.split_part("item_id", F.lit("-"), F.lit(1)).try_cast("bigint"))
    items = flagged.join(of_run, ["run_id", "item_id"], "left_semi")
    reviews = review_log.join(asked, "item_id", "left_semi")
    return asked.join(with_review_state(items, reviews), "item_id", "left")


def apply_reviews(flagged: DataFrame, ids: DataFrame, reviewed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for the review log, unknown ids). Marking an item again is harmless."""
    asked = ids.select("item_id").distinct()
    known = asked.join(flagged, "item_id", "left_semi").select(
        "item_id", reviewed_at.cast("timestamp").alias("reviewed_at")
    )
    return known, asked.join(flagged, "item_id", "left_anti")


def review_stats(runs: DataFrame, flagged: DataFrame, review_log: DataFrame) -> DataFrame:
    """One row: files processed, flagged items, items awaiting review, time of the last run."""
    processed = runs.agg(
        F.coalesce(F.sum("files_processed"), F.lit(0)).alias("files_processed"),
        F.max_by("started_at", "run_id").alias("last_run"),
    )
    queue = with_review_state(flagged, review_log).agg(
        F.count(F.lit(1)).alias("flagged_items"),
        F.count_if(~F.col("reviewed")).alias("awaiting_review"),
    )
    # Both sides are single rows.
    return processed.withColumn("_one", F.lit(1)).join(
        queue.withColumn("_one", F.lit(1)), "_one"
    ).select("files_processed", "flagged_items", "awaiting_review", "last_run")


def alerts(runs: DataFrame, dashboard: str = DASHBOARD) -> DataFrame:
    """One alert for every run that flagged something."""
    text = F.format_string(ALERT_TEXT, "flagged_count", "run_id", F.lit(dashboard))
    return runs.where(F.col("flagged_count") > 0).select(
        text.alias("text"), "flagged_count", "run_id"
    )
