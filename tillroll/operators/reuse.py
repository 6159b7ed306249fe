"""Earlier results by content hash: reuse them, find what is left to do, store what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators.extract import as_receipts, evaluate_once
from tillroll.operators.skew import LEAST_ROWS, join_salted

# Fixed value: warning text.
FROM_CACHE = "loaded from checkpoint (not re-sent to AI)"

# The stored part of a receipt; hash, duplicate and failure belong to a run, not to the bytes.
STORED = (
    "source_file", "vendor", "date", "currency", "total", "tax", "engine", "line_items", "warnings",
)
_STORED_SCHEMA = (
    "source_file string, vendor string, date string, currency string, total double, tax double, "
    f"engine string, line_items {schemas.LINE_ITEMS}, warnings array<string>"
)


def reuse_cached(files: DataFrame, cache: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Receipts of the files whose bytes are known, under the name they arrive with.

    The cache is append-only; of the rows of one hash the latest run counts. Only hashes of
    this batch are looked at, once each, and joined back without gathering the files of one
    hash in one task."""
    kept = [c for c in STORED if c != "source_file"]
    sizes = files.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_size"))
    latest = F.max_by(F.struct(*kept), F.struct("run_id", "source_file"))
    known = (
        cache.join(sizes, "content_hash")
        .groupBy("content_hash")
        .agg(latest.alias("stored"), F.max("_size").alias("_size"))
        .select("content_hash", "_size", "stored.*", F.lit(True).alias("_known"))
    )
    arrived = files.select("source_file", "content_hash")
    joined = join_salted(arrived, known.drop("_size"), "content_hash", "source_file", least_rows=least_rows)
    earlier = F.coalesce("warnings", F.array().cast("array<string>"))
    return as_receipts(
        joined.where("_known").withColumns(
            {
                "warnings": F.array_prepend(earlier, F.lit(FROM_CACHE)),
                "duplicate_of": F.lit(None).cast("string"),
                "extraction_failed": F.lit(False),
            }
        )
    )


def pending_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """One file, the first by name, for every hash that is not stored yet."""
    first = files.groupBy("content_hash").agg(F.min("source_file").alias("source_file"))
    return first.join(cache.select("content_hash"), "content_hash", "left_anti").select(
        "source_file", "content_hash"
    )


def cache_updates(receipts: DataFrame, run_id: int) -> DataFrame:
    """What a run adds to the cache: successes only, the first file of each hash. Failures are
    left out, so that the next run tries them again."""
    return (
        receipts.where(~F.col("extraction_failed") & F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.min_by(F.struct(*STORED), F.col("source_file")).alias("stored"))
        .select("content_hash", "stored.*", F.lit(run_id).cast("bigint").alias("run_id"))
    )


def to_json(receipts: DataFrame) -> DataFrame:
    """One JSON text per receipt, nulls included."""
    return receipts.select(
        "content_hash",
        F.to_json(F.struct(*STORED), {"ignoreNullFields": "false"}).alias("json"),
    )


def from_json(stored: DataFrame) -> DataFrame:
    """Receipts out of stored JSON; texts that are no such object are left out. A text is parsed
    once, not for the filter and again for what passes it."""
    parsed = evaluate_once(
        stored.select("content_hash", "json"),
        r=F.from_json("json", _STORED_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}),
    )
    usable = parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull())
    return usable.select("content_hash", *[f"r.{c}" for c in STORED])
