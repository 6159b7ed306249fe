"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows are counted per hash bucket of their key, so the table of salts never has more than
# BUCKETS rows and may be broadcast. A bucket of up to SHARE times the mean keeps one salt.
BUCKETS = 65_536
SHARE = 8
LEAST_ROWS = 1_000


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def heavy_buckets(rows: DataFrame, key: str, buckets: int = BUCKETS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(_heavy, _salts): the buckets of a key that hold far more than their share of the rows, and
    over how many parts to spread them."""
    counts = rows.groupBy(_bucket(F.col(key), buckets).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    mean = counts.agg((F.sum("_n") / buckets).alias("_mean"))
    share = F.greatest(F.col("_mean") * SHARE, F.lit(float(least_rows)))
    return counts.join(F.broadcast(mean), F.col("_n") > share).select(
        F.col("_bucket").alias("_heavy"), F.ceil(F.col("_n") / share).cast("int").alias("_salts")
    )


def in_heavy(rows: DataFrame, heavy: DataFrame, key: str, how: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows in heavy buckets (`left_semi`) or in the others (`left_anti`)."""
    return rows.join(F.broadcast(heavy), _bucket(F.col(key), buckets) == F.col("_heavy"), how)


def join_salted(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    row_id: str,
    buckets: int = BUCKETS,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """Left join `facts`, at most one row per `key`, onto `rows`, which are read twice.

    The rows of a heavy bucket are spread over salts by `row_id`, and its facts are repeated
    per salt, so no task holds more than about SHARE / `buckets` of all rows however few keys
    there are. Rows with a null key find no fact and are spread as well. Columns of `facts`
    must not be named as columns of `rows`, the key apart."""
    added = [c for c in facts.columns if c != key]
    heavy = F.broadcast(heavy_buckets(rows, key, buckets, least_rows))
    salt = F.pmod(F.xxhash64(F.col(row_id)), F.coalesce("_salts", F.lit(1))).cast("int")
    spread = rows.join(heavy, _bucket(F.col(key), buckets) == F.col("_heavy"), "left").withColumn("_salt", salt)
    repeated = (
        facts.where(F.col(key).isNotNull())
        .join(heavy, _bucket(F.col(key), buckets) == F.col("_heavy"), "left")
        .select(
            F.col(key).alias("_fact_key"),
            F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_fact_salt"),
            *added,
        )
    )
    joined = spread.join(
        repeated, (F.col(key) == F.col("_fact_key")) & (F.col("_salt") == F.col("_fact_salt")), "left"
    )
    return joined.select(*[F.col(c) for c in rows.columns], *added)
