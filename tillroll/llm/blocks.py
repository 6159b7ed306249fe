"""Blocks: rows dealt evenly over the partitions of a shuffle, so that texts and what is known
about them can meet task by task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def even_blocks(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a shuffle over n partitions puts into a partition each."""
    found = (
        spark.range(40 * n + 1000)
        .groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
        .agg(F.min("id").cast("int").alias("id"))
        .orderBy("p")
        .collect()
    )
    return [r["id"] for r in found]


def block_of(hashed: Column, blocks: list[int]) -> Column:
    """The block for a 64-bit hash."""
    labels = F.array(*[F.lit(b) for b in blocks])
    return F.get(labels, F.pmod(hashed, F.lit(len(blocks))).cast("int"))


def pack(columns: tuple[np.ndarray, ...]) -> bytes:
    """Columns of 64-bit values by their bytes' places, which compresses well."""
    planes = np.stack([c.view(np.uint64) for c in columns])
    return planes.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(n, 8, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(np.uint64).reshape(n, -1)
