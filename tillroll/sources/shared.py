"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# What the open blocks of `staging` have staged, the innermost last.
_staged: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())

# Fixed value: Spark's switch for giving shuffle files back when a query has ended, not only when
# the driver happens to collect its garbage. Nothing reads the shuffles of a written table again.
_GIVE_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Only a session whose executors run in this very
    process may do without it; then a scratch folder is made and remembered."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="tillroll-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write `df` once and read it back: the plan ends here, readers take only the columns
    they need, and a lost executor costs no recomputation. Disk is what limits large batches, so
    tables are packed well. With `outlives`, the table stays until the block of `staging` around
    the innermost one ends, or for good if there is none."""
    path = f"{shared_dir(df.sparkSession)}/tillroll/{name}-{uuid.uuid4().hex}"
    blocks = _staged.get()[:-1] if outlives else _staged.get()
    if blocks:
        blocks[-1].append(path)
    with shuffles_given_back(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run within the block go when the query has ended."""
    before = spark.conf.get(_GIVE_BACK, None)
    spark.conf.set(_GIVE_BACK, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_GIVE_BACK)
        else:
            spark.conf.set(_GIVE_BACK, before)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged within the block at its end, also if it fails. Nothing that reads
    a staged table may be left over then. Blocks may be nested."""
    around = _staged.set((*_staged.get(), staged := []))
    try:
        yield
    finally:
        _staged.reset(around)
        for name in staged:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
