"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators.uploads import supported_files

# Fixed value: read error of a file that holds no text.
NOT_TEXT = "not valid UTF-8 text"


class InputError(ValueError):
    """The input folder is missing or no folder."""


def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files directly inside a folder, sorted by name. Contents are not read."""
    _require_folder(spark, folder)
    listing = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    return supported_files(listing).orderBy("source_file")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files of a folder as texts for extraction, one row per file."""
    _require_folder(spark, folder)
    return texts_of_files(spark.read.format("binaryFile").load(folder))


def texts_of_files(files: DataFrame) -> DataFrame:
    """`binaryFile` rows -> (source_file, text, content_hash, read_error). Only text files hold
    text; pictures and PDF files come out as unreadable unless their text is joined in."""
    supported = supported_files(files)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    is_text = F.col("file_kind") == "text"
    return supported.select(
        "source_file",
        F.when(is_text, text).alias("text"),
        F.md5("content").alias("content_hash"),
        F.when(is_text & text.isNull(), F.lit(NOT_TEXT)).alias("read_error"),
    )


def stream_texts(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream of texts."""
    reader = spark.readStream.format("binaryFile").schema(schemas.BINARY_FILES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return texts_of_files(reader.load(folder))


def _require_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise InputError(f"input directory does not exist: {folder}")
    if not system.getFileStatus(path).isDirectory():
        raise InputError(f"input path is not a directory: {folder}")
