"""What arrives: which files count, of what kind, and which upload of a name holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Supported file types. Text files are ours; texts are the input here.
PDF_EXTENSIONS = (".pdf",)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".heic", ".heif", ".webp")
TEXT_EXTENSIONS = (".txt",)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def extension(path: Column) -> Column:
    """Last extension in lower case; a name that only starts with a point has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def file_kind(path: Column) -> Column:
    """pdf, image or text, null for anything else."""
    ext = extension(path)
    return (
        F.when(ext.isin(*PDF_EXTENSIONS), F.lit("pdf"))
        .when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext.isin(*TEXT_EXTENSIONS), F.lit("text"))
    )


def supported_files(listing: DataFrame) -> DataFrame:
    """The files of a listing (`path`, ...) that can be worked on, with name and kind."""
    return (
        listing.withColumn("file_kind", file_kind(F.col("path")))
        .where(F.col("file_kind").isNotNull())
        .withColumn("source_file", file_name(F.col("path")))
    )


def latest_upload(uploads: DataFrame) -> DataFrame:
    """One row per name: the upload that arrived last, the higher `seq` among equal times.

    Names and times alone are grouped; of the payloads only the winners are kept. Repeated rows
    with one `seq` stay as they are, one per row."""
    last = uploads.groupBy(F.col("source_file").alias("_name")).agg(
        F.max(F.struct("arrived_at", "seq")).alias("_last")
    )
    same = (
        (F.col("source_file").eqNullSafe(F.col("_name")))
        & F.col("arrived_at").eqNullSafe(F.col("_last.arrived_at"))
        & F.col("seq").eqNullSafe(F.col("_last.seq"))
    )
    return uploads.join(last, same).select("source_file", *[c for c in uploads.columns if c != "source_file"])


def not_outdated(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """The uploads, one per name, that are later than all that earlier runs have stored of their
    name. `stored` holds (source_file, arrived_at, seq), any number of rows per name."""
    names = uploads.select("source_file")
    last = (
        stored.join(names, "source_file", "left_semi")
        .groupBy("source_file")
        .agg(F.max(F.struct("arrived_at", "seq")).alias("_last"))
    )
    later = F.col("_last").isNull() | (F.struct("arrived_at", "seq") > F.col("_last"))
    return uploads.join(last, "source_file", "left").where(later).select(uploads.columns)
