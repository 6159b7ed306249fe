"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, benchmark
decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, decontaminate, language, simhash, suffixes
from tillroll.sources.shared import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go. It learns from the documents that name
    their language, but for those held out."""
    model = language.fit(docs.where(language.remainder(F.col("doc_id"), 3) != 1))
    return language.predict(docs, model).where(~F.col("rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, one row of it
    if rows repeat. Documents without an id stay: nothing can name them."""
    classes = stage(simhash.near_duplicates(docs.where("doc_id is not null")), "classes")
    first = classes.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    left = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    # Texts are grouped by id only where an id repeats, which the narrow table tells.
    if not classes.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id"])
    return left.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what earlier documents have said; a document that loses all of it goes. Bytes
    of a character that was cut in two go as well, and n_chars follows the text."""
    cut = suffixes.remove_repeats(docs)
    whole = F.size("spans") == 0
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    # What is no character any more has become U+FFFD.
    text = F.when(whole, text).otherwise(F.replace(text, F.lit("\ufffd"), F.lit("")))
    left = cut.where(whole | (F.octet_length("kept") > 0)).withColumn("text", text)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode_tokens),
]

#: SQL can express neither the language model nor the sampled parts of the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
