"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, chat, decontaminate, language, licenses, merkle, negatives, pitman_yor, quality, sharding, simhash, suffixes, tokenfile
from tillroll.sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema
    )
    return chat.digests(chat.format_chats(rows.unionByName(more)))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = language.remainder(F.col("doc_id"), 7) != 2
    return pitman_yor.score(table(spark, sf_dir, "documents"), train)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = language.remainder(F.col("doc_id"), 7) == 0
    return merkle.audit(table(spark, sf_dir, "documents"), changed)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tillroll/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_digests(tokenfile.read_segments(spark, path))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_chat_format": op4_chat_format,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_repeats": op6_repeats,
    "op7_decontaminate": op7_decontaminate,
    "op8_shards": op8_shards,
    "op9_licenses": op9_licenses,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_negatives": op12_negatives,
    "op13_tokens": op13_tokens,
}
