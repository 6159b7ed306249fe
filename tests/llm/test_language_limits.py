import random

from pyspark.sql import functions as F

from tillroll.llm import language


def test_short_texts_stay_and_foreign_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = language.remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out))
    assert model.least.max() <= language.MIN_COSINE and (model.least[:, 0] < language.MIN_COSINE).any()
    whole = language.predict(docs.where(held_out & F.col("text").rlike("[a-zA-Z]")), model)
    assert whole.where("rejected").count() == 0
    # Words of documents the model has not seen, one and two at a time.
    words = docs.where(held_out).select(F.regexp_extract_all("text", F.lit(r"\b([a-zà-ÿ]{4,14})\b"), 1).alias("w"), "lang")
    short = words.where("size(w) > 5").select(F.explode(F.array(F.get("w", F.lit(0)), F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3))))).alias("text"))
    got = language.predict(short, model)
    n = got.count()
    assert n > 300 and got.where("rejected").count() <= 0.02 * n
    dice = random.Random(1)
    noise = spark.createDataFrame([("".join(dice.choices("bcdfghjklmnpqrstvwxyzжшщ", k=200)),) for _ in range(100)], "text string")
    assert language.predict(noise, model).where("rejected").count() >= 95
