from pyspark.sql import functions as F

from tillroll.llm import licenses


def test_only_pairs_of_known_words_are_built(spark):
    rows = spark.createDataFrame([("b a x b a c",), ("x y",), ("a",), ("c b b",)], "line string")
    words, among = F.split("line", " "), F.array(F.lit("a"), F.lit("b"))
    got = rows.select(licenses._grams_among(words, among), licenses._grams(words)).collect()
    assert [r[0] for r in got] == [["b", "a", "b a"], [], ["a"], ["b", "b b"]]
    assert all(r[0] == [g for g in r[1] if set(g.split()) <= {"a", "b"}] for r in got)
