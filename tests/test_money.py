import random

from pyspark.sql import functions as F

from tillroll.functions.money import money_text, round_money
from tillroll.operators.normalize import TAX_OVER_TOTAL, normalize


def test_rounding_follows_the_exact_value(spark):
    rng = random.Random(5)
    numbers = [2.675, 1.005, 0.125, 0.375, -2.675, 1e-9, 5.0, 1e17, 123456.785, 0.005, -0.0, 9.5e12 + 0.125]
    numbers += [round(rng.uniform(-1e6, 1e6), 3) for _ in range(4000)]
    numbers += [rng.randrange(-10**7, 10**7) / 1000 + 0.0005 * rng.randrange(2) for _ in range(4000)]
    numbers += [rng.randrange(10**8) / 100 + 0.005 for _ in range(4000)]
    df = spark.createDataFrame([(n,) for n in numbers], "x double")
    got = df.select("x", round_money(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 2)] == []


def test_rounding_of_large_and_half_values(spark):
    rng = random.Random(11)
    numbers = [1e15, 1e15 + 0.125, 4e13 + 0.375, 2.0**46, 2.0**46 - 0.0078125, -(2.0**46) + 0.0078125, 9007199254740993.0, 1e300]
    numbers += [rng.uniform(-(2.0**e), 2.0**e) for e in range(-12, 60) for _ in range(60)]
    numbers += [rng.randrange(2**50) / 2 ** rng.randrange(3, 12) for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in numbers], "x double")
    got = df.select("x", round_money(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r, round(r.x, 2)) for r in got if r.r != round(r.x, 2)] == []


def test_rounding_of_what_is_no_amount(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,)], "x double")
    got = [r.r for r in df.select(round_money(F.col("x")).alias("r")).collect()]
    assert got[0] == float("inf") and got[1] != got[1] and got[2] is None


def test_money_text(spark):
    df = spark.createDataFrame([(5.0,), (12345678.9,), (2.05,), (0.0,), (None,)], "x double")
    assert [r.t for r in df.select(money_text(F.col("x")).alias("t")).collect()] == [
        "5.0", "12345678.9", "2.05", "0.0", None,
    ]


def test_normalize(spark):
    df = spark.createDataFrame(
        [("  a \t b ", 2.675, 3.0, [(" x  y ", 1.005), (None, None)], []), (" ", None, 1.0, [], ["w"])],
        "vendor string, total double, tax double, "
        "line_items array<struct<description: string, amount: double>>, warnings array<string>",
    )
    first, second = normalize(df).collect()
    assert (first.vendor, first.total, first.tax, first.warnings) == ("a b", 2.67, 3.0, [TAX_OVER_TOTAL])
    assert [tuple(i) for i in first.line_items] == [("x y", 1.0), ("", None)]
    assert (second.vendor, second.warnings) == (None, ["w"])
