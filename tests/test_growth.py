"""Work that is done once per row, or written once, however large the tables are."""

import datetime

from pyspark.sql import functions as F

from tillroll.functions import fields, money
from tillroll.functions.dates import find_date
from tillroll.operators import duplicates, replies
from tillroll.operators.extract import evaluate_once
from tillroll.options import Options
from workload import inputs
from workload.receipts import receipt_texts

DAY = datetime.date(2026, 1, 5)


def _tables(spark, folder):
    spark.createDataFrame([(k, 1, 10.5, DAY) for k in (7, 11, 12)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "Shop")], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "pen")], "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(7, 1, 1, 1, 2.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")


def test_texts_are_rendered_in_one_pass(spark, tmp_path):
    _tables(spark, tmp_path)
    texts = receipt_texts(spark, str(tmp_path))
    found = {r["source_file"].lstrip("r_0"): r["text"] for r in texts.collect()}
    assert sorted(found) == ["11.txt", "11_scan.txt", "12.txt", "7.txt", "7_copy.txt"]
    assert found["7.txt"] == found["7_copy.txt"] and "pen  €2.00" in found["7.txt"]
    assert found["11_scan.txt"] == "SHOP\n\nDate: 2026-01-05\nTOTAL  £10.50\n"
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_linenumber" in line for line in plan.split("\n")) == 1


def test_what_is_evaluated_once_is_compiled(spark):
    rows = evaluate_once(spark.createDataFrame([("a",)], "x string"), y=F.upper("x")).where("y = 'A'")
    assert [tuple(r) for r in rows.collect()] == [("a", "A")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.split("\n") if "Generate" in line]
    assert generators and not any("upper(" in line for line in generators)


def test_keys_are_not_written_beside_the_columns_they_follow_from(spark, monkeypatch):
    written = {}
    stage = duplicates.stage
    monkeypatch.setattr(duplicates, "stage", lambda df, name: written.setdefault(name, df.schema) and stage(df, name))
    rows = [("a", "v", "d", 1.0, "h1"), ("b", "V", "d", 1.0, "h2"), ("c", None, None, None, "h2"), ("d", None, None, None, None)]
    receipts = spark.createDataFrame(rows, "source_file string, vendor string, date string, total double, content_hash string")
    receipts = receipts.withColumns({"warnings": F.array(F.lit("read")), "duplicate_of": F.lit(None).cast("string")})
    marked = {r["source_file"]: r["duplicate_of"] for r in duplicates.mark_duplicates_any(receipts).collect()}
    assert marked == {"a": None, "b": "a", "c": None, "d": None}
    assert [f.name for f in written["keyed"]] == [*receipts.columns, "_pair"]
    assert written["keyed"]["_pair"].dataType.typeName() == "binary"


def test_dates_are_searched_for_once_per_form(spark):
    texts = ["Paid 2026-01-31 late", "31/01/2026", "on 5-6-2026", "7 Feb 2026", "x Feb 7, 2026 x", "aFeb 7, 2026", "1Feb 7, 2026", "2026-13-01 or 3/4/2025", "none", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    found = rows.select("i", find_date(F.col("text"), Options()).alias("date"))
    dates = [r["date"] for r in found.orderBy("i").collect()]
    assert dates == ["2026-01-31", "2026-01-31", "2026-05-06", "2026-02-07", "2026-02-07", None, None, "2025-03-04", None, None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 5


def test_money_is_looked_for_where_a_symbol_or_digit_stands(spark):
    rows = spark.createDataFrame([("Tea  $ 1,234.50 x 2\nTOTAL €٣.٥\n$ none 7\n12,34.5",)], "text string")
    found = rows.select(money.cut_lines(F.col("text"), Options()).alias("cut"), money.amounts(F.col("text"), Options()).alias("amounts"))
    row = found.first()
    assert row["amounts"] == [1234.5, 3.5, 34.5]
    assert [line.split("﷓")[1:3] for line in row["cut"].split("\n") if "﷓" in line] == [["$", " 1,234.50"], ["€", "٣.٥"], ["", "34.5"]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=[") == 2


def test_replies_are_parsed_once_and_searched_without_looking_back(spark):
    rows = spark.createDataFrame([("a", '```JSON\n{"vendor": true, "total": NaN, "tax": "$1,0", "line_items": [{"description": "true", "amount": -Infinity}]}\n ```')], "source_file string, reply string")
    found = replies.parse_replies(rows)
    row = found.first()
    assert (row["vendor"], repr(row["total"]), row["tax"]) == ("True", "nan", 10.0)
    assert [tuple(i) for i in row["line_items"]] == [("true", float("-inf"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson(") == 1 and "(?<!" not in plan


def test_responses_are_rendered_in_one_pass_and_read_once(spark, tmp_path):
    orders = [(k, 1, 10.5, DAY, "1-URGENT") for k in (7, 11, 12)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Shop")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    responses = inputs.responses(spark, str(tmp_path))
    assert sorted((r["k"], r["seq"], r["status"]) for r in responses.collect()) == [(7, 70, 200), (11, 110, 200), (12, 120, 200)]
    plan = responses._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Union" not in plan
    resolved = replies.resolve_attempts(replies.classify_responses(responses), "run_id", "source_file")
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "o_orderkey" not in plan


def test_plain_texts_stay_plain_while_their_money_is_found(spark):
    rows = spark.createDataFrame([("Room 12\nTax 3 of  $4.50 Total\nGrand  €7.00 total\nTea 2  $1.25",)], "text string")
    cut = rows.select(money.cut_lines(F.col("text"), Options()).alias("text"), fields.cut_text(F.col("text"), Options()).alias("lines"))
    first = cut.first()["text"].split("\n")[0]
    assert first.isascii() and first != "Room 12"
    priced = cut.select(fields.money_lines(F.col("lines"), Options()).alias("p")).first()["p"]
    assert [tuple(line["has"]) for line in priced] == [(True, True, False, False), (True, False, False, False), (False, False, False, False)]
