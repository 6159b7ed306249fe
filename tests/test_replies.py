import json
import random

import pytest
from pyspark.sql import functions as F

from tillroll.functions import replies as r
from tillroll.operators import replies
from tillroll.options import Options
from tillroll.plans.engines import build_engine

REPLY = {"vendor": " Cafe ", "date": "2026-01-05", "total": "$1,234.5", "tax": 0.5, "currency": "EUR"}


def parsed(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_file string, reply string")
    return [row for row in sorted(replies.parse_replies(df).collect(), key=lambda x: int(x.source_file))]


def test_reply_texts(spark):
    plain = json.dumps(REPLY)
    rows = parsed(spark, [plain, f"```json\n{plain}\n```", f" ```JSON {plain}``` \n", f"```{plain}"])
    for row in rows:
        assert (row.vendor, row.date, row.total, row.tax, row.currency) == ("Cafe", "2026-01-05", 1234.5, 0.5, "EUR")
        assert row.warnings == [] and row.line_items == [] and not row.extraction_failed


def test_last_of_a_repeated_key(spark):
    row = parsed(spark, ['{"vendor": "a", "total": 1, "vendor": "b", "total": 2}'])[0]
    assert (row.vendor, row.total, row.warnings) == ("b", 2.0, [])


def test_replies_that_are_no_object(spark):
    objects = ["[1]", "5", "null", '"x"', "[]"]
    broken = ["nope", "", "   ", None, '{"a": 1} thanks', '{"a": 1}, {"b": 2}', '{"a": 1}]', '{"a": 1', "{'a': 1}", '```json\n{"a": 1}\n``` bye']
    rows = parsed(spark, objects + broken)
    assert [x.warnings for x in rows[: len(objects)]] == [[replies.NOT_OBJECT]] * len(objects)
    assert [x.warnings for x in rows[len(objects):]] == [[replies.NOT_JSON]] * len(broken)
    assert all(x.vendor is None and x.total is None and not x.extraction_failed for x in rows)


def test_reply_values(spark):
    reply = {
        "vendor": True, "date": "  ", "total": "USD 5", "tax": True,
        "line_items": [{"description": " Tea ", "amount": "£2"}, "junk", None, [1], {"amount": ""}, {"description": 7, "amount": 3}],
    }
    (row,) = parsed(spark, [json.dumps(reply)])
    assert (row.vendor, row.date, row.total, row.tax, row.currency) == ("True", None, None, None, None)
    assert [tuple(i) for i in row.line_items] == [("Tea", 2.0), ("", None), ("7", 3.0)]
    rows = parsed(spark, ['{"line_items": 5}', '{"line_items": "abc"}', '{"line_items": {"a": 1}}', '{"line_items": null}'])
    assert [x.line_items for x in rows] == [[]] * 4


NUMBERS = {
    "$1,234.5": 1234.5, "USD 5": None, "": None, "true": None, "5d": None, "5f": None, "1e3": 1000.0,
    " 7 ": 7.0, "₱ 99": 99.0, "-3": -3.0, "$-3": -3.0, "-$3": None, "1_000": 1000.0, "1__0": None, "_1": None,
    ".5": 0.5, "5.": 5.0, ".": None, "inf": float("inf"), "1 2": None, "0x10": None, "٣": 3.0, "+4": 4.0,
}


def test_clean_number(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string")
    got = {row.t: row.n for row in df.select("t", r.clean_number(F.col("t")).alias("n")).collect()}
    assert got == NUMBERS


BODIES = {
    '{"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}': ("hi", r.NO_ERROR_DETAIL),
    '{"candidates": []}': (None, r.NO_ERROR_DETAIL),
    '{"error": {"message": "m", "status": "s"}}': (None, "m"),
    '{"error": {"message": "", "status": "s"}}': (None, "s"),
    '{"error": "boom"}': (None, "boom"),
    '{"error": ""}': (None, r.NO_ERROR_DETAIL),
    '{"error": null}': (None, r.NO_ERROR_DETAIL),
    "[]": (None, r.NO_ERROR_DETAIL),
    "no json": (None, r.NO_ERROR_DETAIL),
}


def test_bodies(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "b string")
    got = df.select("b", r.reply_text(F.col("b")).alias("t"), r.error_text(F.col("b")).alias("e")).collect()
    assert {x.b: (x.t, x.e) for x in got} == BODIES


def body(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


RESPONSES = "source_file string, content_hash string, seq bigint, status int, body string"


def attempts(spark, rows):
    return spark.createDataFrame([(n, "h" + n, s, st, b) for n, s, st, b in rows], RESPONSES)


def test_outcomes(spark):
    df = spark.createDataFrame(
        [(s, t) for s in (0, 200, 301, 400, 429, 499, 500, 599, 600) for t in ("x", None)], "s int, t string"
    )
    got = {(x.s, x.t): x.o for x in df.select("s", "t", r.call_outcome(F.col("s"), F.col("t")).alias("o")).collect()}
    retry = {0, 429, 500, 599}
    for (status, text), outcome in got.items():
        want = "done" if status == 200 and text else "retryable" if status in retry else "failed"
        assert outcome == want


def test_files_after_the_first_success_fail_alone(spark):
    engine = build_engine(Options(engine="ai_vision"))
    df = attempts(spark, [
        ("a", 1, 429, "{}"), ("a", 2, 200, body('{"total": 2.675, "tax": 3}')),
        ("b", 3, 500, '{"error": "down"}'), ("b", 4, 500, '{"error": "still down"}'),
        ("c", 5, 0, '{"error": "network"}'), ("d", 6, 200, "{}"), ("e", 7, None, None),
    ])
    got = {x.source_file: x for x in engine(df, Options(engine="ai_vision")).collect()}
    assert got["a"].total == 2.67 and got["a"].warnings == ["tax is greater than total — check this row"]
    assert got["a"].engine == "ai_vision" and got["a"].content_hash == "ha"
    assert {n: got[n].warnings for n in "bcde"} == {
        "b": [replies.FILE_FAILED + "HTTP 500: still down"],
        "c": [replies.FILE_FAILED + "network"],
        "d": [replies.FILE_FAILED + "HTTP 200: response contained no text"],
        "e": [replies.NOT_RENDERED],
    }
    assert all(got[n].extraction_failed for n in "bcde") and not got["a"].extraction_failed


def test_a_failure_before_any_success_stops_the_run(spark):
    engine = build_engine(Options(engine="ai"))
    df = attempts(spark, [("a", 1, 400, '{"error": {"message": "bad key"}}'), ("b", 2, 200, body("{}"))])
    with pytest.raises(replies.SystemicFailure, match="HTTP 400: bad key"):
        engine(df, Options(engine="ai"))
    unrendered = attempts(spark, [("a", 1, None, None), ("b", 2, 200, body("{}"))])
    assert engine(unrendered, Options(engine="ai")).count() == 2


def test_engines_are_chosen_by_name():
    class Odd:
        engine = "odd"

    with pytest.raises(ValueError, match="odd"):
        build_engine(Odd())


def test_numbers_that_json_does_not_have(spark):
    """Against Python's own reader, which takes them."""
    rng = random.Random(3)
    values = ["NaN", "-Infinity", "Infinity", " Infinity ", "1.5", '"NaN"', '"a, Infinity ]"', '"\\\\"', '"\\", NaN"', "-NaN", "xNaN", "null", "[NaN, 1]"]
    texts = [
        f'{{"vendor": {rng.choice(values)}, "note": {rng.choice(values)}, "total":{rng.choice(values)}, "line_items": [{rng.choice(values)}, {{"amount": {rng.choice(values)}}}]}}'
        for _ in range(200)
    ] + ["NaN", "[Infinity]", "{NaN: 1}", '{"total": NaN', '{"a": "\x01", "total": NaN}', '```json\n{"total": Infinity}```', '{"a": "' + "x\\\"" * 30_000 + '", "total": NaN}']
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    got = parsed(spark, texts)
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before

    def number(v):
        try:
            return None if v is None or isinstance(v, (list, bool)) else float(str(v))
        except ValueError:
            return None

    for text, row in zip(texts, got, strict=True):
        try:
            want = json.loads(text.removeprefix("```json\n").removesuffix("```"))
        except json.JSONDecodeError:
            assert row.warnings == [replies.NOT_JSON], text
            continue
        if not isinstance(want, dict):
            assert row.warnings == [replies.NOT_OBJECT], text
            continue
        assert row.warnings == []
        assert repr(row.total) == repr(number(want.get("total"))), text
        if not isinstance(want.get("vendor"), list):
            assert row.vendor == (None if want.get("vendor") is None else str(want["vendor"]).strip() or None), text
        amounts = [number(i["amount"]) for i in want.get("line_items", []) if isinstance(i, dict)]
        assert repr([i.amount for i in row.line_items]) == repr(amounts), text


def test_one_attempt_per_file(spark):
    schema = "run_id long, source_file string, seq long, status int, reply string, outcome string, message string"
    rows = [(0, f"s{i}", i, 200, "x" * 50, "done", None) for i in range(50)]
    rows += [(0, "a", 1, 500, None, "retryable", "m"), (0, "a", 2, 200, "yes", "done", None), (0, "a", 3, 500, None, "failed", "n")]
    rows += [(1, "a", 1, 500, None, "retryable", "m"), (1, "a", 7, 400, None, "failed", "last"), (None, "n", None, 0, None, None, None)]
    rows += [(0, "t", 5, 200, "p", "done", None), (0, "t", 5, 200, "q", "done", None), (0, "t", 4, 200, "z", "done", None)]
    rows += [(0, "w", 5, 200, "p", "done", None)] * 3
    for with_ties in (rows, [r for r in rows if r[1] not in "tw"]):
        df = spark.createDataFrame(with_ties, schema)
        got = {(r.run_id, r.source_file): (r.seq, r.reply, r.message) for r in replies.resolve_attempts(df, "run_id", "source_file").collect()}
        assert len(got) == replies.resolve_attempts(df, "run_id", "source_file").count()
        assert got[0, "a"] == (2, "yes", None) and got[1, "a"] == (7, None, "last") and got[None, "n"] == (None, None, None)
        assert got[0, "s7"][0] == 7
        if with_ties is rows:
            assert got[0, "t"] == (5, "q", None) and got[0, "w"] == (5, "p", None)


def test_replies_stay_out_of_the_shuffle(spark, tmp_path):
    rows = [(0, f"s{i}", i, 200, "x" * 50, "done", None) for i in range(50)] + [(0, "s1", 99, 200, "y", "done", None)]
    spark.createDataFrame(rows, "run_id long, source_file string, seq long, status int, reply string, outcome string, message string").write.parquet(str(tmp_path / "a"))
    plan = replies.resolve_attempts(spark.read.parquet(str(tmp_path / "a")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
