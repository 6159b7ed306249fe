"""Logged model responses -> receipts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.functions import replies as r
from tillroll.functions.text import ascii_digits
from tillroll.operators.extract import as_receipts, evaluate_once
from tillroll.operators.normalize import normalize
from tillroll.operators.skew import LEAST_ROWS, join_salted
from tillroll.sources.shared import stage

# Warning texts and scope names.
NOT_JSON, NOT_OBJECT = "AI reply was not valid JSON", "AI reply was not a JSON object"
FILE_FAILED = "AI vision failed for this file — "
NOT_RENDERED = "could not render file to an image for vision"
SYSTEMIC, SINGLE = "systemic", "single"

_STRINGS, _NUMBERS = ("vendor", "date", "currency"), ("total", "tax")


class SystemicFailure(RuntimeError):
    """A request failed before any file of the run had succeeded."""


def parse_replies(replies: DataFrame, engine: str = "ai_vision") -> DataFrame:
    """(source_file, reply[, content_hash]) -> receipts. A reply that is no JSON object gives a
    row with a warning; that is a result, not a failure."""
    return as_receipts(_read_replies(replies, engine))


def _read_replies(replies: DataFrame, engine: str) -> DataFrame:
    """As `parse_replies`, with the other columns of the input kept."""
    if "content_hash" not in replies.columns:
        replies = replies.withColumn("content_hash", F.lit(None).cast("string"))
    bare = evaluate_once(replies, _bare=r.without_fence(F.col("reply")))
    clean = evaluate_once(bare, _clean=r.with_spelled_numbers(F.col("_bare")))
    with _last_key_counts(replies.sparkSession):
        both = evaluate_once(clean, _both=r.parsed_with_end(F.col("_clean")))
    parsed = evaluate_once(both, _json=r.whole_value(F.col("_both"), F.col("_clean")))
    # Trimmed text that is one value is an object if it begins like one.
    is_object = F.col("_json").isNotNull() & F.startswith("_clean", F.lit("{"))
    warning = F.when(F.col("_json").isNull(), F.lit(NOT_JSON)).when(~is_object, F.lit(NOT_OBJECT))
    # One step of a value at a time: what is used twice is a column then, and compiled.
    found = evaluate_once(
        evaluate_once(parsed, _warning=warning, _object=F.when(is_object, F.col("_json"))),
        **{f"_{n}": F.try_variant_get("_object", f"$.{n}", "string") for n in (*_STRINGS, *_NUMBERS)},
    )
    numbers = evaluate_once(found, **{f"_bare_{n}": r.bare_number(F.col(f"_{n}")) for n in _NUMBERS})
    read = evaluate_once(
        evaluate_once(numbers, **{f"_digits_{n}": ascii_digits(F.col(f"_bare_{n}")) for n in _NUMBERS}),
        **{n: r.clean_string(F.col("_object"), f"$.{n}", F.col(f"_{n}")) for n in _STRINGS},
        **{n: r.number_of(F.col(f"_digits_{n}")) for n in _NUMBERS},
        line_items=F.coalesce(r.clean_items(F.col("_object")), F.array().cast(schemas.LINE_ITEMS)),
    )
    done = read.withColumns(
        {
            "engine": F.lit(engine),
            "warnings": F.array_compact(F.array("_warning")),
            "duplicate_of": F.lit(None).cast("string"),
            "extraction_failed": F.lit(False),
        }
    )
    return done.select(*replies.columns, *[c for c in done.columns if c not in replies.columns and not c.startswith("_")])


@contextmanager
def _last_key_counts(spark: SparkSession) -> Iterator[None]:
    """Of a repeated key in JSON the last value counts in the columns made here. The setting is
    read when a column is added to a table; the session's own comes back afterwards."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def classify_responses(responses: DataFrame) -> DataFrame:
    """Every attempt with its reply, outcome and message in place of the body."""
    with_reply = responses.withColumn("reply", r.reply_text(F.col("body")))
    return with_reply.withColumns(
        {
            "outcome": r.call_outcome(F.col("status"), F.col("reply")),
            "message": r.call_message(F.col("status"), F.col("reply"), F.col("body")),
        }
    ).drop("body")


def resolve_attempts(attempts: DataFrame, *by: str) -> DataFrame:
    """One row per file: its successful attempt, else the last one.

    Most files are tried once. Only the keys and numbers of attempts are grouped; the files
    with several are listed with the attempt that counts, and every attempt is judged against
    that list where it is. Replies stay where they are as long as the list is small enough to
    be sent around, which its written size tells; a longer list is met by key. `attempts` are
    written once, as they are read several times, by columns. Of two attempts of one number the
    one with the larger values counts."""
    by = by or ("source_file",)
    attempts = stage(attempts, "attempts")
    rank = F.struct(F.coalesce(F.col("outcome") == r.DONE, F.lit(False)).alias("done"), F.col("seq").alias("seq"))
    ranked = attempts.select(*by, rank.alias("_rank"))
    several = stage(
        ranked.groupBy(*by).agg(F.max("_rank").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"),
        "several",
    ).withColumnsRenamed({k: f"_{k}" for k in by})
    same_file = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    counts = F.col("_best").isNull() | F.col("_rank").eqNullSafe(F.col("_best"))
    best = attempts.withColumn("_rank", rank).join(several, same_file, "left").where(counts).select(attempts.columns)
    # Two attempts of one number leave two rows.
    tied = ranked.join(several, same_file & F.col("_rank").eqNullSafe(F.col("_best"))).groupBy(*by).count().where("count > 1")
    if tied.isEmpty():
        return best
    listed = stage(tied.select(*by, F.lit(True).alias("_tied")), "tied").withColumnsRenamed({k: f"_{k}" for k in by})
    split = best.join(listed, same_file, "left")
    rest = [c for c in attempts.columns if c not in by]
    one = split.where("_tied").groupBy(*by).agg(F.max(F.struct(*rest)).alias("best")).select(*by, "best.*")
    return split.where("_tied is null").select(*by, *rest).unionByName(one)


def failure_scope(resolved: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Add `scope` to the files of runs: a failure before the first success of its run is
    systemic, any later one concerns its file only. A file without status was never sent
    because it could not be rendered, and is not systemic."""
    firsts = resolved.groupBy("run_id").agg(
        F.min(F.when(F.col("outcome") == r.DONE, F.col("seq"))).alias("_first_done"),
        F.count(F.lit(1)).alias("_size"),
    )
    joined = join_salted(resolved, firsts.drop("_size"), "run_id", "source_file", least_rows=least_rows)
    early = F.col("_first_done").isNull() | (F.col("seq") < F.col("_first_done"))
    return joined.withColumn(
        "scope",
        F.when(F.col("outcome") == r.DONE, F.lit(None).cast("string"))
        .when(F.col("status").isNotNull() & early, F.lit(SYSTEMIC))
        .otherwise(F.lit(SINGLE)),
    ).drop("_first_done")


def stop_if_systemic(scoped: DataFrame) -> None:
    """Raise on the first systemic failure, so that no result of the run is stored."""
    first = scoped.where(F.col("scope") == SYSTEMIC).orderBy("seq").select("source_file", _detail()).head()
    if first is not None:
        raise SystemicFailure(f"the request failed on {first[0]} before any success: {first[1]}")


def receipts_from_responses(scoped: DataFrame, engine: str = "ai_vision") -> DataFrame:
    """Normalised receipts of resolved files; a failed file keeps its row and says why."""
    done = F.col("outcome") == r.DONE
    why = F.when(F.col("status").isNull(), F.lit(NOT_RENDERED)).otherwise(
        F.concat(F.lit(FILE_FAILED), _detail())
    )
    # A file without success has no reply, so reading it leaves all fields empty.
    replies = scoped.withColumn("reply", F.when(done, F.col("reply")))
    read = _read_replies(replies, engine).withColumns(
        {
            "warnings": F.when(done, F.col("warnings")).otherwise(F.array(why)),
            "extraction_failed": ~done,
        }
    )
    return normalize(as_receipts(read))


def _detail():
    return F.when(
        F.col("status") != 0, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(": "), F.col("message"))
    ).otherwise(F.col("message"))
