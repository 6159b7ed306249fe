"""Engines by name. An engine is a function (DataFrame, Options) -> DataFrame of the receipts
schema; callers may add their own with `register_engine`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.extract import read_receipts
from tillroll.operators.replies import (
    classify_responses,
    failure_scope,
    receipts_from_responses,
    resolve_attempts,
    stop_if_systemic,
)
from tillroll.options import OWN_ENGINES, Options
from tillroll.sources.shared import stage

Engine = Callable[[DataFrame, Options], DataFrame]


def model_replies(responses: DataFrame, options: Options) -> DataFrame:
    """Logged responses of one run (source_file, content_hash, seq, status, body) -> receipts.
    Stops with SystemicFailure where a call of the run itself would have."""
    attempts = classify_responses(responses).withColumn("run_id", F.lit(0).cast("bigint"))
    scoped = stage(failure_scope(resolve_attempts(attempts, "run_id", "source_file")), "scoped")
    stop_if_systemic(scoped)
    return receipts_from_responses(scoped, options.engine)


ENGINES: dict[str, Engine] = {
    "rule_based": read_receipts,
    "ai": model_replies,
    "ai_vision": model_replies,
}


def register_engine(name: str, engine: Engine) -> None:
    """Add an engine of the caller's own, or replace one; options accept its name from then on."""
    ENGINES[name] = engine
    if name not in OWN_ENGINES:
        OWN_ENGINES.append(name)


def build_engine(options: Options) -> Engine:
    if options.engine not in ENGINES:
        raise ValueError(f"unknown engine: {options.engine}")
    return ENGINES[options.engine]
