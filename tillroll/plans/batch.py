"""One run: files in; receipts, review rows, summary and alert out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.replies import NO_RESPONSE
from tillroll.operators import duplicates, reuse, review
from tillroll.operators.duplicates import row_keys
from tillroll.operators.extract import preview
from tillroll.operators.uploads import latest_upload, not_outdated
from tillroll.options import Options
from tillroll.plans.engines import build_engine
from tillroll.sources.shared import stage, staging
from tillroll.sources.store import MANUAL, ReviewStore, Run

# Engines whose results are paid for, and so kept by content hash.
CACHED_ENGINES = ("ai_vision",)


def extract_batch(arrived: DataFrame, options: Options = Options(), limit: int | None = None) -> DataFrame:
    """Extract and mark one batch. Marking writes what was extracted and works on that."""
    if limit is not None:
        arrived = preview(arrived, limit)
    receipts = build_engine(options)(arrived, options)
    if not options.deduplicate:
        return receipts
    # Rules give equal fields for equal bytes where the hash is that of the text itself; a hash
    # that arrives with the text, and replies, leave both keys to be tried.
    if options.engine == "rule_based" and "content_hash" not in arrived.columns:
        return duplicates.mark_duplicates(receipts)
    return duplicates.mark_duplicates_any(receipts)


def process_batch(
    arrived: DataFrame,
    store: ReviewStore,
    run_id: int,
    options: Options = Options(),
    started_at: datetime | None = None,
    across_runs: bool = False,
    origin: str = MANUAL,
    last_uploads: bool = False,
) -> DataFrame:
    """Run a batch and store it under `run_id`; returns its row of `runs`.

    The run's tables are published together at its end. Repeating a run id replaces the run of
    the same origin; a run id of another origin is refused.
    If `arrived` tells when files came (`arrived_at`, `seq`), the last upload of a name counts;
    with `last_uploads`, uploads that earlier runs have seen a later one of are passed over, and
    `store.read_current` gives the rows of the last upload of every name.
    The vision engine reads logged responses; bytes with a stored result reuse it.
    With `across_runs`, documents of earlier runs are known too (rule extraction only)."""
    if across_runs and options.engine != "rule_based":
        raise ValueError("across_runs knows the keys of rule extraction only")
    with staging(store.spark), store.run(run_id, origin) as run:
        if {"arrived_at", "seq"} <= set(arrived.columns) and "body" not in arrived.columns:
            arrived = latest_upload(arrived)
            if last_uploads:
                with staging(store.spark):
                    latest = stage(arrived, "uploads")
                    before = store.lookup("uploads", F.col("source_file"), latest, before=run_id)
                    arrived = stage(not_outdated(latest, before), "uploads", outlives=True)
                run.write("uploads", arrived.select("source_file", "arrived_at", "seq"))
            arrived = arrived.drop("arrived_at", "seq")
        if options.engine in CACHED_ENGINES:
            files = arrived.groupBy("source_file").agg(F.max("content_hash").alias("content_hash"))
            marked = _from_responses(files, arrived.where("seq is not null"), run, options)
        elif across_runs and options.deduplicate:
            receipts = build_engine(options)(arrived, options)
            with staging(store.spark):
                receipts = stage(receipts, "receipts")
                earlier = store.lookup("key_index", F.explode(F.array(*row_keys().values())), receipts, before=run_id)
                marked = stage(duplicates.across_runs(receipts, earlier, staged=True), "marked", outlives=True)
            run.write("key_index", duplicates.new_keys(marked))
        else:
            marked = extract_batch(arrived, options)
        _write_review(marked, run, options, started_at)
    return store.read_run("runs", run_id)


def process_responses(
    files: DataFrame,
    responses: DataFrame,
    store: ReviewStore,
    run_id: int,
    options: Options = Options(engine="ai_vision"),
    started_at: datetime | None = None,
    origin: str = MANUAL,
) -> DataFrame:
    """A run over logged model responses: files (source_file, content_hash) whose bytes have a
    stored result reuse it, the others take theirs from the log, and successes are stored.

    Within the run, too, a file reuses the result of an earlier file with the same bytes."""
    with staging(store.spark), store.run(run_id, origin) as run:
        _write_review(_from_responses(files, responses, run, options), run, options, started_at)
    return store.read_run("runs", run_id)


def _from_responses(files: DataFrame, responses: DataFrame, run: Run, options: Options) -> DataFrame:
    """Marked receipts of the files, and the results the run adds to the cache. Only the cache's
    buckets that the files' hashes fall into are read, of earlier runs."""
    files = stage(files.select("source_file", "content_hash"), "files")
    cache = run.store.lookup("cache", F.col("content_hash"), files, before=run.run_id)
    known = stage(reuse.reuse_cached(files, cache), "known")
    open_files = files.join(known.select("source_file"), "source_file", "left_anti")
    logged = open_files.join(responses.select("source_file", "seq", "status", "body"), "source_file", "left")
    own = stage(build_engine(options)(_unanswered(logged), options), "own")
    stored = stage(reuse.cache_updates(own, run.run_id), "stored")
    repeated = reuse.reuse_cached(own, stored).join(
        stored.select("content_hash", F.col("source_file").alias("first_file")), "content_hash"
    ).where("source_file > first_file").drop("first_file")
    repeated = stage(repeated, "repeated")
    first = own.join(repeated.select("source_file"), "source_file", "left_anti")
    receipts = known.unionByName(first).unionByName(repeated)
    run.write("cache", stored.drop("run_id"))
    return duplicates.mark_duplicates_any(receipts) if options.deduplicate else receipts


def _unanswered(logged: DataFrame) -> DataFrame:
    """A file without any logged response counts as one without an answer."""
    no_answer = F.to_json(F.struct(F.lit(NO_RESPONSE).alias("error")))
    missing = F.col("seq").isNull()
    return logged.withColumns(
        {
            "status": F.when(missing, F.lit(0)).otherwise(F.col("status")),
            "body": F.when(missing, no_answer).otherwise(F.col("body")),
            "seq": F.coalesce("seq", F.lit(9223372036854775807)),
        }
    )


def _write_review(marked: DataFrame, run: Run, options: Options, started_at: datetime | None) -> None:
    """Write receipts, review rows, summary and alert. The summary is counted while the receipts
    are written; no other pass over them is needed for it."""
    started = F.lit(started_at or datetime.now(timezone.utc)).cast("timestamp")
    counts = run.write("receipts", review.flag_for_review(marked), **review.summary_metrics())
    run.write("flagged", review.flagged_items(run.read("receipts"), started))
    one = run.store.spark.range(1).select(
        started.alias("started_at"),
        *[F.lit(counts[name]).cast("bigint").alias(name) for name in review.summary_metrics()],
        F.lit(options.engine).alias("engine"),
    )
    run.write("runs", one)
    run.write("alerts", review.alerts(run.read("runs")))
