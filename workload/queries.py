"""One query per operator; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dates, fields, money
from tillroll.functions import replies as reply_functions
from tillroll.functions.text import clean_text, unify
from tillroll.operators import duplicates, extract, replies, report, reuse, review, uploads
from tillroll.operators.normalize import TAX_OVER_TOTAL, normalize
from tillroll.options import Options
from tillroll.plans.batch import extract_batch, process_batch
from tillroll.sources.commits import Files
from tillroll.sources.shared import shared_dir, shuffles_given_back, stage
from tillroll.sources.store import ReviewStore, Run
from tillroll.streaming.watch import watch
from workload import inputs
from workload.receipts import receipt_texts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(name: str) -> Column:
    return F.array_join(name, "; ").alias(name)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_batch(receipt_texts(spark, sf_dir))


# --- sources, scans, sinks


@query
def discover_files(spark, sf_dir):
    endings = F.array(*map(F.lit, (".pdf", ".PNG", ".txt", ".docx", ".Jpeg", "", ".tar.heic")))
    ending = F.get(endings, (F.col("doc_id") % 7).cast("int"))
    path = F.concat(F.lit("file:/inbox/d"), F.col("doc_id").cast("string"), ending)
    listing = table(spark, sf_dir, "documents").select(path.alias("path"))
    return uploads.supported_files(listing).select("source_file", "file_kind")


@query
def content_hash(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select("source_file", F.md5("text").alias("content_hash"))


@query
def latest_upload(spark, sf_dir):
    arrived = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".png")).alias("source_file"),
        F.col("ts").alias("arrived_at"), F.col("event_id").alias("seq"), "value",
    )
    return uploads.latest_upload(arrived)


@query
def choose_text(spark, sf_dir):
    candidates = inputs.documents(spark, sf_dir).select(
        "source_file",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit("\n")))
        .otherwise(F.concat(F.lit("\n\t"), "text", F.lit("  ")))
        .alias("direct_text"),
        F.col("text").alias("ocr_text"),
    )
    return extract.choose_text(candidates).select(
        "source_file", "method", F.md5("text").alias("text_hash")
    )


@query
def unreadable_rows(spark, sf_dir):
    rows = inputs.receipts(spark, sf_dir)
    unreadable = F.array_contains("warnings", extract.UNREADABLE)
    return rows.select(
        "source_file", unreadable.alias("unreadable"), "extraction_failed",
        F.col("total").isNull().alias("no_total"), F.size("line_items").cast("bigint").alias("items"),
    )


@query
def preview(spark, sf_dir):
    first = extract.preview(receipt_texts(spark, sf_dir), 100)
    return extract.read_receipts(first).select("source_file", "vendor", "total")


@query
def report_rows(spark, sf_dir):
    return report.report_rows(_marked(spark, sf_dir))


# --- extraction


@query
def receipt_lines(spark, sf_dir):
    return extract.receipt_lines(receipt_texts(spark, sf_dir))


@query
def document_lines(spark, sf_dir):
    """Lines of free text, as one count and one hash per document with any line."""
    lines = extract.receipt_lines(inputs.documents(spark, sf_dir))
    return lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line").cast("bigint")).alias("chars")
    )


@query
def currency(spark, sf_dir):
    texts = receipt_texts(spark, sf_dir)
    return texts.select("source_file", money.currency(F.col("text"), Options()).alias("currency"))


@query
def amounts(spark, sf_dir):
    return extract.text_amounts(receipt_texts(spark, sf_dir))


@query
def document_amounts(spark, sf_dir):
    return extract.text_amounts(inputs.documents(spark, sf_dir))


@query
def document_amounts_split(spark, sf_dir):
    return extract.text_amounts(
        inputs.documents(spark, sf_dir), Options(amount_grammar="split")
    )


def _from_lines(spark, sf_dir, **columns):
    texts = receipt_texts(spark, sf_dir)
    cut = texts.withColumn("lines", fields.cut_text(unify(F.col("text")), Options()))
    priced = cut.withColumn("priced", fields.money_lines(F.col("lines"), Options()))
    return priced.select("source_file", *[c.alias(name) for name, c in columns.items()])


@query
def total(spark, sf_dir):
    return _from_lines(spark, sf_dir, total=fields.labelled_total(F.col("priced")))


@query
def tax(spark, sf_dir):
    return _from_lines(spark, sf_dir, tax=fields.labelled_tax(F.col("priced")))


@query
def vendor(spark, sf_dir):
    return _from_lines(spark, sf_dir, vendor=fields.vendor(F.col("lines")))


@query
def total_fallback(spark, sf_dir):
    fell_back = F.array_contains("warnings", fields.FALLBACK_TOTAL).alias("fell_back")
    return inputs.receipts(spark, sf_dir).select("source_file", "total", fell_back)


@query
def date(spark, sf_dir):
    texts = receipt_texts(spark, sf_dir)
    found = texts.select("source_file", dates.find_date(unify(F.col("text")), Options()).alias("date"))
    return found.withColumn("date_typed", F.try_to_date("date"))


@query
def date_dayfirst(spark, sf_dir):
    found = dates.find_date(unify(F.col("text")), Options(date_dayfirst=True))
    return receipt_texts(spark, sf_dir).select("source_file", found.alias("date"))


@query
def line_items(spark, sf_dir):
    return extract.explode_items(inputs.receipts(spark, sf_dir))


@query
def missing_fields(spark, sf_dir):
    missing = fields.missing_fields(F.col("vendor"), F.col("date"), F.col("total"))
    rows = inputs.receipts(spark, sf_dir)
    return rows.select("source_file", F.array_join(missing, "; ").alias("missing"))


@query
def receipts(spark, sf_dir):
    return inputs.receipts(spark, sf_dir).select(
        "source_file", "vendor", "date", "total", "tax", "currency",
        F.size("line_items").cast("bigint").alias("items"), "engine", _joined("warnings"),
        "content_hash", "extraction_failed",
    )


@query
def warnings(spark, sf_dir):
    return _marked(spark, sf_dir).select("source_file", F.posexplode("warnings").alias("pos", "warning")).select(
        "source_file", (F.col("pos") + 1).cast("bigint").alias("warning_no"), "warning"
    )


@query
def document_receipts(spark, sf_dir):
    """Every field from free text, which is no receipt: labels and money turn up anywhere."""
    return extract.read_receipts(inputs.documents(spark, sf_dir)).select(
        "source_file", F.md5("vendor").alias("vendor_hash"), "currency", "total", "tax",
        F.size("line_items").cast("bigint").alias("items"),
        F.array_contains("warnings", fields.FALLBACK_TOTAL).alias("fell_back"),
    )


# --- normalising


@query
def clean_text_values(spark, sf_dir):
    cleaned = clean_text(F.col("text"))
    return inputs.documents(spark, sf_dir).select("source_file", F.md5(cleaned).alias("cleaned_hash"))


@query
def tax_over_total(spark, sf_dir):
    rows = inputs.receipts(spark, sf_dir)
    return rows.where(F.array_contains("warnings", TAX_OVER_TOTAL)).select("source_file", "total", "tax")


@query
def normalized(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rough = orders.select(
        F.col("o_orderkey").cast("string").alias("source_file"),
        F.concat(F.lit(" \t"), "o_orderpriority", F.lit("  \n x ")).alias("vendor"),
        (F.col("o_totalprice") + 0.001).alias("total"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 0.004)
        .when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1.25)
        .alias("tax"),
        F.array(
            F.struct(
                F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("  y"))).alias("description"),
                (F.col("o_totalprice") / 4).cast("decimal(20,3)").cast("double").alias("amount"),
            )
        ).alias("line_items"),
        F.array(F.lit("w")).alias("warnings"),
    )
    return normalize(rough).select(
        "source_file", "vendor", "total", "tax", _joined("warnings"),
        F.col("line_items")[0]["description"].alias("description"),
    )


# --- logged model responses


def _attempts(spark, sf_dir):
    return replies.classify_responses(inputs.responses(spark, sf_dir))


@query
def reply_text(spark, sf_dir):
    text = reply_functions.reply_text(F.col("body"))
    return inputs.responses(spark, sf_dir).select("source_file", "seq", F.md5(text).alias("reply_hash"))


@query
def provider_error(spark, sf_dir):
    error = reply_functions.error_text(F.col("body"))
    return inputs.responses(spark, sf_dir).select("source_file", "seq", error.alias("error"))


@query
def call_outcome(spark, sf_dir):
    return _attempts(spark, sf_dir).select("source_file", "seq", "outcome", "message")


@query
def resolve_attempts(spark, sf_dir):
    return replies.resolve_attempts(_attempts(spark, sf_dir)).select(
        "source_file", "seq", "status", "outcome"
    )


def _scoped(spark, sf_dir):
    resolved = replies.resolve_attempts(_attempts(spark, sf_dir), "run_id", "source_file")
    return replies.failure_scope(resolved)


@query
def failure_scope(spark, sf_dir):
    return _scoped(spark, sf_dir).select("run_id", "source_file", "outcome", "scope")


@query
def reply_receipts(spark, sf_dir):
    """Receipts and review reasons of all runs' responses, failed ones included."""
    rows = replies.receipts_from_responses(_scoped(spark, sf_dir))
    return review.flag_for_review(rows).select(
        "source_file", "vendor", "total", "extraction_failed", "reason"
    )


@query
def parse_replies(spark, sf_dir):
    """Replies as models write them, and as many with numbers that JSON does not have."""
    written = inputs.replies(spark, sf_dir).select("source_file", "reply")
    rows = replies.parse_replies(written.unionByName(inputs.bare_replies(spark, sf_dir)))
    item = F.get("line_items", F.lit(0))
    return rows.select(
        "source_file", "vendor", "date", "currency", "total", "tax",
        F.size("line_items").cast("bigint").alias("items"),
        item["description"].alias("description"), item["amount"].alias("amount"),
        _joined("warnings"), "extraction_failed",
    )


@query
def clean_number(spark, sf_dir):
    price = F.col("o_totalprice")
    forms = F.array(
        F.concat(F.lit("$"), F.format_number(price, 2)),
        F.concat(F.lit(" ₱ £"), F.format_number(price, 1), F.lit(" ")),
        F.concat(F.lit("USD "), F.format_number(price, 2)),
        F.lit(""),
        F.lit("true"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("e2")),
        F.lit("5d"),
        F.concat(F.lit("-1_0"), (F.col("o_orderkey") % 10).cast("string")),
    )
    text = F.get(forms, (F.col("o_orderkey") % 8).cast("int"))
    number = reply_functions.clean_number(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"))


# --- duplicates


@query
def duplicates_by_hash(spark, sf_dir):
    files = inputs.documents(spark, sf_dir).select("source_file", F.md5("text").alias("content_hash"))
    return duplicates.duplicates_by_hash(files)


@query
def fingerprint(spark, sf_dir):
    found = duplicates.fingerprint(F.col("vendor"), F.col("date"), F.col("total"))
    return inputs.receipts(spark, sf_dir).select("source_file", found.alias("fingerprint"))


@query
def mark_duplicates(spark, sf_dir):
    return _marked(spark, sf_dir).select("source_file", "duplicate_of", _joined("warnings"))


@query
def mark_duplicates_any(spark, sf_dir):
    rows = inputs.mixed_keys(spark, sf_dir)
    return duplicates.mark_duplicates_any(rows).select("source_file", "duplicate_of", _joined("warnings"))


@query
def duplicates_across_runs(spark, sf_dir):
    """Base files make up the first run, copies and re-scans the second. In the third the first
    run's bytes come again, read with days first, and in the fourth with nothing readable."""
    rows = stage(inputs.receipts(spark, sf_dir), "receipts")
    is_late = F.contains("source_file", F.lit("_copy")) | F.contains("source_file", F.lit("_scan"))
    base = rows.where(~is_late)
    nothing = spark.createDataFrame([], "key string, source_file string, run_id bigint")
    first = stage(duplicates.across_runs(base, nothing, staged=True), "first")
    seen = stage(duplicates.new_keys(first).withColumn("run_id", F.lit(1).cast("bigint")), "seen")
    # The first run once more, as when it was repeated: every key is stored twice.
    seen = seen.unionByName(seen.withColumn("run_id", F.col("run_id") + 1))
    second = duplicates.across_runs(rows.where(is_late), seen, staged=True)
    days_first = inputs.receipts(spark, sf_dir, Options(date_dayfirst=True)).where(~is_late)
    again = F.regexp_replace("source_file", "[.]txt$", "_again.txt")
    third = duplicates.across_runs(days_first.withColumn("source_file", again), seen)
    none = {"vendor": F.lit(None).cast("string"), "date": F.lit(None).cast("string"), "total": F.lit(None).cast("double")}
    blank = base.withColumns({"source_file": F.regexp_replace("source_file", "[.]txt$", "_blank.txt"), **none})
    fourth = duplicates.across_runs(blank, seen, staged=True)
    runs = [r.select(F.lit(i).cast("bigint").alias("run_id"), "source_file", "duplicate_of") for i, r in enumerate((first, second, third, fourth), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])


# --- reuse of earlier results


def _files(spark, sf_dir):
    return receipt_texts(spark, sf_dir).select("source_file", F.md5("text").alias("content_hash"))


def _cache(spark, sf_dir):
    """Two runs have stored base files; the later one holds a part of them again."""
    stored = inputs.receipts(spark, sf_dir).where(
        F.endswith("source_file", F.lit(".txt")) & ~F.contains("source_file", F.lit("_copy")) & ~F.contains("source_file", F.lit("_scan"))
    )
    stored = stored.where(inputs.base_key() % 3 != 0)
    early = reuse.cache_updates(stored, 1).withColumn("currency", F.lit("old"))
    late = reuse.cache_updates(stored.where(inputs.base_key() % 3 == 1), 2)
    return early.unionByName(late)


@query
def reuse_cached(spark, sf_dir):
    known = reuse.reuse_cached(_files(spark, sf_dir), _cache(spark, sf_dir))
    return known.select("source_file", "vendor", "total", "currency", F.col("warnings")[0].alias("warning"))


@query
def rerun_responses(spark, sf_dir):
    """Two runs of logged responses. The second brings the same bytes under other names; of those
    that failed, some are answered now, some fail again and some have no response at all."""
    store = ReviewStore(spark, f"{_new_root(spark)}/tables")
    logged = stage(inputs.served_responses(spark, sf_dir), "logged")
    vision = Options(engine="ai_vision", deduplicate=False)
    process_batch(logged, store, 1, vision)
    second = logged.withColumn("source_file", F.regexp_replace("source_file", "^r_", "s_"))
    denied, k = F.col("k") % 23 == 0, F.col("k")
    empty = ~denied & (k % 19 != 0) & (k % 29 == 0)
    answer = '{"candidates": [{"content": {"parts": [{"text": "{\\"vendor\\": \\"late\\"}"}]}}]}'
    answered = second.where(empty).withColumns({"seq": F.lit(0).cast("bigint"), "status": F.lit(200), "body": F.lit(answer)})
    refused = second.where(denied).withColumns({"status": F.lit(503), "body": F.lit("no json")})
    nothing = {"seq": F.lit(None).cast("bigint"), "status": F.lit(None).cast("int"), "body": F.lit(None).cast("string")}
    silent = second.where(~denied & ~empty).dropDuplicates(["source_file"]).withColumns(nothing)
    process_batch(answered.unionByName(refused).unionByName(silent).drop("k"), store, 2, vision)
    return store.read("receipts").select(
        "run_id", "source_file", "vendor", "total", "extraction_failed", _joined("warnings")
    )


@query
def pending_files(spark, sf_dir):
    return reuse.pending_files(_files(spark, sf_dir), _cache(spark, sf_dir)).select("source_file")


@query
def cache_updates(spark, sf_dir):
    rows = inputs.receipts(spark, sf_dir).withColumn("extraction_failed", inputs.base_key() % 5 == 0)
    return reuse.cache_updates(rows, 3).select("source_file", "vendor", "total", "run_id")


@query
def json_round_trip(spark, sf_dir):
    stored = reuse.to_json(inputs.receipts(spark, sf_dir))
    return reuse.from_json(stored).select(
        "source_file", "vendor", "date", "currency", "total", "tax",
        F.size("line_items").cast("bigint").alias("items"), _joined("warnings"),
    )


# --- review


@query
def review_flags(spark, sf_dir):
    return review.flag_for_review(_marked(spark, sf_dir)).select("source_file", "reason")


@query
def run_summary(spark, sf_dir):
    return review.run_summary(review.flag_for_review(_marked(spark, sf_dir)))


@query
def run_summary_by_tick(spark, sf_dir):
    return review.run_summary(inputs.event_receipts(spark, sf_dir), "run_id")


@query
def flagged_items(spark, sf_dir):
    rows = review.flag_for_review(_marked(spark, sf_dir)).withColumn("run_id", F.lit(inputs.RUN_ID).cast("bigint"))
    return review.flagged_items(rows, F.lit(inputs.CREATED_AT)).drop("item_id")


@query
def recent_runs(spark, sf_dir):
    return review.recent_runs(inputs.event_runs(spark, sf_dir))


@query
def review_queue(spark, sf_dir):
    queue = review.review_queue(inputs.event_flagged(spark, sf_dir), inputs.review_log(spark, sf_dir))
    return queue.drop("item_id")


@query
def unreviewed_queue(spark, sf_dir):
    queue = review.review_queue(
        inputs.event_flagged(spark, sf_dir), inputs.review_log(spark, sf_dir), only_unreviewed=True
    )
    return queue.drop("item_id")


@query
def flagged_by_id(spark, sf_dir):
    ids = inputs.event_receipts(spark, sf_dir).select(
        review.item_id(F.col("run_id"), F.col("source_file")).alias("item_id")
    )
    found = review.flagged_by_id(
        inputs.event_flagged(spark, sf_dir), inputs.review_log(spark, sf_dir), ids
    )
    return found.select("source_file", "vendor", "total", "reason", "reviewed")


@query
def apply_reviews(spark, sf_dir):
    asked = inputs.event_reviews(spark, sf_dir)
    known, unknown = review.apply_reviews(
        inputs.event_flagged(spark, sf_dir), asked, F.lit(inputs.CREATED_AT)
    )
    answers = known.select("item_id", F.lit(True).alias("known")).unionByName(
        unknown.select("item_id", F.lit(False).alias("known"))
    )
    names = asked.select("item_id", "source_file").distinct()
    return answers.join(names, "item_id").select("source_file", "known")


@query
def review_stats(spark, sf_dir):
    return review.review_stats(
        inputs.event_runs(spark, sf_dir), inputs.event_flagged(spark, sf_dir), inputs.review_log(spark, sf_dir)
    )


@query
def alerts(spark, sf_dir):
    return review.alerts(inputs.event_runs(spark, sf_dir))


@query
def run_with_repeated_names(spark, sf_dir):
    """A run in which every third name comes twice: only the last upload of it counts."""
    store = ReviewStore(spark, f"{_new_root(spark)}/tables")
    texts = receipt_texts(spark, sf_dir).withColumns({"seq": inputs.base_key(), "arrived_at": F.lit(inputs.CREATED_AT).cast("timestamp")})
    early = texts.where(inputs.base_key() % 3 == 0).withColumns(
        {"text": F.lit("unfinished"), "arrived_at": F.col("arrived_at") - F.expr("interval 1 minute")}
    )
    process_batch(texts.unionByName(early), store, 3)
    return store.read("receipts").select("run_id", "source_file", "vendor", "total", "duplicate_of")


@query
def stream_last_uploads(spark, sf_dir):
    """Two triggers. In the first every third name comes twice; in the second half of the base
    files come again, and a fifth of all names with an upload that is older than the first."""
    root, texts = _new_root(spark), receipt_texts(spark, sf_dir)
    store, at = ReviewStore(spark, f"{root}/tables"), F.lit(inputs.CREATED_AT).cast("timestamp")
    first = stage(texts.withColumns({"arrived_at": at, "seq": inputs.base_key()}), "first")

    def upload(of, text, minutes):
        later = F.col("arrived_at") + F.make_dt_interval(mins=F.lit(minutes))
        return first.where(of).withColumns({"text": F.lit(text), "arrived_at": later})

    is_base = ~F.contains("source_file", F.lit("_copy")) & ~F.contains("source_file", F.lit("_scan"))
    triggers = (
        first.unionByName(upload(inputs.base_key() % 3 == 0, "unfinished", -1)),
        upload(is_base & (inputs.base_key() % 2 == 0), "Replaced Shop\nTOTAL  $9.99", 1).unionByName(
            upload(inputs.base_key() % 5 == 1, "too late", -2)
        ),
    )
    for arriving in triggers:
        _arrive(arriving, f"{root}/inbox")
        stream = spark.readStream.schema(first.schema).parquet(f"{root}/inbox")
        watch(stream, store, f"{root}/log", once=True, last_uploads=True).awaitTermination()
    return store.read_current("receipts").select("run_id", "source_file", "vendor", "total")


@query
def stored_runs(spark, sf_dir):
    """A caller, two streams that use the same store, and writers that are cut off: one after
    its claim, one with tables written but not published, one within the log's own entry. The
    caller repeats its run with half of its files; the folders are merged on the way."""
    root, texts = _new_root(spark), receipt_texts(spark, sf_dir)
    landed = stage(texts.withColumn("wave", inputs.base_key() % 3), "waves")
    waves = [landed.where(F.col("wave") == w).drop("wave") for w in range(3)]
    store = ReviewStore(spark, f"{root}/tables", owner="caller", fan=2)
    process_batch(waves[0], store, 5)
    other = ReviewStore(spark, f"{root}/tables", owner="cut off", fan=2)
    other.claim(6)
    half = Run(other, 6)
    half.write("receipts", review.flag_for_review(extract.read_receipts(waves[1])))
    files = Files(spark, f"{root}/tables/_log")
    stray = files._system.create(files._path(".00000000000000000003.entry.cut"), False)
    stray.close()
    for name, wave in (("a", waves[1]), ("b", waves[2])):
        _arrive(wave, f"{root}/{name}")
        _watch_once(spark, f"{root}/{name}", store, f"{root}/{name}_", texts.schema)
    process_batch(waves[0].where(inputs.base_key() % 2 == 0), store, 5)
    return store.read("receipts").select("run_id", "source_file", "duplicate_of", "reason")


# --- streams


def _arrive(texts: DataFrame, folder: str) -> None:
    with shuffles_given_back(texts.sparkSession):
        texts.write.mode("append").option("compression", "zstd").parquet(folder)


def _watch_once(spark: SparkSession, inbox: str, store: ReviewStore, root: str, schema) -> None:
    arriving = spark.readStream.schema(schema).parquet(inbox)
    watch(arriving, store, f"{root}/log", once=True).awaitTermination()


def _new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tillroll/stream-{uuid.uuid4().hex}"


@query
def stream_receipts(spark, sf_dir):
    """All texts arrive at once: one run."""
    root, texts = _new_root(spark), receipt_texts(spark, sf_dir)
    store = ReviewStore(spark, f"{root}/tables")
    _arrive(texts, f"{root}/inbox")
    _watch_once(spark, f"{root}/inbox", store, root, texts.schema)
    return store.read("receipts").select(
        "run_id", "source_file", "vendor", "date", "total", "duplicate_of", "reason"
    )


@query
def stream_alerts(spark, sf_dir):
    """Texts arrive in three waves, each a run that sees its new files only."""
    root, texts = _new_root(spark), receipt_texts(spark, sf_dir)
    store = ReviewStore(spark, f"{root}/tables")
    landed = stage(texts.withColumn("wave", inputs.base_key() % 3), "waves")
    for wave in range(3):
        _arrive(landed.where(F.col("wave") == wave).drop("wave"), f"{root}/inbox")
        _watch_once(spark, f"{root}/inbox", store, root, texts.schema)
    return store.read("alerts")
