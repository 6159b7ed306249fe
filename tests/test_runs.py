"""Runs, stored tables, review and reports, as a caller uses them."""

import json
import random
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators import duplicates, extract, report, reuse, review, uploads
from tillroll.options import Options
from tillroll.operators.extract import read_receipts
from tillroll.plans.engines import register_engine
from tillroll.plans.batch import extract_batch, process_batch, process_responses
from tillroll.sources import files
from tillroll.sources.shared import shared_dir, stage
from tillroll.sources.store import ReviewStore, write_report


def receipt(vendor, date, total):
    return f"{vendor}\nDate: {date}\nItem A  5.00\nItem B  3.00\nTOTAL  {total}\n"


CAFE, TECH = receipt("Corner Cafe", "2026-01-05", "12.50"), receipt("TechMart", "2026-01-06", "45.00")


@pytest.fixture
def store(spark, tmp_path):
    return ReviewStore(spark, str(tmp_path / "tables"))


def test_clean_batch(texts, store):
    run = process_batch(texts({"r1": CAFE, "r2": TECH}), store, 1, started_at=datetime(2026, 1, 7)).head()
    assert (run.files_processed, run.flagged_count, run.duplicate_count) == (2, 0, 0)
    assert (run.run_id, run.engine, run.started_at) == (1, "rule_based", datetime(2026, 1, 7))
    rows = {r.source_file: r for r in store.read("receipts").collect()}
    assert (rows["r1"].vendor, rows["r1"].date, rows["r1"].total) == ("Corner Cafe", "2026-01-05", 12.5)
    assert store.read("flagged").count() == 0 and store.read("alerts").count() == 0


def test_copies_are_flagged(texts, store):
    run = process_batch(texts({"r1": CAFE, "r1_copy": CAFE}), store, 1).head()
    assert (run.flagged_count, run.duplicate_count) == (1, 1)
    (item,) = store.read("flagged").collect()
    assert (item.source_file, item.reason) == ("r1_copy", "duplicate_of: r1")
    assert store.read("alerts").head().text.startswith("1 receipt(s) need review — run #1.")


def test_unreadable_file_is_flagged(texts, store):
    run = process_batch(texts({"bad": None}), store, 1).head()
    assert (run.files_processed, run.flagged_count) == (1, 1)
    assert store.read("flagged").head().reason == "no_data_extracted: could not read any text"


def test_repeating_a_run_replaces_it(texts, store):
    process_batch(texts({"r1": CAFE, "r2": CAFE}), store, 1)
    process_batch(texts({"r3": TECH}), store, 2)
    process_batch(texts({"r1": CAFE}), store, 1)
    assert sorted((r.run_id, r.source_file) for r in store.read("receipts").collect()) == [(1, "r1"), (2, "r3")]
    assert store.read("flagged").count() == 0 and store.read("runs").count() == 2


def test_later_runs_know_earlier_ones(texts, store):
    process_batch(texts({"r1": CAFE, "r2": TECH}), store, 1, across_runs=True)
    run = process_batch(texts({"r8": CAFE, "r9": CAFE + " "}), store, 2, across_runs=True).head()
    assert run.duplicate_count == 2
    reasons = {r.source_file: r.reason for r in store.read("flagged").collect()}
    assert reasons == {"r8": "duplicate_of: r1", "r9": "duplicate_of: r1"}
    assert store.read("seen_keys").count() == 2


def test_options_reach_the_batch(texts):
    df = texts({"a": CAFE, "b": CAFE})
    assert extract_batch(df, Options(deduplicate=False)).where("duplicate_of is not null").count() == 0
    assert [r.source_file for r in extract_batch(df, limit=1).collect()] == ["a"]
    with pytest.raises(ValueError):
        extract.preview(df, -1)


def test_runs_are_listed_newest_first(spark, texts, store):
    for run_id in (1, 2, 3):
        process_batch(texts({"r": CAFE}), store, run_id)
    assert [r.run_id for r in review.recent_runs(store.read("runs"), 2).collect()] == [3, 2]


def test_review_flow(spark, texts, store):
    process_batch(texts({"a": CAFE, "b": CAFE, "c": ""}), store, 1)
    flagged, log = store.read("flagged"), store.read("review_log")
    queue = review.review_queue(flagged, log).collect()
    assert [(r.source_file, r.reviewed) for r in queue] == [("c", False), ("b", False)]
    ids = spark.createDataFrame([(queue[0].item_id,), (queue[0].item_id,), ("42-x",)], "item_id string")
    for _ in range(2):
        known, unknown = review.apply_reviews(flagged, ids, F.current_timestamp())
        assert known.count() == 1 and [r.item_id for r in unknown.collect()] == ["42-x"]
        store.append_reviews(known)
    log = store.read("review_log")
    assert [r.source_file for r in review.review_queue(flagged, log, only_unreviewed=True).collect()] == ["b"]
    assert [r.reviewed for r in review.review_queue(flagged, log).collect()] == [True, False]
    found = {r.item_id: r.source_file for r in review.flagged_by_id(flagged, log, ids).collect()}
    assert found == {queue[0].item_id: "c", "42-x": None}
    stats = review.review_stats(store.read("runs"), flagged, log).head()
    assert (stats.files_processed, stats.flagged_items, stats.awaiting_review) == (3, 2, 1)
    assert stats.last_run == store.read("runs").head().started_at


def test_stats_of_nothing(store):
    stats = review.review_stats(store.read("runs"), store.read("flagged"), store.read("review_log")).head()
    assert tuple(stats) == (0, 0, 0, None)


REASONS = [
    ((True, None, None, ["w1", "w2"]), "extraction_failed: w1; w2"),
    ((True, None, None, []), "extraction_failed: extraction_failed"),
    ((True, "a", 5.0, ["w"]), "extraction_failed: w"),
    ((False, "a", None, ["w"]), "duplicate_of: a"),
    ((False, None, None, []), "no_data_extracted: no total extracted"),
    ((False, None, None, ["w"]), "no_data_extracted: w"),
    ((False, None, 0.0, ["w"]), None),
]


def test_reasons(spark):
    df = spark.createDataFrame(
        [(i, *row) for i, (row, _) in enumerate(REASONS)],
        "i int, extraction_failed boolean, duplicate_of string, total double, warnings array<string>",
    )
    got = [r.reason for r in review.flag_for_review(df).orderBy("i").collect()]
    assert got == [reason for _, reason in REASONS]


def test_report(spark, texts, tmp_path):
    marked = extract_batch(texts({"a": CAFE, "b": 'Joe "The" Shop, Inc\n2026-01-05\nTOTAL 12345678.90', "c": ""}))
    rows = {r["Source File"]: tuple(r) for r in report.report_rows(marked).collect()}
    assert rows["a"] == (
        "a", "Corner Cafe", "2026-01-05", "", "12.5", "", "Item A (5.0); Item B (3.0)", "", "rule_based", "read via text",
    )
    assert rows["c"][1:8] == ("",) * 7
    for kind in ("csv", "parquet"):
        folder = write_report(marked, str(tmp_path / "out" / kind), kind)
        reader = spark.read.option("header", True).option("escape", '"') if kind == "csv" else spark.read
        back = {r["Source File"]: tuple(v or "" for v in r) for r in reader.format(kind).load(folder).collect()}
        assert back == rows
    with pytest.raises(ValueError, match="unknown output_format"):
        write_report(marked, str(tmp_path / "x"), "xlsx")


def test_folders(spark, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "deeper").mkdir(parents=True)
    (inbox / "deeper" / "no.txt").write_text("x")
    for name, content in {
        "b.txt": CAFE.encode(), "a.TXT": b"\xff\xfe", "c d.PDF": b"%PDF", "e.docx": b"x", "f.Jpeg": b"x", "plain": b"x",
    }.items():
        (inbox / name).write_bytes(content)
    found = [(r.source_file, r.file_kind) for r in files.discover_files(spark, str(inbox)).collect()]
    assert found == [("a.TXT", "text"), ("b.txt", "text"), ("c d.PDF", "pdf"), ("f.Jpeg", "image")]
    rows = {r.source_file: r for r in extract.read_receipts(files.read_texts(spark, str(inbox))).collect()}
    assert rows["b.txt"].total == 12.5
    assert rows["a.TXT"].warnings == [files.NOT_TEXT]
    assert rows["c d.PDF"].warnings == ["could not read any text"]
    for bad in (inbox / "missing", inbox / "b.txt"):
        with pytest.raises(files.InputError):
            files.discover_files(spark, str(bad))


def test_names(spark):
    names = ["/a/.pdf", "/a/b.pdf", "/a.b/c", "/a/x.tar.HEIC", "/a/b.pdf.", "b.webp"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kinds = {r.path: r.k for r in df.select("path", uploads.file_kind(F.col("path")).alias("k")).collect()}
    assert kinds == {"/a/.pdf": None, "/a/b.pdf": "pdf", "/a.b/c": None, "/a/x.tar.HEIC": "image", "/a/b.pdf.": None, "b.webp": "image"}


def test_last_upload_of_a_name_holds(spark):
    df = spark.createDataFrame(
        [("a", "2026-01-01", 1, "old"), ("a", "2026-01-02", 2, "x"), ("a", "2026-01-02", 3, "new"), ("b", "2026-01-01", 4, "b")],
        "source_file string, arrived_at string, seq bigint, text string",
    ).withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))
    assert {r.source_file: r.text for r in uploads.latest_upload(df).collect()} == {"a": "new", "b": "b"}


def test_choice_of_text(spark):
    df = spark.createDataFrame(
        [("a", " " * 30 + "x" * 20 + "\n", "ocr"), ("b", "x" * 19, "ocr"), ("c", None, "ocr")],
        "source_file string, direct_text string, ocr_text string",
    )
    got = {r.source_file: (r.text, r.method) for r in extract.choose_text(df).collect()}
    assert got == {"a": ("x" * 20, "pdf_text"), "b": ("ocr", "pdf_ocr"), "c": ("ocr", "pdf_ocr")}


def test_items_in_long_form(texts):
    rows = extract.explode_items(extract.read_receipts(texts({"a": CAFE, "b": ""}))).collect()
    assert sorted((r.source_file, r.item_no or 0, r.description, r.amount) for r in rows) == [
        ("a", 1, "Item A", 5.0), ("a", 2, "Item B", 3.0), ("b", 0, None, None),
    ]


def test_stored_json(spark, texts):
    receipts = extract.read_receipts(texts({"a": CAFE, "b": ""}))
    stored = reuse.to_json(receipts)
    assert '"vendor":null' in stored.where("json like '%\"b\"%'").head().json
    broken = spark.createDataFrame([("h1", "{oops"), ("h2", None), ("h3", "[]")], "content_hash string, json string")
    back = {r.source_file: r for r in reuse.from_json(stored.unionByName(broken)).collect()}
    want = {r.source_file: r for r in receipts.collect()}
    assert set(back) == {"a", "b"}
    for name, row in back.items():
        for column in reuse.STORED:
            assert row[column] == want[name][column]


def body(**fields):
    text = json.dumps(fields)
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def test_runs_over_responses_reuse_what_is_stored(spark, store):
    files_ = lambda rows: spark.createDataFrame(rows, "source_file string, content_hash string")
    log = lambda rows: spark.createDataFrame(rows, "source_file string, seq bigint, status int, body string")
    first = process_responses(
        files_([("a", "h1"), ("b", "h2"), ("c", "h1"), ("d", "h3"), ("e", "h4")]),
        log([("a", 1, 200, body(vendor="V", total=5)), ("b", 2, 500, "{}"), ("d", 3, 200, "{}")]),
        store, 1,
    ).head()
    assert (first.files_processed, first.flagged_count, first.duplicate_count) == (5, 4, 1)
    reasons = {r.source_file: r.reason for r in store.read("flagged").collect()}
    assert reasons["b"] == "extraction_failed: AI vision failed for this file — HTTP 500: no error detail returned"
    assert reasons["c"] == "duplicate_of: a"
    assert reasons["e"] == "extraction_failed: AI vision failed for this file — no response"
    assert [(r.content_hash, r.source_file) for r in store.read("cache").collect()] == [("h1", "a")]

    process_responses(
        files_([("x", "h1"), ("y", "h2")]), log([("y", 1, 200, body(vendor="W", total=6))]), store, 2
    )
    rows = {r.source_file: r for r in store.read_run("receipts", 2).collect()}
    assert (rows["x"].vendor, rows["x"].total, rows["x"].warnings) == ("V", 5.0, [reuse.FROM_CACHE])
    assert (rows["y"].vendor, rows["y"].warnings) == ("W", [])
    assert sorted(r.content_hash for r in store.read("cache").collect()) == ["h1", "h2"]
    left = reuse.pending_files(files_([("m", "h1"), ("o", "h9"), ("n", "h9")]), store.read("cache"))
    assert [tuple(r) for r in left.collect()] == [("n", "h9")]


def test_a_cluster_must_name_its_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_runs_of_other_origins_are_kept(spark, texts, tmp_path):
    store = ReviewStore(spark, str(tmp_path))
    process_batch(texts({"r1": CAFE}), store, 0)
    for origin in ("stream a", "stream b"):
        run_id = store.run_of(origin, 0)
        for _ in range(2):  # a retried batch replaces itself
            assert store.run_of(origin, 0) == run_id
            process_batch(texts({origin: TECH}), store, run_id, origin=f"{origin}#0")
    assert {(r.source_file, r.run_id) for r in store.read("receipts").collect()} == {
        ("r1", 0), ("stream a", 1), ("stream b", 2),
    }
    with pytest.raises(ValueError, match="belongs to"):
        process_batch(texts({"r2": CAFE}), store, 1)


def test_across_runs_obeys_and_refuses(spark, texts, tmp_path):
    store = ReviewStore(spark, str(tmp_path))
    process_batch(texts({"r1": CAFE}), store, 1, across_runs=True)
    process_batch(texts({"r1": CAFE, "r0": CAFE}), store, 2, across_runs=True)
    process_batch(texts({"r5": TECH, "r1": CAFE}), store, 1, across_runs=True)
    run = process_batch(texts({"r9": CAFE}), store, 3, across_runs=True).head()
    assert (run.files_processed, run.duplicate_count) == (1, 1)
    run = process_batch(texts({"s1": CAFE}), store, 4, Options(deduplicate=False), across_runs=True).head()
    assert run.duplicate_count == 0
    with pytest.raises(ValueError, match="across_runs"):
        process_batch(texts({"s2": CAFE}), store, 5, Options(engine="ai"), across_runs=True)


def test_equal_hash_of_unequal_texts(spark, tmp_path):
    rows = [("a", "h1", CAFE), ("b", "h1", ""), ("c", "h2", CAFE)]
    arrived = spark.createDataFrame(rows, "source_file string, content_hash string, text string")
    got = {r.source_file: r.duplicate_of for r in extract_batch(arrived).collect()}
    assert got == {"a": None, "b": "a", "c": "a"}


def test_engine_of_the_callers_own(spark, texts, tmp_path):
    register_engine("shouting", lambda arrived, options: read_receipts(arrived.withColumn("text", F.upper("text")), options))
    got = extract_batch(texts({"r1": CAFE}), Options(engine="shouting")).head()
    assert got.vendor == got.vendor.upper()


def test_first_files_by_name(spark):
    """The n first of any rows, ties exact, found without sorting them."""
    rng = random.Random(4)
    for names in ([f"f{i:04d}" for i in range(700)], ["hot"] * 300 + [f"{c}{i}" for c in "az" for i in range(50)], ["x"], []):
        rng.shuffle(names)
        df = spark.createDataFrame([(n, "t") for n in names] + [(None, "no file")], "source_file string, text string").repartition(3)
        for n in (0, 1, 7, len(names) - 3, len(names), len(names) + 5):
            if n >= 0:
                assert sorted(r.source_file for r in extract.preview(df, n).collect()) == sorted(names)[:n]
    plan = extract.preview(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_uploads_over_several_runs(spark, store):
    def uploads(rows):
        df = spark.createDataFrame(rows, "source_file string, arrived_at string, seq long, text string")
        return df.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))

    process_batch(uploads([("a", "2026-01-02", 1, CAFE), ("a", "2026-01-03", 2, TECH), ("b", "2026-01-02", 1, CAFE)]), store, 1, last_uploads=True)
    process_batch(uploads([("a", "2026-01-03", 1, CAFE), ("b", "2026-01-02", 2, TECH), ("c", "2026-01-01", 1, CAFE)]), store, 2, last_uploads=True)
    assert sorted((r.run_id, r.source_file) for r in store.read("receipts").collect()) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]
    current = {r.source_file: (r.run_id, r.vendor) for r in store.read_current("receipts").collect()}
    assert current == {"a": (1, "TechMart"), "b": (2, "TechMart"), "c": (2, "Corner Cafe")}
    # Repeating a run looks at the runs before it only.
    process_batch(uploads([("a", "2026-01-01", 1, CAFE)]), store, 1, last_uploads=True)
    assert sorted((r.run_id, r.source_file) for r in store.read_current("receipts").collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_known_bytes_are_marked_however_they_were_read(spark, store):
    def arrived(rows):
        return spark.createDataFrame(rows, "source_file string, content_hash string, text string")

    process_batch(arrived([("a.txt", "h1", CAFE), ("n.txt", "h9", "")]), store, 1, across_runs=True)
    process_batch(arrived([("b.txt", "h1", ""), ("m.txt", "h9", "")]), store, 2, across_runs=True)
    day_first = receipt("Shop", "03/04/2026", "9.00")
    process_batch(arrived([("c.txt", "h3", day_first)]), store, 3, across_runs=True)
    process_batch(arrived([("d.txt", "h3", day_first), ("e.txt", "h1", TECH), ("f.txt", "h5", TECH)]), store, 4, Options(date_dayfirst=True), across_runs=True)
    found = {r.source_file: r.duplicate_of for r in store.read("receipts").collect()}
    assert found == {"a.txt": None, "n.txt": None, "b.txt": "a.txt", "m.txt": "n.txt", "c.txt": None, "d.txt": "c.txt", "e.txt": "a.txt", "f.txt": None}


def test_vision_runs_use_the_cache(spark, store):
    def responses(rows):
        return spark.createDataFrame(rows, schemas.RESPONSES)

    vision = Options(engine="ai_vision")
    process_batch(responses([("a", "h1", 1, 200, body(vendor="V", total=5)), ("b", "h2", 2, 500, "{}")]), store, 1, vision)
    run = process_batch(responses([("x", "h1", None, None, None), ("y", "h2", 4, 200, body(vendor="W", total=6))]), store, 2, vision).head()
    assert (run.files_processed, run.flagged_count) == (2, 0)
    rows = {r.source_file: (r.vendor, r.warnings) for r in store.read_run("receipts", 2).collect()}
    assert rows == {"x": ("V", [reuse.FROM_CACHE]), "y": ("W", [])}
    process_batch(responses([("z", "h1", 1, 200, body(vendor="Z", total=5))]), store, 3, Options(engine="ai"))
    assert store.read_run("receipts", 3).head().vendor == "Z" and store.read("cache").count() == 2


def test_stored_json_is_parsed_once(spark):
    """Not for the filter and once more for what passes it."""
    good = '{"source_file": "a", "total": 1.5, "line_items": [], "warnings": ["w"]}'
    stored = stage(spark.createDataFrame([("h1", good), ("h2", "{broken"), ("h3", None)], "content_hash string, json string"), "json")
    parsed = reuse.from_json(stored)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.content_hash, r.source_file, r.total, r.warnings) for r in parsed.collect()] == [("h1", "a", 1.5, ["w"])]


def test_uploads_are_not_kept_twice(spark, tmp_path, monkeypatch):
    """While receipts are written, one table of uploads is left, and at the end none."""
    folder, seen = Path(shared_dir(spark).removeprefix("file:")) / "tillroll", []
    uploads_of = lambda: {p.name for p in folder.glob("uploads-*")}
    before = uploads_of()

    def staged(df, name, *args, **kwargs):
        seen.append(len(uploads_of() - before))
        return stage(df, name, *args, **kwargs)

    monkeypatch.setattr(duplicates, "stage", staged)
    at = datetime(2026, 1, 5)
    rows = [("a.txt", "Shop\nTOTAL  $1.00", at, 1), ("a.txt", "Shop\nTOTAL  $2.00", at, 2), ("b.txt", "Cafe\nTOTAL  $3.00", at, 1)]
    arrived = spark.createDataFrame(rows, "source_file string, text string, arrived_at timestamp, seq bigint")
    store = ReviewStore(spark, str(tmp_path / "s"))
    process_batch(arrived, store, 1, last_uploads=True)
    assert {r.source_file: r.total for r in store.read("receipts").collect()} == {"a.txt": 2.0, "b.txt": 3.0}
    assert set(seen) == {1} and uploads_of() == before


def test_shuffles_of_a_staged_table_are_given_back(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in files.mkString("\n").split("\n") if "/shuffle_" in name}

    before = kept()
    staged = stage(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while kept() - before and time.time() < until:
        time.sleep(0.1)
    assert not kept() - before
    assert staged.count() == 7
