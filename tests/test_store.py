"""Publishing runs: whole or not at all, whoever is cut off and wherever."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tillroll.operators import extract, review
from tillroll.options import Options
from tillroll.plans.batch import process_batch
from tillroll.sources.commits import SNAPSHOT, CommitLog, Files
from tillroll.sources.shared import shared_dir, stage, staging
from tillroll.sources.store import ReviewStore, Run

CAFE = "Corner Cafe\n2026-01-05\nTea  5.50\nTOTAL  5.50\n"
TECH = "TechMart\n2026-01-06\nCable  9.00\nTOTAL  9.00\n"


def names(store, table="receipts"):
    return sorted((r.run_id, r.source_file) for r in store.read(table).collect())


class Cut(Exception):
    pass


STEPS = ["create", "stream", "rename", "after"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("at", [0, 1])
def test_a_cut_neither_blocks_nor_shows_half(spark, texts, tmp_path, monkeypatch, step, at):
    """A writer stops in the claim (0) or in the entry that publishes (1), before the file is
    created, after it was created empty, before and after its renaming."""
    store = ReviewStore(spark, str(tmp_path / "t"), owner="nightly")
    process_batch(texts({"old": TECH}), store, 8)
    publish, rename, calls = Files.publish, Files._rename, []

    def cut_publish(self, name, text):
        calls.append(name)
        if len(calls) == at + 1:
            if step == "create":
                raise Cut
            if step == "stream":
                self._system.create(self._path(f".{name}.cut"), False).close()
                raise Cut
        return publish(self, name, text)

    def cut_rename(self, aside, name):
        if len(calls) == at + 1 and step == "rename":
            raise Cut
        done = rename(self, aside, name)
        if len(calls) == at + 1 and step == "after":
            raise Cut
        return done

    monkeypatch.setattr(Files, "publish", cut_publish)
    monkeypatch.setattr(Files, "_rename", cut_rename)
    with pytest.raises(Cut):
        process_batch(texts({"new": CAFE, "new2": CAFE}), store, 9)
    monkeypatch.undo()
    published = at == 1 and step == "after"
    again = ReviewStore(spark, str(tmp_path / "t"), owner="nightly")
    whole = [(8, "old"), (9, "new"), (9, "new2")]
    assert names(again) == (whole if published else [(8, "old")])
    assert names(again, "flagged") == ([(9, "new2")] if published else [])
    assert again.read("runs").count() == (2 if published else 1)
    # The same caller goes on, another one is told whose run it is if the claim is there.
    if at == 1 or step == "after":
        with pytest.raises(ValueError, match="belongs to"):
            process_batch(texts({"x": CAFE}), ReviewStore(spark, str(tmp_path / "t")), 9)
    process_batch(texts({"new": CAFE, "new2": CAFE}), again, 9)
    assert names(again) == whole
    assert again.run_of("stream", 0) == 10 and again.run_of("stream", 0) == 10
    assert again.vacuum() == (4 if at == 1 else 0)
    assert names(again) == whole


def test_manual_callers_cannot_replace_each_other(spark, texts, tmp_path):
    one, other = (ReviewStore(spark, str(tmp_path)) for _ in range(2))
    process_batch(texts({"a": CAFE}), one, 1)
    with pytest.raises(ValueError, match="belongs to"):
        process_batch(texts({"b": TECH}), other, 1)
    process_batch(texts({"a2": CAFE}), one, 1)
    assert names(other) == [(1, "a2")]


def test_a_failing_batch_keeps_the_run_before_it(spark, texts, tmp_path):
    store = ReviewStore(spark, str(tmp_path))
    process_batch(texts({"a": CAFE}), store, 1)
    bad = texts({"b": CAFE}).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        process_batch(bad, store, 1)
    assert names(store) == [(1, "a")]


def test_many_runs_lie_in_few_folders(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path), owner="me", fan=3)
    rows = spark.createDataFrame([("t", 1)], "text string, flagged_count bigint")
    for run_id in range(30):
        store.write_run("alerts", rows.withColumn("text", F.lit(f"run {run_id}")), run_id)
        store.write_run("cache", cache_row(spark, f"h{run_id}"), run_id)
    # A merged run is repeated, one is emptied; both stay right through further merges.
    store.write_run("alerts", rows.withColumn("text", F.lit("again")), 4)
    store.write_run("alerts", rows.limit(0), 5)
    for run_id in range(30, 37):
        store.write_run("alerts", rows.withColumn("text", F.lit(f"run {run_id}")), run_id)
    got = {r.run_id: r.text for r in store.read("alerts").collect()}
    want = {i: f"run {i}" for i in range(37) if i != 5} | {4: "again"}
    assert got == want and store.read("alerts").count() == len(want)
    assert len(store._items("alerts")) <= 9 and len(store._items("cache")) <= 9
    assert [r.text for r in store.read_run("alerts", 4).collect()] == ["again"]
    assert store.read_run("alerts", 5).count() == 0
    assert sorted(r.content_hash for r in store.read("cache").collect()) == sorted(f"h{i}" for i in range(30))
    assert store.vacuum() > 20 and store.read("alerts").count() == len(want)


def cache_row(spark, content_hash):
    row = spark.createDataFrame([(content_hash,)], "content_hash string")
    more = {"source_file": "string", "vendor": "string", "date": "string", "currency": "string", "total": "double", "tax": "double", "engine": "string"}
    return row.withColumns({k: F.lit(None).cast(v) for k, v in more.items()}).withColumns(
        {"line_items": F.lit(None).cast("array<struct<description: string, amount: double>>"), "warnings": F.lit(None).cast("array<string>")}
    )


def test_a_lookup_opens_the_buckets_of_its_keys(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path))
    keys = spark.range(3000).select(F.format_string("k%d", "id").alias("key"), F.lit("f").alias("source_file"), F.lit(True).alias("main"))
    store.write_run("key_index", keys, 1)
    asked = spark.createDataFrame([("k5",), ("k5",), ("k77",), (None,), ("never",)], "k string")
    found = store.lookup("key_index", F.col("k"), asked)
    assert {r.key for r in found.collect()} >= {"k5", "k77"}
    assert found.count() < 200
    opened = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(opened) <= 3
    assert store.lookup("key_index", F.col("k"), asked, before=1).count() == 0
    assert store.lookup("key_index", F.col("k"), asked.where("false")).count() == 0


def test_writers_of_one_number_decide_anew(spark, tmp_path):
    def add(state, entry):
        return {"seen": state["seen"] + [entry["who"]]}

    logs = [CommitLog(Files(spark, str(tmp_path)), {"seen": []}, add) for _ in range(2)]
    asked = []

    def first(state):
        asked.append(len(state["seen"]))
        if len(asked) == 1:
            logs[1].commit(lambda _: {"who": "fast"})
        return {"who": "slow"}

    assert logs[0].commit(first) == {"seen": ["fast", "slow"]} and asked == [0, 1]
    assert logs[1].commit(lambda state: None) == {"seen": ["fast", "slow"]}


def test_snapshots_stand_for_old_entries(spark, tmp_path):
    log = CommitLog(Files(spark, str(tmp_path)), {"n": 0}, lambda state, entry: {"n": state["n"] + entry["by"]})
    for _ in range(3 * SNAPSHOT + 5):
        log.commit(lambda state: {"by": 1})
    kept = [n for n in log.files.names() if n.endswith(".entry")]
    assert log.read() == (3 * SNAPSHOT + 4, {"n": 3 * SNAPSHOT + 5})
    assert len(kept) <= 2 * SNAPSHOT and len([n for n in log.files.names() if n.endswith(".snapshot")]) == 2
    for name in kept[-3:-2]:
        log.files.delete(name)
    with pytest.raises(ValueError, match="missing"):
        log.read()


def test_a_file_is_published_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.publish("a", "x") and not files.publish("a", "y") and files.read("a") == "x"
    files._system.create(files._path("aside"), False).close()
    assert not files._rename("aside", "a") and files.read("a") == "x"
    with pytest.raises(Py4JJavaError):
        files._rename("never there", "b")


def test_staged_tables_go_with_their_block(spark):
    def left(name):
        return [n for n in Files(spark, shared_dir(spark)).names("tillroll") if n.startswith(name)]

    with pytest.raises(Cut), staging(spark):
        stage(spark.range(3), "inner")
        with staging(spark):
            stage(spark.range(3), "nested")
        assert len(left("inner")) == 1 and not left("nested")
        raise Cut
    assert not left("inner")


def test_a_run_leaves_no_stage(spark, texts, tmp_path):
    before = Files(spark, shared_dir(spark)).names("tillroll")
    store = ReviewStore(spark, str(tmp_path))
    process_batch(texts({"a": CAFE, "b": CAFE}), store, 1, across_runs=True)
    process_batch(texts({"c": CAFE}), store, 2, Options(deduplicate=False))
    assert Files(spark, shared_dir(spark)).names("tillroll") == before


def test_summary_is_counted_on_the_way(spark, texts, tmp_path):
    run = Run(ReviewStore(spark, str(tmp_path)), 1)
    rows = review.flag_for_review(extract.read_receipts(texts({"a": CAFE, "b": "", "c": "x"})))
    assert run.write("receipts", rows, **review.summary_metrics()) == {"files_processed": 3, "flagged_count": 2, "duplicate_count": 0}
    assert run.write("receipts", rows.where("false"), **review.summary_metrics())["files_processed"] == 0
