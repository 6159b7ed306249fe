"""A watched folder gives what a batch over the same files gives."""

from tillroll.plans.batch import process_batch
from tillroll.sources import files
from tillroll.sources.store import ReviewStore
from tillroll.streaming.watch import watch

SHOP = "Corner Cafe\n2026-01-05\nTea  {n}.50\nTOTAL  {n}.50\n"


def drop(folder, name, n):
    (folder / name).write_text(SHOP.format(n=n))


def look(spark, inbox, store, checkpoint, **options):
    stream = files.stream_texts(spark, str(inbox), options.pop("max_files", None))
    watch(stream, store, str(checkpoint), once=True, **options).awaitTermination()


def rows(store):
    return sorted((r.source_file, r.vendor, r.total, r.reason) for r in store.read("receipts").collect())


def test_stream_sees_each_file_once(spark, tmp_path):
    inbox, store = tmp_path / "inbox", ReviewStore(spark, str(tmp_path / "tables"))
    inbox.mkdir()
    for n in (1, 2):
        drop(inbox, f"r{n}.txt", n)
    drop(inbox, "r2_copy.txt", 2)
    (inbox / "note.docx").write_text("not a receipt")
    look(spark, inbox, store, tmp_path / "log")
    batch = ReviewStore(spark, str(tmp_path / "batch"))
    process_batch(files.read_texts(spark, str(inbox)), batch, 0)
    assert rows(store) == rows(batch) and len(rows(store)) == 3
    (alert,) = store.read("alerts").collect()
    assert (alert.run_id, alert.flagged_count) == (0, 1)

    drop(inbox, "r3.txt", 3)
    look(spark, inbox, store, tmp_path / "log")
    runs = {r.run_id: r.files_processed for r in store.read("runs").collect()}
    assert runs == {0: 3, 1: 1}
    look(spark, inbox, store, tmp_path / "log")
    assert store.read("runs").count() == 2


def test_triggers_of_one_file_each(spark, tmp_path):
    inbox, store = tmp_path / "inbox", ReviewStore(spark, str(tmp_path / "tables"))
    inbox.mkdir()
    for n in (1, 2, 3):
        drop(inbox, f"r{n}.txt", n)
    look(spark, inbox, store, tmp_path / "log", max_files=1)
    assert {r.run_id: r.files_processed for r in store.read("runs").collect()} == {0: 1, 1: 1, 2: 1}
    assert len(rows(store)) == 3


def test_stream_knows_earlier_runs(spark, tmp_path):
    inbox, store = tmp_path / "inbox", ReviewStore(spark, str(tmp_path / "tables"))
    inbox.mkdir()
    drop(inbox, "r1.txt", 1)
    look(spark, inbox, store, tmp_path / "log", across_runs=True)
    drop(inbox, "r1_again.txt", 1)
    look(spark, inbox, store, tmp_path / "log", across_runs=True)
    assert {r.source_file: r.duplicate_of for r in store.read("receipts").collect()} == {
        "r1.txt": None, "r1_again.txt": "r1.txt",
    }
