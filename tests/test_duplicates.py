"""Marking, against a plain model on random batches and on the written examples."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillroll.operators import duplicates
from tillroll.operators.settling import blocked_rows, key_members
from tillroll.operators.skew import join_salted
from tillroll.sources.shared import stage

SCHEMA = (
    "batch int, source_file string, content_hash string, vendor string, date string, "
    "total double, warnings array<string>, duplicate_of string"
)


def model(rows):
    """One pass in file order with a dictionary per kind of key."""
    by_hash, by_print, found = {}, {}, {}
    for name, content_hash, vendor, date, total in sorted(rows):
        key = None
        if vendor and date and total is not None:
            key = (vendor.strip().lower(), date, round(total, 2))
        first = by_hash.get(content_hash) or by_print.get(key)
        found[name] = first
        if first is None:
            if content_hash:
                by_hash[content_hash] = name
            if key:
                by_print[key] = name
    return found


def frame(spark, rows):
    return stage(spark.createDataFrame([(0, *r, ["w"], None) for r in rows], SCHEMA).drop("batch"), "rows")


EXAMPLES = [
    ("a", "h1", "Cafe", "2026-01-05", 12.5),
    ("b", "h1", "Cafe", "2026-01-05", 12.5),
    ("c", "h2", " CAFE ", "2026-01-05", 12.5),
    ("d", "h3", "Cafe", None, 12.5),
    ("e", "h4", "Cafe", None, 12.5),
    ("f", "h5", None, None, None),
    ("g", "h5", None, None, None),
    ("p", "h6", "F", "1", 1.0),
    ("q", "h6", "F", "2", 1.0),
    ("r", "h7", "F", "2", 1.0),
    ("s", None, "", "2", 0.0),
    ("t", "", "Z", "2", -0.0),
    ("u", "h8", "z", "2", 0.0),
]


@pytest.mark.parametrize("least_rows", [1_000, 1])
def test_examples(spark, least_rows):
    got = duplicates.mark_duplicates_any(frame(spark, EXAMPLES), least_rows).collect()
    assert {r.source_file: r.duplicate_of for r in got} == {
        "a": None, "b": "a", "c": "a", "d": None, "e": None, "f": None, "g": "f",
        "p": None, "q": "p", "r": None, "s": None, "t": None, "u": "t",
    } == model(EXAMPLES)
    assert {r.source_file: r.warnings for r in got}["b"] == ["w", "duplicate of a"]
    assert {r.source_file: r.warnings for r in got}["a"] == ["w"]


def random_batch(rng, size, consistent):
    names = rng.sample(range(1000), size)
    rows = []
    fields = {}
    for n in names:
        h = rng.choice(["h1", "h1", "h2", "h3", "h4", None])
        f = rng.choice([("v", "d", 1.0), ("V ", "d", 1.001), ("v", "d", 2.0), ("w", "d", 1.0), (None, "d", 1.0)])
        if consistent and h:
            f = fields.setdefault(h, f)
        rows.append((f"n{n:04d}", h, *f))
    return rows


@pytest.mark.parametrize("least_rows", [1_000, 1])
def test_one_key_per_row(spark, least_rows):
    """Many batches at once: the batch number is worked into the keys."""
    rng, rows, want = random.Random(1), [], {}
    for batch in range(300):
        for name, h, vendor, date, total in random_batch(rng, rng.randrange(1, 14), True):
            rows.append((f"{batch:03d}{name}", h and f"{batch}{h}", vendor and f"{vendor.strip()}{batch}", date, total))
    want = model(rows)
    got = duplicates.mark_duplicates(frame(spark, rows), least_rows).collect()
    assert {r.source_file: r.duplicate_of for r in got} == want


@pytest.mark.parametrize("least_rows", [1_000, 1])
def test_any_keys(spark, least_rows):
    rng, rows = random.Random(2), []
    for batch in range(300):
        for name, h, vendor, date, total in random_batch(rng, rng.randrange(1, 14), False):
            rows.append((f"{batch:03d}{name}", h and f"{batch}{h}", vendor and f"{vendor.strip()}{batch}", date, total))
    got = duplicates.mark_duplicates_any(frame(spark, rows), least_rows).collect()
    assert {r.source_file: r.duplicate_of for r in got} == model(rows)


def test_long_chain_takes_as_many_rounds_as_it_needs(spark):
    """Each row shares its hash with the row before and its fields with the row after."""
    rows = [(f"n{i:03d}", f"h{(i + 1) // 2}", f"v{i // 2}", "d", 1.0) for i in range(14)]
    got = duplicates.mark_duplicates_any(frame(spark, rows)).collect()
    assert {r.source_file: r.duplicate_of for r in got} == model(rows)


def chain(n):
    return [(f"n{i:06d}", f"h{(i + 1) // 2}", f"v{i // 2}", "d", 1.0) for i in range(n)]


@pytest.mark.parametrize(("n", "most"), [(24, 6), (10_000, 15)])
def test_rounds_grow_with_the_logarithm_of_a_chain(spark, n, most):
    rows = chain(n)
    numbered = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "row long, h string, f string")
    blocked, rounds = blocked_rows(numbered)
    want = {i for i, r in enumerate(rows) if model(rows)[r[0]]} if n < 100 else set(range(1, n, 2))
    assert {r.row for r in blocked.collect()} == want
    assert rounds <= most


def test_settling_against_one_pass(spark):
    """Dense, hot and sparse graphs of keys, each against a pass in order."""
    rng = random.Random(8)
    rows = []
    for batch in range(60):
        hashes, prints = rng.choice([2, 5, 40]), rng.choice([1, 3, 30])
        for _ in range(rng.randrange(1, 60)):
            h = rng.choice([None, *range(hashes)])
            f = rng.choice([None, *range(prints)])
            rows.append((f"n{len(rows):05d}", None if h is None else f"h{batch}-{h}", None if f is None else f"{batch}-{f}", "d", 1.0))
    # Interleave the batches: order and keys have nothing to do with each other.
    names = [r[0] for r in rows]
    rng.shuffle(names)
    rows = [(name, *r[1:]) for name, r in zip(names, rows, strict=True)]
    got = duplicates.mark_duplicates_any(frame(spark, rows), least_rows=1).collect()
    assert {r.source_file: r.duplicate_of for r in got} == model(rows)


def test_nothing_to_mark(spark):
    assert duplicates.mark_duplicates_any(frame(spark, [("a", None, None, None, None)])).head().duplicate_of is None
    empty = frame(spark, EXAMPLES).where("false")
    assert duplicates.mark_duplicates_any(empty).count() == 0


def test_hot_groups_lose_no_rows(spark):
    """A third of the rows in one group, fifty other groups above their share; no task of the
    join holds more than its part of the hot rows."""
    rows = spark.range(3000).select(
        F.format_string("n%05d", "id").alias("source_file"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("key"),
    )
    facts = rows.where("key is not null").groupBy("key").agg(
        F.min("source_file").alias("first"), F.count(F.lit(1)).alias("size")
    )
    facts = facts.drop("size")
    got = join_salted(rows, facts, "key", "source_file", least_rows=5)
    plain = rows.join(facts, "key", "left").select(got.columns)
    assert got.count() == 3000
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_across_runs(spark):
    rows = frame(spark, EXAMPLES[:7])
    seen = spark.createDataFrame([], "key string, source_file string, run_id bigint")
    first = stage(duplicates.across_runs(rows.where("source_file in ('a', 'f')"), seen), "first")
    earlier = duplicates.new_keys(first).withColumn("run_id", F.lit(1))
    # The same keys again, as a repeated run and a backfill leave them.
    later = earlier.withColumns({"run_id": F.lit(2), "source_file": F.concat(F.lit("0"), "source_file")})
    earlier = earlier.unionByName(later)
    second = duplicates.across_runs(rows.where("source_file not in ('a', 'f')"), earlier)
    assert second.count() == rows.count() - 2
    assert {r.source_file: r.duplicate_of for r in second.collect()} == {
        "b": "a", "c": "a", "d": None, "e": None, "g": "f",
    }
    assert duplicates.new_keys(second).count() == 2


def disk(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_settling_leaves_only_what_its_result_reads(spark):
    """Of the staged tables the rows and what their pairs are told are left; all others are gone."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "tillroll"
    rows = frame(spark, chain(200))
    before = set(folder.iterdir())
    got = duplicates.mark_duplicates_any(rows)
    left = {p.name.rsplit("-", 1)[0]: disk(p) for p in set(folder.iterdir()) - before}
    assert set(left) == {"keyed", "told"}
    assert got.count() == 200


def test_hot_keys_of_many_pairs(spark):
    """One hash with many fields and one fingerprint with many hashes, above their share."""
    rows = [(f"n{i:04d}", "hot" if i % 3 else f"h{i}", "v" if i % 3 == 0 or i % 7 == 0 else f"v{i % 40}", "d", 1.0) for i in range(150)]
    got = duplicates.mark_duplicates_any(frame(spark, rows), least_rows=20).collect()
    assert {r.source_file: r.duplicate_of for r in got} == model(rows)


def test_members_of_keys(spark):
    """Window and sorting name the same row before and the same first row."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b", f"x{i}"]), rng.choice([None, "p", f"y{i // 2}"])) for i in rng.sample(range(500), 500)]
    want = set()
    for side, at in enumerate((1, 2)):
        groups = {}
        for r in sorted(rows):
            if r[at] is not None:
                groups.setdefault(r[at], []).append(r[0])
        for g in (g for g in groups.values() if len(g) > 1):
            want |= {(row, side, before, g[0]) for row, before in zip(g, [None, *g])}
    table = stage(spark.createDataFrame(rows, "row long, h string, f string"), "rows")
    for least_rows in (1, 1_000):
        assert {tuple(r) for r in key_members(table, least_rows=least_rows).collect()} == want


def test_across_runs_writes_a_written_table_not_again(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "tillroll"
    rows = frame(spark, EXAMPLES)
    seen = spark.createDataFrame([("hh5", "0", 1), ("hh5", "00", 0)], "key string, source_file string, run_id bigint")
    before = set(folder.iterdir())
    got = duplicates.across_runs(rows, seen, staged=True)
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"told"}
    want = duplicates.across_runs(rows, seen)
    assert {tuple(r[:1]) + (r.duplicate_of,) for r in got.collect()} == {tuple(r[:1]) + (r.duplicate_of,) for r in want.collect()}
    assert {r.source_file: r.duplicate_of for r in got.collect()}["f"] == "00"
