"""Repeated documents are marked, never dropped.

A row repeats an earlier one (by file name) if it has the same bytes, or the same vendor, date
and total with all three present. The hash is tried first. A repeated row registers neither of
its keys, so nothing is ever a duplicate of a duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import NO_CENTS, round_money
from tillroll.functions.text import let, strip
from tillroll.operators.settling import SIDES, blocked_rows, key_members
from tillroll.operators.skew import LEAST_ROWS, join_salted
from tillroll.sources.shared import stage, staging

# Fixed value: warning text.
DUPLICATE_OF = "duplicate of "


def fingerprint(vendor: Column, date: Column, total: Column) -> Column:
    """32 hex digits for (vendor, date, total to cents), null unless all three are present. The
    lengths go first, so that the parts cannot run into each other."""
    name = F.lower(strip(vendor))
    cents = F.when(F.abs(total) < NO_CENTS, F.rint(round_money(total) * 100.0).cast("bigint").cast("string"))
    amount = F.coalesce(cents, total.cast("string"))
    present = (vendor != "") & (date != "") & total.isNotNull() & ~F.isnan(total)
    parts = (F.length(name), F.length(date), name, date, amount)
    return F.when(present, F.md5(F.concat_ws(" ", *[part.cast("string") for part in parts])))


def duplicate_key(receipts: DataFrame) -> Column:
    """One key per row where equal bytes always carry equal fields: the fingerprint if there
    is one, else the content hash."""
    found = fingerprint(F.col("vendor"), F.col("date"), F.col("total"))
    return F.coalesce(
        F.concat(F.lit("f"), found),
        F.concat(F.lit("h"), F.nullif(F.col("content_hash"), F.lit(""))),
    )


def first_files(keyed: DataFrame, key: str) -> DataFrame:
    """First file and number of rows of every key that occurs more than once. Counting before
    the shuffle leaves one row per key and task, however large a group is."""
    return (
        keyed.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("source_file").alias("first_file"), F.count(F.lit(1)).alias("rows_of_key"))
        .where(F.col("rows_of_key") > 1)
    )


def mark_duplicates(receipts: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Mark duplicates where the fields follow from the bytes, as with rule extraction.

    The input is written once together with its keys. Counting then reads the keys only, and
    its shuffle serves both ways of the join."""
    keyed = stage(receipts.withColumn("_key", duplicate_key(receipts)), "keyed")
    firsts = first_files(keyed.select("_key", "source_file"), "_key")
    joined = join_salted(keyed, firsts.drop("rows_of_key"), "_key", "source_file", least_rows=least_rows)
    original = F.when(F.col("first_file") != F.col("source_file"), F.col("first_file"))
    return _with_original(joined, original, receipts.columns)


def duplicates_by_hash(files: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(source_file, content_hash, duplicate_of) by bytes alone."""
    hashed = stage(files.select("source_file", "content_hash"), "hashed")
    firsts = first_files(hashed, "content_hash")
    joined = join_salted(hashed, firsts.drop("rows_of_key"), "content_hash", "source_file", least_rows=least_rows)
    return joined.select(
        "source_file",
        "content_hash",
        F.when(F.col("first_file") != F.col("source_file"), F.col("first_file")).alias(
            "duplicate_of"
        ),
    )


def row_keys() -> dict[str, Column]:
    """The two keys of a row: `h` by its bytes and `f` by its fields, null where it has none.
    Their first letters keep them apart where they are stored together."""
    found = fingerprint(F.col("vendor"), F.col("date"), F.col("total"))
    return {
        "h": F.concat(F.lit("h"), F.nullif(F.col("content_hash"), F.lit(""))),
        "f": F.concat(F.lit("f"), found),
    }


def mark_duplicates_any(receipts: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Mark duplicates where equal bytes may carry different fields, as with model replies.

    Which rows are originals depends on all earlier rows; `settling` finds them in rounds whose
    number grows with the logarithm of the longest chain. It sees one row per pair of keys, the
    first, since no other of them can be an original. What the pair is told - the originals
    that registered its keys - goes to all its rows in one join."""
    return _mark_by_pairs(receipts, None, least_rows)


def _digest(key: Column) -> Column:
    """A key in 16 bytes, which is what is sorted and moved instead of its text."""
    return F.unhex(F.md5(key))


def _pair(h: Column, f: Column) -> Column:
    """Both digests of a row in 16 bytes, null if it has no key."""
    none = F.lit(bytes(16))
    both = F.concat(F.coalesce(h, none), F.coalesce(f, none))
    return F.when(F.coalesce(h, f).isNotNull(), F.unhex(F.md5(both)))


def _mark_by_pairs(receipts: DataFrame, seen: DataFrame | None, least_rows: int, staged: bool = False) -> DataFrame:
    keys = {k: _digest(key) for k, key in row_keys().items()}
    # Let by name, so that the digests are computed once although several columns use them.
    pair = let(F.struct(*[keys[k].alias(k) for k in SIDES]), lambda d: _pair(d["h"], d["f"]))
    keyed = receipts.withColumn("_pair", pair)
    keyed = keyed if staged else stage(keyed, "keyed")
    with staging(receipts.sparkSession):
        told = stage(_told(keyed, keys, seen, least_rows), "told", outlives=True)
    joined = join_salted(keyed, told, "_pair", "source_file", least_rows=least_rows)
    # An original further down the list was not registered yet when this row was judged.
    earlier = [F.when(F.col(f"original_{key}") < F.col("source_file"), F.col(f"original_{key}")) for key in SIDES]
    return _with_original(joined, F.coalesce("seen_file", *earlier), receipts.columns)


def _told(keyed: DataFrame, keys: dict[str, Column], seen: DataFrame | None, least_rows: int) -> DataFrame:
    """(_pair, original_h, original_f, seen_file): what the rows of a pair are told, for the pairs
    that are told anything. What is staged for it may go once the result is written."""
    pairs = (
        keyed.where("_pair is not null")
        .groupBy(*[keys[k].alias(k) for k in SIDES])
        .agg(F.min("source_file").alias("first_file"), F.count(F.lit(1)).alias("n"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    none = F.lit(None).cast("string")
    pair = _pair(F.col("h"), F.col("f")).alias("_pair")
    if seen is None:
        fresh = pairs = stage(pairs, "pairs")
    else:
        with staging(keyed.sparkSession):
            pairs = stage(_with_seen(stage(pairs, "pairs"), seen, least_rows), "known", outlives=True)
        fresh = pairs.where("seen_file is null")
    # Names may repeat; then it is a hash of the keys that tells which pair comes first.
    members = key_members(fresh.withColumn("tie", F.hash(*SIDES)), ("first_file", "tie", "row"), least_rows)
    with staging(keyed.sparkSession):
        blocked = stage(blocked_rows(fresh, members)[0], "blocked", outlives=True)
    # At most one of the rows of a key is an original, and it is the one that registered the key.
    group = (F.col("head") * 2 + F.col("side")).alias("group")
    registered = members.join(blocked, "row", "left_anti").select(group, "row")
    registered = registered.join(fresh.select("row", "first_file"), "row").select("group", F.col("first_file").alias("file"))
    registered = stage(registered, "registered")
    taken = members.join(blocked, "row", "left_semi").select("row", "side", group)
    taken = stage(join_salted(taken, registered, "group", "row", least_rows=least_rows).drop("group"), "taken")
    originals = taken.groupBy("row").agg(*[F.min(F.when(F.col("side") == s, F.col("file"))).alias(f"original_{k}") for s, k in enumerate(SIDES)])
    told = fresh.select("row", pair).join(originals, "row").select("_pair", "original_h", "original_f", none.alias("seen_file"))
    # The further rows of an original's pair repeat it.
    repeated = fresh.where("n > 1").join(blocked, "row", "left_anti")
    told = told.unionByName(repeated.select(pair, F.col("first_file").alias("original_h"), none.alias("original_f"), none.alias("seen_file")))
    if seen is not None:
        before = pairs.where("seen_file is not null")
        told = told.unionByName(before.select(pair, none.alias("original_h"), none.alias("original_f"), "seen_file"))
    return told


def _with_seen(pairs: DataFrame, seen: DataFrame, least_rows: int) -> DataFrame:
    """Pairs of keys with `seen_file`, the original of earlier runs: by hash, else by fields.
    Only keys of this batch are looked up, and each gives one row, whatever repeated and late
    runs have stored: the file of the earliest run."""
    wanted = pairs.select(F.explode(F.array_compact(F.array(*SIDES))).alias("key")).distinct()
    looked_up = stage(
        seen.withColumn("key", _digest(F.col("key")))
        .join(wanted, "key", "left_semi")
        .groupBy("key")
        .agg(F.min_by("source_file", F.struct("run_id", "source_file")).alias("file")),
        "looked_up",
    )
    for key in SIDES:
        facts = looked_up.select(F.col("key").alias(key), F.col("file").alias(f"seen_{key}"))
        pairs = join_salted(pairs, facts, key, "row", least_rows=least_rows)
    return pairs.withColumn("seen_file", F.coalesce("seen_h", "seen_f")).drop("seen_h", "seen_f")


def _with_original(joined: DataFrame, original: Column, columns: list[str]) -> DataFrame:
    warned = F.array_append("warnings", F.concat(F.lit(DUPLICATE_OF), F.col("_original")))
    marked = joined.withColumn("_original", original).withColumns(
        {
            "duplicate_of": F.col("_original"),
            "warnings": F.when(F.col("_original").isNull(), F.col("warnings")).otherwise(warned),
        }
    )
    return marked.select(*columns)


def across_runs(receipts: DataFrame, seen: DataFrame, least_rows: int = LEAST_ROWS, staged: bool = False) -> DataFrame:
    """Mark rows one of whose keys an earlier run has seen, then the repeats within this batch.

    `seen` holds (key, source_file, run_id) of originals, a row per key, and several per key
    where a run was repeated or came late. Both keys count, the bytes first, so that a file is
    known again however it was read. A row that an earlier run has seen registers no key.
    Rows are read several times; they are written for that unless they come from a written table
    (`staged`), which then has to stay as long as the result is read."""
    return _mark_by_pairs(receipts, seen, least_rows, staged)


def new_keys(marked: DataFrame) -> DataFrame:
    """The keys this batch adds to the seen ones: both of each of its originals. `main` marks
    the fingerprint, or the hash where there is none."""
    originals = marked.where("duplicate_of is null").withColumns(row_keys())
    main, other = F.coalesce("f", "h"), F.when(F.col("f").isNotNull(), F.col("h"))
    both = F.array(F.struct(main.alias("key"), F.lit(True).alias("main")), F.struct(other.alias("key"), F.lit(False).alias("main")))
    return originals.select("source_file", F.inline(both)).where("key is not null").select("key", "source_file", "main")
