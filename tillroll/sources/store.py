"""The tables of the review service.

A run writes its tables aside, each to a folder of its own, and publishes them by one entry of
the store's log: readers see all of a run or nothing, wherever its writer was cut off. Repeating
a run publishes new folders in place of the old ones. Every run id belongs to one origin - a
caller or one batch of one stream - and is claimed by an entry of the log first, so that no
origin replaces another's run. The review log is append-only; the reviewed state is derived
from it.

Of `fan` folders of one size, one larger folder is made, so that a table with n runs has about
fan * log(n) folders. The rows of a repeated run in such a folder are passed over until the next
merge drops them. Tables that are looked up by a key are split into buckets of the key's hash."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators.report import report_rows
from tillroll.options import OUTPUT_FORMATS, Options
from tillroll.sources.commits import CommitLog, Files
from tillroll.sources.shared import shuffles_given_back

TABLES = {
    "receipts": schemas.RECEIPTS + ", reason string, run_id bigint",
    "runs": schemas.RUNS,
    "flagged": schemas.FLAGGED,
    "alerts": schemas.ALERTS,
    "cache": schemas.CACHE,
    "key_index": schemas.KEY_INDEX,
    "uploads": schemas.UPLOADS,
    "review_log": schemas.REVIEW_LOG,
}
#: Tables that are looked up by a key.
BUCKETED = {"cache": "content_hash", "key_index": "key", "uploads": "source_file"}
BUCKETS = 256

# Origin of the runs that callers number themselves; the store adds whose.
MANUAL = "manual"
FAN = 16


def bucket_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int")


def _apply(state: dict, entry: dict) -> dict:
    """The state after an entry: who has claimed which run, and per table the folders in use
    with the runs they may hold (`first` to `last`) and those whose rows are void (`dead`)."""
    if "claim" in entry:
        state["claims"][str(entry["claim"])] = entry["origin"]
    if "run" in entry:
        run = entry["run"]
        for table in entry["clear"]:
            kept = []
            for item in state["tables"].get(table, []):
                if item["first"] == item["last"] == run:
                    continue
                if item["first"] <= run <= item["last"] and run not in item["dead"]:
                    item["dead"].append(run)
                kept.append(item)
            state["tables"][table] = kept
    if "merge" in entry:
        items = state["tables"][entry["merge"]]
        state["tables"][entry["merge"]] = [i for i in items if i["folder"] not in entry["merged"]]
    for table, item in entry.get("add", {}).items():
        state["tables"].setdefault(table, []).append(item)
    return state


class ReviewStore:
    """`owner` names the caller: runs that it numbers itself are its own. Give a name to repeat
    runs from another process or store object; without one, no other object can."""

    def __init__(self, spark: SparkSession, root: str, owner: str | None = None, fan: int = FAN):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan
        self.owner = f"{MANUAL}:{owner or uuid.uuid4().hex}"
        self._files = Files(spark, self.root)
        self._log = CommitLog(Files(spark, f"{self.root}/_log"), {"claims": {}, "tables": {}}, _apply)

    def path(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def _items(self, table: str) -> list[dict]:
        return self._log.read()[1]["tables"].get(table, [])

    def exists(self, table: str) -> bool:
        return bool(self._items(table))

    # --- runs

    def claim(self, run_id: int, origin: str = MANUAL) -> None:
        """Reserve a run id for an origin; raises if it is another origin's."""
        origin = self.owner if origin == MANUAL else origin

        def decide(state: dict) -> dict | None:
            holder = state["claims"].get(str(run_id))
            if holder is None:
                return {"claim": run_id, "origin": origin}
            if holder != origin:
                raise ValueError(f"run {run_id} belongs to {holder}, not to {origin}")
            return None

        self._log.commit(decide)

    def run_of(self, origin: str, batch_id: int) -> int:
        """The run id of a stream's batch: a new one the first time, the same one after that."""
        owner = f"{origin}#{batch_id}"

        def decide(state: dict) -> dict | None:
            if owner in state["claims"].values():
                return None
            return {"claim": max(map(int, state["claims"]), default=-1) + 1, "origin": owner}

        claims = self._log.commit(decide)["claims"]
        return next(int(run_id) for run_id, holder in claims.items() if holder == owner)

    @contextmanager
    def run(self, run_id: int, origin: str = MANUAL) -> Iterator["Run"]:
        """Claim a run, write its tables, and publish them together at the end; if the block
        fails, nothing is published and the run's earlier tables stay."""
        self.claim(run_id, origin)
        run = Run(self, run_id)
        yield run
        self._publish(run, list(TABLES))

    def write_run(self, table: str, rows: DataFrame, run_id: int) -> None:
        """Replace one table of a run, also by nothing."""
        run = Run(self, run_id)
        run.write(table, rows)
        self._publish(run, [table])

    def _publish(self, run: "Run", clear: list[str]) -> None:
        clear = [t for t in clear if t != "review_log"]
        self._log.commit(lambda state: {"run": run.run_id, "clear": clear, "add": run.items})
        self.merge()

    def append_reviews(self, rows: DataFrame) -> None:
        item = self._write("review_log", rows, f"review-{uuid.uuid4().hex}", 0, 0)
        self._log.commit(lambda state: {"add": {"review_log": item}})
        self.merge()

    # --- folders

    def _write(self, table: str, rows: DataFrame, name: str, first: int, last: int, tier: int = 0, observed: tuple = ()) -> dict:
        folder = f"data/{table}/{name}"
        if observed:
            rows = rows.observe(*observed)
        if table in BUCKETED:
            # Files of a bucket, by many tasks where there are many rows.
            keyed = rows.withColumn("bucket", bucket_of(F.col(BUCKETED[table])))
            dealt = keyed.repartition("bucket", F.pmod(F.xxhash64(BUCKETED[table]), F.lit(64)))
            rows, parts = dealt, ["bucket"]
        else:
            parts = []
        with shuffles_given_back(rows.sparkSession):
            rows.write.partitionBy(*parts).option("compression", "zstd").parquet(self.path(folder))
        item = {"folder": folder, "first": first, "last": last, "dead": [], "tier": tier}
        if table in BUCKETED:
            names = self._files.names("data", table, name)
            item["buckets"] = sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))
        return item

    def _load(self, table: str, items: list[dict], buckets: set[int] | None = None) -> DataFrame:
        """The live rows of folders, of some buckets only if they are named."""

        def paths(item: dict) -> list[str]:
            if table not in BUCKETED:
                return [self.path(item["folder"])]
            wanted = item["buckets"] if buckets is None else [b for b in item["buckets"] if b in buckets]
            return [self.path(f"{item['folder']}/bucket={b}") for b in wanted]

        reader = self.spark.read.schema(TABLES[table])
        whole = [p for item in items if not item["dead"] for p in paths(item)]
        parts = [reader.parquet(*whole)] if whole else []
        for item in items:
            if item["dead"] and paths(item):
                parts.append(reader.parquet(*paths(item)).where(~F.col("run_id").isin(item["dead"])))
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return reduce(DataFrame.unionByName, parts)

    def read(self, table: str) -> DataFrame:
        """A table that was never written is empty. `seen_keys` has one key per original, out of
        the index of all their keys."""
        if table == "seen_keys":
            return self.read("key_index").where("main").select("key", "source_file", "run_id")
        return self._load(table, self._items(table))

    def read_current(self, table: str) -> DataFrame:
        """The rows of a table that come from the last upload of their file, of those whose
        uploads are known; all rows of the others."""
        order = F.struct("arrived_at", "seq", "run_id")
        last = self.read("uploads").groupBy("source_file").agg(F.max_by("run_id", order).alias("_last"))
        rows = self.read(table).join(last, "source_file", "left")
        return rows.where(F.col("_last").isNull() | (F.col("run_id") == F.col("_last"))).select(*rows.drop("_last").columns)

    def read_run(self, table: str, run_id: int) -> DataFrame:
        """One run's rows, out of the folders that may hold them."""
        items = [i for i in self._items(table) if i["first"] <= run_id <= i["last"] and run_id not in i["dead"]]
        return self._load(table, items).where(F.col("run_id") == run_id)

    def lookup(self, table: str, keys: Column, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of a bucketed table in the buckets of the keys of `rows`, of runs before
        `before` only if it is given. Other buckets are not opened."""
        asked = rows.select(keys.alias("key")).where("key is not null")
        found = asked.select(bucket_of(F.col("key")).alias("bucket")).distinct().collect()  # at most BUCKETS
        items = [i for i in self._items(table) if before is None or i["first"] < before]
        stored = self._load(table, items, {r["bucket"] for r in found})
        return stored if before is None else stored.where(F.col("run_id") < before)

    # --- upkeep

    def merge(self) -> None:
        """Make one folder of every `fan` of a size. Files are read in splits and written as
        they come, without a shuffle, but for bucketed tables."""
        for table in TABLES:
            while due := self._due(table):
                names = [i["folder"] for i in due]
                name = f"merged-{uuid.uuid4().hex}"
                first, last = min(i["first"] for i in due), max(i["last"] for i in due)
                item = self._write(table, self._load(table, due), name, first, last, due[0]["tier"] + 1)

                def decide(state: dict, table=table, due=due, names=names, item=item) -> dict | None:
                    # Not if another writer has merged or replaced one of them meanwhile.
                    still = [i for i in state["tables"].get(table, []) if i["folder"] in names]
                    return {"merge": table, "merged": names, "add": {table: item}} if still == due else None

                self._log.commit(decide)
                if item["folder"] not in [i["folder"] for i in self._items(table)]:
                    self._files.delete(item["folder"])

    def _due(self, table: str) -> list[dict]:
        tiers: dict[int, list[dict]] = {}
        for item in self._items(table):
            tiers.setdefault(item["tier"], []).append(item)
            if len(tiers[item["tier"]]) == self.fan:
                return tiers[item["tier"]]
        return []

    def vacuum(self) -> int:
        """Delete the folders that no table uses: merged and replaced ones and those of runs
        that were cut off. Only while nobody writes or reads older states. Returns how many."""
        state, gone = self._log.read()[1], 0
        used = {i["folder"] for items in state["tables"].values() for i in items}
        for table in self._files.names("data"):
            for name in self._files.names("data", table):
                if f"data/{table}/{name}" not in used:
                    self._files.delete("data", table, name)
                    gone += 1
        return gone


class Run:
    """The tables of a run that is being written."""

    def __init__(self, store: ReviewStore, run_id: int):
        self.store, self.run_id, self.items = store, run_id, {}

    def write(self, table: str, rows: DataFrame, **metrics: Column) -> dict:
        """Write a table of the run, aside. Returns the metrics, taken of the rows as they pass."""
        of_run = rows.withColumn("run_id", F.lit(self.run_id).cast("bigint"))
        seen = Observation()
        observed = (seen, *[c.alias(name) for name, c in metrics.items()]) if metrics else ()
        name = f"{self.run_id}-{uuid.uuid4().hex}"
        self.items[table] = self.store._write(table, of_run, name, self.run_id, self.run_id, observed=observed)
        return seen.get if metrics else {}

    def read(self, table: str) -> DataFrame:
        """What this run has written."""
        return self.store._load(table, [self.items[table]] if table in self.items else [])


def write_report(receipts: DataFrame, folder: str, output_format: str = Options().output_format) -> str:
    """The flat report as a folder of part files."""
    if output_format not in OUTPUT_FORMATS:
        raise ValueError(f"unknown output_format: {output_format}")
    writer = report_rows(receipts).write.mode("overwrite")
    if output_format == "csv":
        writer.option("header", True).option("escape", '"').csv(folder)
    else:
        writer.parquet(folder)
    return folder
