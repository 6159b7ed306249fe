"""Sharding by sampled splitters.

Records are ordered by a hash of their text, so equal texts lie side by side. A size-weighted
sample of the hashes gives quantile boundaries; records are dealt over the ranges between
them. A range that holds more than its share is subdivided by document id, so a text that is
repeated over a third of all rows still spreads. The measured bytes and rows of the ranges and
the running sums inside them give every record its place in the whole order, and so its shard. Law `bytes`: the sizes of the shards are near equal.

Null texts have no bytes, null ids sort first, repeated rows are kept and take a slot each, an
empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.sources.shared import stage

# Ranges per shard, the unit of work; about SAMPLE rows are drawn for the splitters.
RANGES_PER_SHARD = 64
SAMPLE = 20_000


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )


def splitters(sized: DataFrame, ranges: int, sample: int = SAMPLE) -> list[int]:
    """Up to `ranges` - 1 boundaries, quantiles of a sample in which a row's chance grows with
    its size. Drawing by a hash of the row keeps the choice the same when a task is run again."""
    rate = float(sample) / max(sized.agg(F.sum("size")).first()[0] or 0, 1)
    # -ln(u) / size is an exponential draw with rate `size`; the smallest are the sample.
    u = (F.pmod(F.xxhash64("_key", "doc_id", F.lit(7)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = (
        sized.where(u < F.least(F.lit(1.0), F.lit(rate) * F.col("size")))
        .select("_key")
        .agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 10_000).alias("q"))
    )
    found = drawn.first()["q"] or []
    return sorted(set(found))


def _place(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries below `key`, by a search in a literal array of bounded length."""
    if not bounds:
        return F.lit(0)
    steps = max(1, len(bounds).bit_length())
    array = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    # Binary search as a fold: the state is the count of boundaries known to be below the key.
    size = len(bounds)
    low = F.lit(0)
    jumps = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])

    def step(at: Column, jump: Column) -> Column:
        there = at + jump
        return F.when((there <= size) & (F.get(array, there - 1) < key), there).otherwise(at)

    return F.aggregate(jumps, low, step)


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, range_no): slots are gapless from 0 per shard.

    Only ids, sizes and hashes are shuffled, never texts. Sizes per range (at most
    about twice shards x ranges_per_shard rows) are the one thing collected."""
    # Written once, without the texts: every later step reads these four columns only.
    sized = stage(_sized(docs, id_col, text_col), "sizes")
    ranges = shards * ranges_per_shard
    bounds = splitters(sized, ranges)
    placed = sized.withColumn("_range", _place(F.col("_key"), bounds))
    sums = placed.groupBy("_range").agg(F.sum("size").alias("bytes")).collect()
    share = max(1, sum(r["bytes"] for r in sums) // ranges)
    # An overfull range is cut by document id into pieces of about one share.
    pieces = {r["_range"]: -(-r["bytes"] // share) for r in sums if r["bytes"] > 2 * share}
    piece = F.lit(0)
    if pieces:
        counts = F.array(*[F.lit(pieces.get(i, 1)).cast("int") for i in range(max(pieces) + 1)])
        n = F.coalesce(F.get(counts, F.col("_range")), F.lit(1))
        piece = F.pmod(F.xxhash64("doc_id", "_key"), n).cast("int")
    parts = stage(placed.withColumn("_piece", piece), "pieces")
    cells = (
        parts.groupBy("_range", "_piece")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .orderBy("_range", "_piece")
        .collect()
    )
    total = sum(c["bytes"] for c in cells)
    rows_before = bytes_before = 0
    table = []
    for c in cells:
        table.append((c["_range"], c["_piece"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + c["bytes"], rows_before + c["n"]
    cell = docs.sparkSession.createDataFrame(table, "_r int, _p int, _bytes long, _rows long")
    order = Window.partitionBy("_range", "_piece").orderBy("_key", "doc_id", "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed_rows = parts.withColumns({"_run": F.sum("size").over(upto), "_row": F.row_number().over(order)})
    # A row goes to the shard in which its middle byte lies, so sizes differ by a row at most.
    middle = (F.col("_bytes") + F.col("_run")) * 2 - F.col("size")
    to = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(2 * max(total, 1)))))
    dealt = stage(
        placed_rows.join(F.broadcast(cell), (F.col("_range") == F.col("_r")) & (F.col("_piece") == F.col("_p")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            to.cast("int").alias("shard"),
            (F.col("_rows") + F.col("_row") - 1).alias("_index"),
            F.col("_range").alias("range_no"),
        ),
        "shards",
    )
    first = dealt.groupBy(F.col("shard").alias("_s")).agg(F.min("_index").alias("_first"))
    return dealt.join(F.broadcast(first), F.col("shard") == F.col("_s")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"), "range_no"
    )
