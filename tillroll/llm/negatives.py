"""Hard-negative mining by segment summaries.

Vectors lie packed in chunks, each with the mean and the deviation of its segments: one
segment, then four, then sixteen. For two segments of m components the inner product is m times
the product of the means, give or take the product of the deviations (the lengths of what is
left after the means), so the summaries bound a score from both sides. Pairs that the coarse
bounds cannot rule out are bounded by finer segments, and what is left is scored exactly.

The anchors are a stated query set against all rows: blocks of anchors, PASS bytes of them at a
time, are broadcast to the chunks of rows, which never move. A task keeps the best few per anchor, and
only these are shuffled."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.sources.shared import stage

CHUNK = 1 << 20  # components of a chunk of rows
BLOCK = 1 << 17  # components of a block of anchors
PASS = 32 << 20  # bytes of blocks broadcast at a time
STRIPE = 512  # rows of a chunk that meet a block at a time
SEGMENTS = (1, 4, 16)
SLACK = 1e-5  # of the lengths' product: far above the rounding of the summaries
DENSE = 8  # from one pair in so many on, all pairs of a stripe are multiplied

NONE = np.iinfo(np.int64).min
_LOCAL = "anchor_row long, slot int, score long, id long, row long"


# --- packed vectors with their summaries


def _padded(vectors: np.ndarray, length: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, length - vectors.shape[1])))


def _summaries(vectors: np.ndarray) -> list[np.ndarray]:
    """Per level the means and the deviations of the segments, lengths multiplied in: the
    product of two rows of means is then the sum over segments of m * mean * mean."""
    out = []
    for n in SEGMENTS:
        width = -(-max(vectors.shape[1], 1) // n)
        parts = _padded(vectors, width * n).reshape(len(vectors), n, width)
        means = parts.mean(axis=2)
        spread = np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))
        out += [(means * np.sqrt(width)).astype(np.float32), spread.astype(np.float32)]
    return out


def _narrow(vectors: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not vectors.size or np.abs(vectors).max() <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def pack(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, **more: np.ndarray) -> bytes:
    """Rows, sorted by id, with all their summaries, as one binary value. `ids` is a masked
    array; rows without an id come last."""
    order = np.lexsort((rows, ids.filled(0), np.ma.getmaskarray(ids)))
    columns = {"rows": rows, "ids": ids.filled(0), "no_id": np.ma.getmaskarray(ids), "labels": labels, "vectors": _narrow(vectors), **more}
    columns = {k: v[order] for k, v in columns.items()}
    with np.errstate(over="ignore", invalid="ignore"):
        columns |= {f"level{i}": s for i, s in enumerate(_summaries(vectors[order]))}
        columns["lengths"] = np.sqrt((vectors[order] ** 2).sum(axis=1))
    out = io.BytesIO()
    np.savez(out, **columns)
    return out.getvalue()


class Packed:
    def __init__(self, blob: bytes):
        # Nothing but plain arrays was packed, and nothing else is read.
        with np.load(io.BytesIO(blob), allow_pickle=False) as stored:
            self.__dict__ |= {name: stored[name] for name in stored.files}
        self.vectors = self.vectors.astype(np.float64)
        self.levels = [(self.__dict__[f"level{2 * i}"], self.__dict__[f"level{2 * i + 1}"]) for i in range(len(SEGMENTS))]

    def stripes(self) -> Iterator[tuple[slice, "Packed"]]:
        for first in range(0, len(self.rows), STRIPE):
            part = object.__new__(Packed)
            cut = slice(first, first + STRIPE)
            for name in ("rows", "ids", "no_id", "labels", "vectors", "lengths"):
                part.__dict__[name] = self.__dict__[name][cut]
            part.levels = [(m[cut], d[cut]) for m, d in self.levels]
            yield cut, part


def _products(a: np.ndarray, x: np.ndarray, ai: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the rows a[ai] and x[xi]."""
    if len(ai) * DENSE > len(a) * len(x):
        return (a @ x.T)[ai, xi]
    cuts = range(0, len(ai), 1 << 16)
    parts = [np.einsum("ij,ij->i", a[ai[c : c + (1 << 16)]], x[xi[c : c + (1 << 16)]]) for c in cuts]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def _exact(a: np.ndarray, x: np.ndarray, ai: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles hold them where they stay below 2**53; beyond that they
    are summed as whole numbers, and cut to 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return _products(a, x, ai, xi).astype(np.int64)
    ints = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in x]
    top = 2**63 - 1
    sums = (sum(p * q for p, q in zip(ints[0][i], ints[1][j], strict=True)) for i, j in zip(ai, xi, strict=True))
    return np.array([min(max(s, -top), top) for s in sums], np.int64)


def scored(anchors: Packed, rows: Packed, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, row, score) of the allowed pairs whose score may lie in [least, most] of the
    anchor: bounded level by level, the rest scored exactly."""
    alive, ai, xi = allowed, None, None
    width = max(anchors.vectors.shape[1], rows.vectors.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        for (ma, da), (mx, dx) in zip(anchors.levels, rows.levels, strict=True):
            if ai is None:
                ai, xi = np.nonzero(alive)
            if not len(ai):
                break
            if anchors.vectors.shape[1] == rows.vectors.shape[1]:
                middle, reach = _products(ma, mx, ai, xi), _products(da, dx, ai, xi)
            else:  # segments do not match; only the lengths bound the score
                middle, reach = 0.0, anchors.lengths[ai] * rows.lengths[xi]
            reach = reach + SLACK * anchors.lengths[ai] * rows.lengths[xi] + SLACK
            # What is not a number rules nothing out.
            out = (middle + reach < least[ai]) | (middle - reach > most[ai])
            ai, xi = ai[~out], xi[~out]
    if ai is None:
        ai, xi = np.nonzero(alive)
    return ai, xi, _exact(_padded(anchors.vectors, width), _padded(rows.vectors, width), ai, xi)


class Best:
    """The best few rows per slot: higher scores first, then rows with the smaller id."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.kth = keep, np.full(slots, NONE)
        self.held = [np.zeros(0, np.int64) for _ in range(4)] + [np.zeros(0, bool)]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, no_id: np.ndarray) -> None:
        good = score >= self.kth[slot]
        new = (slot, score, ids, rows, no_id)
        slot, score, ids, rows, no_id = both = [np.concatenate((old, n[good])) for old, n in zip(self.held, new, strict=True)]
        if not len(slot):
            return
        order = np.lexsort((rows, ids, no_id, -score, slot))
        slot, score = slot[order], score[order]
        first = np.concatenate(([True], slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        self.held = [column[order[rank < self.keep]] for column in both]
        last = rank == self.keep - 1
        self.kth[slot[last]] = score[last]


# --- the two searches of a task


def _positives(keep: int):
    """The best rows of the anchor's own label."""

    def start(block: Packed) -> Best:
        return Best(len(block.rows), keep)

    def search(block: Packed, best: Best, part: Packed) -> None:
        allowed = (block.labels[:, None] == part.labels) & (block.rows[:, None] != part.rows)
        ai, xi, score = scored(block, part, allowed, best.kth.astype(float), np.full(len(block.rows), np.inf))
        best.add(ai, score, part.ids[xi], part.rows[xi], part.no_id[xi])

    return start, search, 1


def _negatives(positives: int, keep: int, low: int, high: int):
    """Per positive, the best rows of other labels whose score is from `low` to `high` percent
    of the positive's."""

    def start(block: Packed) -> Best:
        best, score = Best(len(block.rows) * positives, keep), block.positives
        # In whole numbers: low * p <= 100 * n <= high * p. A negative p leaves no room; a slot
        # without a positive has one.
        whole = score.astype(object)
        least, most = -(-low * whole // 100), high * whole // 100
        block.open = ((least <= most) & (whole >= 0)).astype(bool)
        block.floor = np.where(block.open, least, 2**62).astype(np.int64)
        block.ceiling = np.where(block.open, most, NONE).astype(np.int64)
        return best

    def search(block: Packed, best: Best, part: Packed) -> None:
        least = np.maximum(block.floor, best.kth.reshape(block.floor.shape))
        allowed = (block.labels[:, None] != part.labels) & block.open.any(axis=1)[:, None]
        ai, xi, score = scored(block, part, allowed, least.min(axis=1).astype(float), block.ceiling.max(axis=1).astype(float))
        for p in range(positives):
            fits = (score >= least[ai, p]) & (score <= block.ceiling[ai, p])
            a, x = ai[fits], xi[fits]
            best.add(a * positives + p, score[fits], part.ids[x], part.rows[x], part.no_id[x])

    return start, search, positives


def _search(kind):
    """Meet all blocks with all chunks of a partition; emit the best of the partition."""
    start, search, slots = kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[Packed, Best]] = {}
        chunk_id, chunk = None, None
        for batch in batches:
            for c, blob, b, anchors in zip(*[batch.column(i) for i in range(4)], strict=True):
                if c.as_py() != chunk_id:
                    chunk_id, chunk = c.as_py(), Packed(blob.as_py())
                if b.as_py() not in blocks:
                    block = Packed(anchors.as_py())
                    blocks[b.as_py()] = block, start(block)
                for _, part in chunk.stripes():
                    search(*blocks[b.as_py()], part)
        for block, best in blocks.values():
            slot, score, ids, rows, no_id = best.held
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.rows[slot // slots]), pa.array((slot % slots).astype(np.int32)), pa.array(score), pa.array(ids, mask=no_id), pa.array(rows)],
                ["anchor_row", "slot", "score", "id", "row"],
            )

    return run


# --- the Spark side


def _packer(scale: float, size: int, positives: int = 0):
    """Batches of (row, id, label, vector[, scores of the positives]) to packed blobs."""

    def blob(table: pa.Table) -> bytes:
        lists = table.column("vector").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = np.floor(scale * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
        vectors = np.zeros((len(lengths), int(lengths.max(initial=0))))
        vectors[np.arange(vectors.shape[1]) < lengths[:, None]] = flat
        ids = table.column("id").combine_chunks()
        known = np.ma.masked_array(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        more = {}
        if positives:
            scores = np.full((len(lengths), positives), -1)
            for i, own in enumerate(table.column("scores").to_pylist()):
                scores[i, : len(own or ())] = own or ()
            more["positives"] = scores
        return pack(table.column("row").to_numpy(), known, table.column("label").to_numpy(), vectors, **more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, longest = 0, 1
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            first = 0
            while first < len(lengths):
                # As many more rows as stay within the size once all are padded to the longest.
                widest = np.maximum.accumulate(np.maximum(lengths[first:], longest))
                fit = int(np.searchsorted(widest * (n + 1 + np.arange(len(widest))), size, "right"))
                fit = max(fit, 1) if not n else fit
                held.append(batch.slice(first, fit))
                n, first = n + fit, first + fit
                longest = int(widest[fit - 1]) if fit else longest
                if first < len(lengths):
                    yield _one(blob(pa.Table.from_batches(held)))
                    held, n, longest = [], 0, 1
        if n:
            yield _one(blob(pa.Table.from_batches(held)))

    return run


def _one(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])


def _packed(rows: DataFrame, scale: float, size: int, name: str, positives: int = 0) -> DataFrame:
    blobs = rows.mapInArrow(_packer(scale, size, positives), "blob binary")
    return stage(blobs.withColumn("number", F.monotonically_increasing_id()), name)


def _passes(blocks: DataFrame) -> list[list[int]]:
    """Numbers of blocks to broadcast together. A number stands for some 2,000 anchors, that is
    100,000 rows, so these are few."""
    passes: list[list[int]] = [[]]
    room = PASS
    for row in blocks.select("number", F.octet_length("blob").alias("size")).orderBy("number").collect():
        if row["size"] > room and passes[-1]:
            passes.append([])
            room = PASS
        passes[-1].append(row["number"])
        room -= row["size"]
    return passes


def _tops(chunks: DataFrame, blocks: DataFrame, kind, keep: int) -> DataFrame:
    """The best `keep` rows per anchor and slot over all chunks, with their `rank`."""
    found = []
    for numbers in _passes(blocks):
        now = blocks.where(F.col("number").isin(numbers)).select(F.col("number").alias("block"), F.col("blob").alias("anchors"))
        met = chunks.select("number", "blob").crossJoin(F.broadcast(now))
        found.append(stage(met.mapInArrow(_search(kind), _LOCAL), "met"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows
    (vec_id, label, embedding).

    Components become floor(scale * x); a score is the integer inner product, missing
    components count as zero. An anchor's positives are its best `positives` other rows of its
    label; to each belong the best `negatives` rows of other labels with low * positive <=
    100 * negative <= high * positive. Equal scores are ordered by the smaller vec_id, a null
    one last. Rows without label or vector, or with a component that is null or not finite,
    take no part. Repeated rows are rows of their own, also of the anchor's id; an empty vector
    scores zero. Without anchors or fitting rows there is no result; further columns are not
    looked at."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    kept = stage(
        clean.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("id"),
            F.col("label").cast("long").alias("label"),
            F.col("embedding").alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ),
        "vectors",
    )
    chunks = _packed(kept.select("row", "id", "label", "vector"), scale, CHUNK, "chunks")
    anchors = kept.where("is_anchor").drop("is_anchor")
    blocks = _packed(anchors, scale, BLOCK, "blocks")
    own = stage(_tops(chunks, blocks, _positives(positives), positives), "positives")
    scores = own.groupBy(F.col("anchor_row").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores")
    )
    with_scores = _packed(anchors.join(scores, "row"), scale, BLOCK, "blocks", positives)
    worst = _tops(chunks, with_scores, _negatives(positives, negatives, low, high), negatives)
    listed = own.select(
        "anchor_row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (
        worst.select("anchor_row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(listed, ["anchor_row", "slot"])
        .join(named, "anchor_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
