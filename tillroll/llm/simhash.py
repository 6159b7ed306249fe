"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint sums up the XXH64 values of a text's word shingles. Its 64 bits are grouped so
that correlated bits share a part. If two fingerprints differ in at most `distance` bits and
the thresholds of the parts add up to distance - parts + 1, they differ by at most its
threshold in at least one part. Every fingerprint gets its own thresholds, by dynamic
programming over the estimated candidate counts (exact counts of all fingerprints within 0 to
3 bits of its part, from a table of fixed size); it probes the buckets within them, and the
candidates are verified. A threshold of -1 leaves a part out.

Null texts have no words and the fingerprint zero. Rows with equal ids share a component.
Null ids keep their row; they never name a component that has another id. An empty table
gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bytes import chunks, mix, utf8
from tillroll.llm.components import components, forest
from tillroll.operators.skew import join_salted
from tillroll.sources.shared import stage

SHINGLE = 3
DISTANCE = 3
PARTS = 4
WIDTH = 64 // PARTS
SEED = 42
# Fingerprints of one bucket that one task compares with the bucket's probes.
BLOCK = 4096
_PAIRS = 1 << 20
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
# All masks over one part, those with fewer bits first.
_MASKS = np.array([sum(1 << b for b in c) for n in range(DISTANCE + 1) for c in combinations(range(WIDTH), n)])
_MASKS_UPTO = [0, 1, 17, 137, 697]


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and the ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    values = np.array(hashes, np.uint64)
    counted = np.bincount((values.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    set_bits = (counted.reshape(8, 256) @ _BYTE_BITS).ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            found = [fingerprint_of(data[at[i] : at[i + 1]].tobytes(), shingle) for i in range(len(at) - 1)]
            fp = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _group_bits(distinct: DataFrame) -> np.ndarray:
    """The order of the bits: bits that go together stand in one part. Counts of all pairs of
    set bits over all fingerprints, 4,096 numbers whatever their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            pairs, total = pairs + bits.T @ bits, total + len(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(pairs.ravel(), total).astype(np.int64))],
            ["i", "n"],
        )

    rows = distinct.mapInArrow(work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(4097)
    flat[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    pairs, total = flat[:-1].reshape(64, 64), max(flat[-1], 1)
    mean = np.diag(pairs) / total
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    link = np.abs(pairs / total - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    left, order = list(range(64)), []
    while left:
        first = max(left, key=lambda i: (link[i, left].sum(), -i))
        part = [first]
        left.remove(first)
        while len(part) < WIDTH:
            best = max(left, key=lambda i: (link[i, part].sum(), -i))
            part.append(best)
            left.remove(best)
        order += part
    return np.array(order)


def _parts(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The value of each part, one row per part."""
    out = np.zeros((PARTS, len(fp)), np.int64)
    for k, bit in enumerate(order):
        out[k // WIDTH] |= (((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k % WIDTH)).astype(np.int64)
    return out


def _histogram(distinct: DataFrame, order: np.ndarray) -> np.ndarray:
    """How many fingerprints have each value in each part: PARTS x 2**WIDTH counters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(PARTS << WIDTH, np.int64)
        for batch in batches:
            values = _parts(batch.column(0).to_numpy().view(np.uint64), order)
            for i in range(PARTS):
                found += np.bincount(values[i] + (i << WIDTH), minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["i", "n"])

    rows = distinct.mapInArrow(work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PARTS << WIDTH, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(PARTS, 1 << WIDTH)


def _within(histogram: np.ndarray) -> np.ndarray:
    """[part, t, value]: fingerprints whose part is within t bits of the value."""
    exact = np.zeros((PARTS, DISTANCE + 1, 1 << WIDTH))
    exact[:, 0] = histogram
    values = np.arange(1 << WIDTH)
    for bit in range(WIDTH):
        flipped = exact[:, :, values ^ (1 << bit)]
        exact[:, 1:] += flipped[:, :-1]
    return np.cumsum(exact, axis=1)


def _thresholds(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    """[part, row]: thresholds from -1 to DISTANCE that add up to DISTANCE - PARTS + 1 at the
    least estimated cost: candidates to verify, and buckets to probe."""
    n, goal = values.shape[1], DISTANCE - PARTS + 1
    low, high = -PARTS, DISTANCE
    best = np.full((high - low + 1, n), np.inf)
    best[-low] = 0.0
    choice = []
    for i in range(PARTS):
        cost = [np.zeros(n)] + [within[i, t, values[i]] + 4 * _MASKS_UPTO[t + 1] for t in range(DISTANCE + 1)]
        new, picked = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t in range(-1, DISTANCE + 1):
            for s in range(len(best)):
                if 0 <= s + t < len(best):
                    total = best[s] + cost[t + 1]
                    better = total < new[s + t]
                    new[s + t][better] = total[better]
                    picked[s + t][better] = t
        best = new
        choice.append(picked)
    state, out = np.full(n, goal - low), np.zeros((PARTS, n), np.int64)
    for i in reversed(range(PARTS)):
        out[i] = choice[i][state, np.arange(n)]
        state = state - out[i]
    return out


def near_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between fingerprints (column fp, each once) that join exactly those within
    `distance` bits, directly or through others: of a dense group a spanning forest is given,
    never all its pairs."""
    if distance != DISTANCE:
        raise ValueError(f"the tables are laid out for a distance of {DISTANCE}")
    order = _group_bits(distinct)
    histogram = _histogram(distinct, order)
    shared = distinct.sparkSession.sparkContext.broadcast((histogram, _within(histogram)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram, within = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                signed = batch.column(0).to_numpy()[at : at + 2048]
                fp = signed.view(np.uint64)
                values = _parts(fp, order)
                limits = _thresholds(values, within)
                keys, owners, probes = [], [], []
                for i in range(PARTS):
                    blocks = -(-histogram[i] // BLOCK)
                    own = (mix(fp) % blocks[values[i]].astype(np.uint64)).astype(np.int64)
                    keys.append((((i << WIDTH) | values[i]) << 32) | own)
                    owners.append(signed)
                    probes.append(np.zeros(len(fp), bool))
                    for t in range(DISTANCE + 1):
                        rows = np.flatnonzero(limits[i] == t)
                        near = values[i][rows][:, None] ^ _MASKS[: _MASKS_UPTO[t + 1]]
                        row, column = np.nonzero(histogram[i][near] > 0)
                        value = near[row, column]
                        n = blocks[value]
                        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        keys.append((((i << WIDTH) | np.repeat(value, n)) << 32) | block)
                        owners.append(np.repeat(signed[rows[row]], n))
                        probes.append(np.ones(len(block), bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, owners, probes)], ["bucket", "fp", "probe"]
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come bucket by bucket, its members before its probes."""
        held_bucket, held = -1, np.zeros(0, np.uint64)
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            is_probe = batch.column(2).to_numpy(zero_copy_only=False)
            # The members of the last bucket of the batch before stay in front.
            bucket = np.concatenate([np.full(len(held), held_bucket), bucket])
            fp = np.concatenate([held, fp])
            is_probe = np.concatenate([np.zeros(len(held), bool), is_probe])
            first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
            size = np.diff(np.append(first, len(bucket)))
            members = np.add.reduceat(~is_probe, first) if len(first) else first
            probes = np.flatnonzero(is_probe)
            start, count = np.repeat(first, size)[probes], np.repeat(members, size)[probes]
            for i, j in chunks(np.concatenate(([0], np.cumsum(count))), _PAIRS, 1 << 20):
                n = count[i:j]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = np.repeat(fp[probes[i:j]], n), fp[np.repeat(start[i:j], n) + offset]
                differ = np.bitwise_count(a ^ b)
                near = (differ <= distance) & (differ > 0)
                if near.any():
                    x, y = forest(a[near].view(np.int64), b[near].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            held_bucket = bucket[-1]
            last = (bucket == held_bucket) & ~is_probe
            held = fp[last]

    rows = distinct.mapInArrow(probe, "bucket long, fp long, probe boolean")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "probe")
    return dealt.mapInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    members = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(members.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = stage(components(near_links(distinct.select("fp"), distance)), "roots")
    # Most fingerprints have no neighbour and are their own root.
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A root may stand for a third of all fingerprints, as a fingerprint for a third of all rows.
    facts = join_salted(stage(placed.select("fp", "root"), "placed"), lowest, "root", "fp").select("fp", "component_id")
    joined = join_salted(members, stage(facts, "classes"), "fp", "doc_id")
    return joined.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
