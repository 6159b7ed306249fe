"""Removal of repeated byte strings with a logarithmic family of sorted hash tables.

Hashes stand in for suffix arrays: no suffix is put in order by its bytes and no length of a
match is measured; only strings of MATCH bytes have to be told equal or not.

A byte is removed if a string of MATCH bytes covers it that also starts in a document with a
smaller id. Places are sparse: of every MATCH bytes the place with the smallest hash of its
first GRAM bytes is indexed, so equal strings index the same places. An index entry is (hash
of the first bytes, hash of the context that all strings over this place can reach, document).
Entries go to tasks by the first hash. Each task sorts what arrives by these hashes and
looks it up in its levels - a context that a smaller document has settles the entry -
and merges levels of equal size, so a family never has more than a logarithm of levels.
Contexts of a first document that share their first bytes with other contexts stay open; their
strings are compared one by one, in a second round through the same kind of family.

Equal 64-bit hashes count as equal strings (of contexts: two of them, 128 bits).

Null texts are empty. Rows with a null id are kept whole and remove nothing. Rows with equal
ids are one document to the comparison. An empty table gives no rows. Other columns stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.llm.blocks import block_of, even_blocks, pack, unpack
from tillroll.llm.bytes import chunks, mix, padded, trim, utf8, xxhash64
from tillroll.sources.shared import stage

MATCH = 50
GRAM = 24
SIDE = MATCH - GRAM
# Entries that are sorted together: a map task's pre-aggregation, a new batch of a family.
BATCH = 400_000
# Bytes of texts that are hashed at a time; the arrays over them take about a hundred times that.
PART = 1 << 18
_A, _B, _C, _D, _E = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
# Rows of a round: packed entries of a bucket, or packed (document, key) pairs of a block of
# documents, settled or open.
ENTRIES, SETTLED, OPEN, STRINGS = range(4)
ROUND_COLUMNS = "bucket int, kind int, block int, packed binary"

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


class Suffixes:
    """Hashes over the bytes of some documents, laid out with padding between them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        # 0xFF is in no UTF-8 text, so contexts at the ends of a text equal only each other.
        self.buf, self.starts, self.ends = padded(data, offsets, MATCH + 8, 0xFF)
        two = self.buf[:-1] | self.buf[1:].astype(np.uint16) << np.uint16(8)
        four = two[:-2] | two[2:].astype(np.uint32) << np.uint32(16)
        eight = four[:-4] | four[4:].astype(np.uint64) << np.uint64(32)
        sixteen = mix(eight[:-8] * _A + eight[8:])
        self.gram = mix(sixteen[:-8] * _B + eight[16:])
        self.long = mix(sixteen[:-16] * _C + sixteen[16:])  # 32 bytes

    def anchors(self) -> np.ndarray:
        """Places whose first bytes have the smallest hash within some string of MATCH bytes."""
        low = _sliding(self.gram, SIDE + 1, np.minimum)
        inside = np.zeros(len(self.buf) + 1, np.int32)
        whole = self.ends - self.starts >= MATCH
        inside[self.starts[whole]] += 1
        inside[self.ends[whole] - MATCH + 1] -= 1
        low[np.cumsum(inside)[: len(low)] == 0] = 0
        none = np.zeros(SIDE, np.uint64)
        high = _sliding(np.concatenate([none, low, none]), SIDE + 1, np.maximum)
        return np.flatnonzero((high == self.gram[: len(high)]) & (high > 0))

    def contexts(self, at: np.ndarray) -> np.ndarray:
        first = at - SIDE
        return mix(mix(self.long[first] * _D + self.long[first + 32]) * _E + self.long[first + 2 * MATCH - GRAM - 32])

    def strings(self, at: np.ndarray) -> np.ndarray:
        return mix(self.long[at] * _A + self.long[at + MATCH - 32])

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() over every `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[:-rest], x[rest:]) if rest else x


class IndexFamily:
    """Levels of suffix arrays; each holds every context once, with its smallest document."""

    def __init__(self):
        self.levels: list[Entries] = []

    def add(self, entries: Entries) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take in a batch; returns (document, context) pairs that a smaller document settles."""
        batch, settled = _sorted(entries)
        found = [settled]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[1], batch[1]), len(level[1]) - 1)
            hit = level[1][at] == batch[1]
            theirs, ours = level[2][at[hit]], batch[2][hit]
            differ = theirs != ours
            found.append((np.maximum(theirs, ours)[differ], batch[1][hit][differ]))
            level[2][at[hit]] = np.minimum(theirs, ours)
            batch = tuple(x[~hit] for x in batch)
        if len(batch[0]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self.levels.append(_merged(self.levels.pop(), self.levels.pop()))
        return [f for f in found if len(f[0])]

    def open_entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, context) of the contexts that share their first bytes with others."""
        if not self.levels:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gram, context, doc = (np.concatenate(x) for x in zip(*self.levels, strict=True))
        order = np.argsort(gram, kind="stable")
        equal = gram[order][1:] == gram[order][:-1]
        shared = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        return doc[order[shared]], context[order[shared]]


def _sorted(entries: Entries) -> tuple[Entries, tuple[np.ndarray, np.ndarray]]:
    """The first document of each context, in order of contexts; and the rest, each once."""
    gram, context, doc = entries
    order = np.lexsort((doc, context))
    gram, context, doc = gram[order], context[order], doc[order]
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    first = np.flatnonzero(new)
    lowest = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
    again = ~new & (doc != lowest)
    again[1:] &= ~((context[1:] == context[:-1]) & (doc[1:] == doc[:-1]))
    return (gram[first], context[first], doc[first].copy()), (doc[again], context[again])


def _merged(a: Entries, b: Entries) -> Entries:
    """Two sorted runs as one; the stable sort finds the runs and merges them."""
    order = np.argsort(np.concatenate([a[1], b[1]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


def _rows(to: np.ndarray, columns: tuple[np.ndarray, ...], kind: int, labels: np.ndarray) -> pa.RecordBatch:
    """One packed row per value of `to`, the place of a label, which names the task of the next
    shuffle: a bucket of entries, or a block of documents."""
    order = np.lexsort((columns[0], to))
    to, columns = to[order], tuple(c[order] for c in columns)
    first = np.flatnonzero(np.diff(to, prepend=-1))
    last = np.append(first[1:], len(to))
    label = pa.array(labels[to[first]])
    return pa.RecordBatch.from_arrays(
        [
            label,
            pa.array(np.full(len(first), kind, np.int32)),
            label,
            pa.array([pack(tuple(c[i:j] for c in columns)) for i, j in zip(first, last, strict=True)], pa.binary()),
        ],
        ["bucket", "kind", "block", "packed"],
    )


class Deal:
    """How entries and results are spread: entries over buckets, results over blocks."""

    def __init__(self, spark):
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.labels = np.array(even_blocks(spark, self.n), np.int32)

    def block(self, doc):
        return block_of(F.xxhash64(doc), self.labels.tolist())

    def pairs(self, doc: np.ndarray, keys: np.ndarray, kind: int) -> pa.RecordBatch:
        return _rows(xxhash64(doc) % self.n, (doc, keys), kind, self.labels)

    def entries(self, parts: Iterator[Entries], by: int, kind: int) -> Iterator[pa.RecordBatch]:
        """Pre-aggregated entries by bucket. Of a context that several documents of the batch
        have only the smallest goes on; the others are settled here, so a context that a third
        of all documents share costs one entry per batch."""
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries, settled = _sorted(tuple(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(settled[0]):
                yield self.pairs(*settled, kind)
            yield _rows((mix(entries[by]) % np.uint64(self.n)).astype(np.int64), entries, ENTRIES, self.labels)

        for part in parts:
            held.append(part)
            size += len(part[0])
            if size >= BATCH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def scan(self, batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
        """Feed what arrives to the family of this task; gives its settled and open pairs."""
        trim()
        family, held, size, done = IndexFamily(), [], 0, []

        def feed() -> None:
            done.extend(family.add(tuple(np.concatenate(x) for x in zip(*held, strict=True))))

        def settled() -> pa.RecordBatch:
            return self.pairs(*(np.concatenate(x) for x in zip(*done, strict=True)), kind)

        for batch in batches:
            kinds = batch.column(1).to_numpy()
            if (kinds != ENTRIES).any():
                yield batch.filter(pa.array(kinds != ENTRIES))
            for blob in batch.column(3).filter(pa.array(kinds == ENTRIES)):
                entries = unpack(blob.as_buffer(), 3)
                held.append((entries[0], entries[1], entries[2].view(np.int64)))
                size += len(held[-1][0])
                if size >= BATCH:
                    feed()
                    held, size = [], 0
                    if sum(len(d[0]) for d in done) >= 4 * BATCH:
                        yield settled()
                        done.clear()
        if size:
            feed()
        if done:
            yield settled()
        doc, keys = family.open_entries()
        if len(doc):
            yield self.pairs(doc, keys, OPEN)

    def round(self, spread: DataFrame, kind: int) -> DataFrame:
        return spread.repartition("bucket").mapInArrow(lambda batches: self.scan(batches, kind), ROUND_COLUMNS)


def _salt(doc: np.ndarray) -> np.ndarray:
    """Pairs are told apart by adding this to the key; equal sums of different pairs are as
    unlikely as equal hashes."""
    return mix(doc.view(np.uint64) + np.uint64(1))


class Pairs:
    """The (document, key) pairs of one block and kind."""

    def __init__(self, packed: pa.Table, kind: int):
        blobs = [b.as_py() for k, b in zip(packed.column("kind").to_pylist(), packed.column("packed"), strict=True) if k == kind]
        both = np.concatenate([unpack(b, 2) for b in blobs], axis=1) if blobs else np.zeros((2, 0), np.uint64)
        self.docs = np.unique(both[0].view(np.int64))
        self.sums = np.sort(both[1] + _salt(both[0]))

    def hold(self, doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.sums):
            return np.zeros(len(doc), bool)
        sums = keys + _salt(doc)
        return self.sums[np.minimum(np.searchsorted(self.sums, sums), len(self.sums) - 1)] == sums


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.is_null())


def repeated_strings(docs: DataFrame, deal: Deal) -> DataFrame:
    """Settled and open contexts, packed by block, from (doc_id long, text, ...)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[Entries]:
        trim()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, null = _ids(batch.column(0))
            for i, j in chunks(offsets, PART):
                s = Suffixes(data, offsets[i : j + 1])
                at = s.anchors()
                row = i + s.row(at)
                at, row = at[~null[row]], row[~null[row]]
                if len(at):
                    yield s.gram[at], s.contexts(at), ids[row]

    spread = docs.select("doc_id", "text").mapInArrow(lambda batches: deal.entries(entries(batches), 0, SETTLED), ROUND_COLUMNS)
    # Written once: the second round and the cut both read it.
    return stage(deal.round(spread, SETTLED), "suffixes")


def open_strings(texts: DataFrame, found: DataFrame, deal: Deal) -> DataFrame:
    """Settled strings, packed by block, for the contexts that stayed open."""

    def entries(left: pa.Table, opened: Pairs) -> Iterator[Entries]:
        data, offsets = utf8(left.column("text"))
        ids, null = _ids(left.column("doc_id"))
        touched = np.isin(ids, opened.docs) & ~null
        for i, j in chunks(offsets, PART):
            if not touched[i:j].any():
                continue
            s = Suffixes(data, offsets[i : j + 1])
            at = s.anchors()
            row = s.row(at)
            hit = touched[i + row] & opened.hold(ids[i + row], s.contexts(at))
            at, row = at[hit], row[hit]
            first = np.maximum(at - SIDE, s.starts[row])
            last = np.minimum(at, s.ends[row] - MATCH)
            n = np.maximum(last - first + 1, 0)
            place = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            if len(place):
                yield np.zeros(len(place), np.uint64), s.strings(place), ids[i + s.row(place)]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        opened = Pairs(right, OPEN)
        rows = list(deal.entries(entries(left, opened), 1, STRINGS)) if len(opened.docs) else []
        return pa.Table.from_batches(rows, _ROUND_SCHEMA)

    opened = found.where(F.col("kind") == OPEN).repartition(deal.n, "block")
    spread = texts.groupBy("block").cogroup(opened.groupBy("block")).applyInArrow(work, ROUND_COLUMNS)
    return deal.round(spread, STRINGS).where(F.col("kind") == STRINGS)


_ROUND_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("packed", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The other columns of `docs` with n_bytes, kept (binary) and spans, the removed runs as
    [start, end) byte offsets. Columns named like the results are replaced. The texts of a
    block, one part in spark.sql.shuffle.partitions of all, meet their results in one task."""
    added = ("n_bytes", "kept", "spans")
    others = [c for c in docs.columns if c not in (id_col, text_col, *added)]
    deal = Deal(docs.sparkSession)
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        *[F.col(f"`{c}`").alias(f"_other_{i}") for i, c in enumerate(others)],
    )
    # This shuffle serves both the second round and the cut.
    texts = base.withColumn("block", deal.block(F.col("doc_id"))).repartition(deal.n, "block")
    found = repeated_strings(base, deal)
    strings = open_strings(texts, found, deal)
    settled = found.where(F.col("kind") == SETTLED).unionByName(strings).repartition(deal.n, "block")
    results = StructType.fromDDL("n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    kind = StructType([f for f in base.schema.fields if f.name != "text"] + results.fields)
    cut = texts.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(_cut, kind)
    names = [F.col("doc_id").alias(id_col), *[F.col(f"_other_{i}").alias(c) for i, c in enumerate(others)]]
    return cut.select(*names, *added)


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    trim()
    contexts, strings = Pairs(right, SETTLED), Pairs(right, STRINGS)
    data, offsets = utf8(left.column("text"))
    ids, null = _ids(left.column("doc_id"))
    in_contexts, in_strings = np.isin(ids, contexts.docs) & ~null, np.isin(ids, strings.docs) & ~null
    kept, spans = [], []
    for i, j in chunks(offsets, PART):
        at = offsets[i : j + 1]
        if not (in_contexts[i:j] | in_strings[i:j]).any():
            kept += [data[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
            spans += [[]] * (j - i)
            continue
        s = Suffixes(data, at)
        gone = np.zeros(len(s.buf) + 1, np.int32)
        place = s.anchors()
        row = s.row(place)
        hit = in_contexts[i + row] & contexts.hold(ids[i + row], s.contexts(place))
        np.add.at(gone, np.maximum(place[hit] - SIDE, s.starts[row[hit]]), 1)
        np.add.at(gone, np.minimum(place[hit] + MATCH, s.ends[row[hit]]), -1)
        n = np.where(in_strings[i:j], np.maximum(s.ends - s.starts - MATCH + 1, 0), 0)
        place = np.repeat(s.starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(place):
            hit = strings.hold(ids[i + s.row(place)], s.strings(place))
            np.add.at(gone, place[hit], 1)
            np.add.at(gone, place[hit] + MATCH, -1)
        removed = np.cumsum(gone[:-1]) > 0
        for a, b in zip(s.starts, s.ends, strict=True):
            flags = removed[a:b]
            if not flags.any():
                kept.append(s.buf[a:b].tobytes())
                spans.append([])
                continue
            kept.append(s.buf[a:b][~flags].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
    others = [n for n in left.column_names if n not in ("text", "block")]
    return pa.table(
        [
            *[left.column(n) for n in others],
            pa.array(np.diff(offsets)),
            pa.array(kept, pa.binary()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ],
        names=[*others, "n_bytes", "kept", "spans"],
    )
