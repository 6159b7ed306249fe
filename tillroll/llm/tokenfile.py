"""Token ids of a corpus in binary segments, packed by Simple-8b.

A 64-bit word has a selector in its upper four bits and, in the other sixty, as many ids as the
selector says, the first in the lowest bits. Ids are cut into blocks of BLOCK; a block begins
with a word of its own, and a segment lists the first word of every block, so that any range of
ids is decoded without what lies before it, and all words of a range at once. An id of more
than sixty bits is an escape: a word with selector ESCAPE that names its place in a list of
whole 64-bit values.

A segment, little-endian: MAGIC; ids, documents, words, escapes and ids of a block as 64-bit
numbers; per document its id, its number of ids (64 bits each) and whether it has an id (8
bits); per block the number of its first word (64 bits); the words; the escapes.

Segments hold whole documents in ascending order of their ids. They are rows of a Parquet table
(part, seq, first, n_ids, n_docs, segment), because a table is what Spark commits as a whole to
any store: ordered by (part, seq) the segments make up the file, `first` being the number of ids
before a segment in its part."""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.bytes import chunks

MAGIC = b"S8BIDS01"
_HEAD = struct.Struct("<8s5q")
BLOCK = 4096
ESCAPE = 0
#: Ids per word, by selector from 1 on; each has 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // c for c in COUNTS)
_PER_WORD = np.array([1, *COUNTS, 0], np.int64)  # selector 15 is not used

SEGMENT = 1 << 20  # ids from which on a segment is closed
SLICE = 1 << 23  # bytes of text encoded at a time
KNOWN = 1 << 20  # words that a worker remembers
JOINED = 100  # words encoded as one text
_BETWEEN = "\0"

SEGMENTS = "part int, seq int, first long, n_ids long, n_docs int, segment binary"


# --- Simple-8b


def _selectors(blocks: np.ndarray) -> np.ndarray:
    """For every place of every block the selector that takes the most ids from there on. What
    lies behind a block counts as zeros."""
    bits = np.frexp(blocks.astype(np.float64))[1].astype(np.uint8)
    chosen = np.zeros((len(blocks), BLOCK), np.uint8)
    widest, n = bits, 1
    for selector in range(len(COUNTS), 0, -1):
        count = COUNTS[selector - 1]
        if count > n:
            # The widest of `count` ids, out of two overlapping runs of n.
            widest, n = np.maximum(widest[:, : widest.shape[1] - (count - n)], widest[:, count - n :]), count
        np.putmask(chosen, widest[:, :BLOCK] <= BITS[selector - 1], np.uint8(selector))
    return chosen


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of every block, escapes) of unsigned ids of up to 64 bits."""
    n_blocks = -(-len(ids) // BLOCK)
    width = BLOCK + COUNTS[0]
    blocks = np.zeros((n_blocks, width), np.uint64)
    full = len(ids) // BLOCK
    blocks[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    ends = np.full(n_blocks, BLOCK)
    if full < n_blocks:
        ends[-1] = len(ids) - full * BLOCK
        blocks[-1, : ends[-1]] = ids[full * BLOCK :]
    chosen = _selectors(blocks)
    # All blocks step from word to word at once: the places of the n-th words of all blocks.
    row, place, steps = np.arange(n_blocks), np.zeros(n_blocks, np.int64), []
    n_words = np.zeros(n_blocks, np.int64)
    while len(row):
        selector = chosen[row, place]
        steps.append((row, place, selector))
        n_words[row] += 1
        place = place + _PER_WORD[selector]
        on = place < ends[row]
        row, place = row[on], place[on]
    firsts = np.cumsum(n_words) - n_words
    words = np.zeros(int(n_words.sum()), np.uint64)
    at, selector = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8)
    for step, (row, place, chosen_here) in enumerate(steps):
        at[firsts[row] + step], selector[firsts[row] + step] = row * width + place, chosen_here
    flat = blocks.reshape(-1)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        of = np.flatnonzero(selector == s)
        packed, start = np.full(len(of), s << 60, np.uint64), at[of]
        for i in range(count if len(of) else 0):
            packed |= flat[start + i] << np.uint64(bits * i)
        words[of] = packed
    of = np.flatnonzero(selector == ESCAPE)
    words[of] = np.arange(len(of), dtype=np.uint64)
    return words, firsts, flat[at[of]]


def decode(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first `n` ids of whole blocks; `firsts` are their first words, from 0 on."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _PER_WORD[selector]
    before = np.cumsum(count) - count
    starts = np.zeros(len(words), np.int64)
    starts[firsts] = 1
    block = np.cumsum(starts) - 1
    width = BLOCK + COUNTS[0]
    place = block * width + before - before[firsts][block]
    out = np.zeros(len(firsts) * width, np.uint64)
    for s, (per, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        at = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for i in range(per if len(at) else 0):
            out[place[at] + i] = (words[at] >> np.uint64(bits * i)) & mask
    at = np.flatnonzero(selector == ESCAPE)
    out[place[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out.reshape(-1, width)[:, :BLOCK].reshape(-1)[:n]


# --- segments


def write_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A segment of documents with these ids, `counts` of them each."""
    words, firsts, escapes = encode(ids)
    return b"".join(
        [
            _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(words), len(escapes), BLOCK),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(counts, "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            firsts.astype("<i8").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        ]
    )


class Segment:
    def __init__(self, data: bytes):
        magic, self.n_ids, n_docs, n_words, n_escapes, block = _HEAD.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a segment of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.counts, known = take("<i8", n_docs), take("<i8", n_docs), take("u1", n_docs)
        self.no_id = known == 0
        self.firsts = take("<i8", -(-self.n_ids // BLOCK))
        self.words, self.escapes = take("<u8", n_words), take("<u8", n_escapes)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids [first, last), out of the blocks that hold them only."""
        last = self.n_ids if last is None else last
        if first >= last:
            return np.zeros(0, np.uint64)
        a, b = first // BLOCK, -(-last // BLOCK)
        end = self.firsts[b] if b < len(self.firsts) else len(self.words)
        words, firsts = self.words[self.firsts[a] : end], self.firsts[a:b] - self.firsts[a]
        return decode(words, firsts, self.escapes, last - a * BLOCK)[first - a * BLOCK :]


# --- texts to segments and back


@lru_cache(2)
def _words(path: str) -> "Words":
    """One for all tasks of a worker."""
    return Words(path)


class Words:
    """Ids of texts, word by word: every distinct word is encoded once.

    The tokenizer must drop white space, so that no token spans it: what lies between ASCII
    blanks is then encoded alike alone and in its text. Other white space stays within such a
    word and is left to the tokenizer. New words are encoded JOINED at a time, with a word
    between them whose one id tells where they end. Known words lie in arrays; once they are
    more than KNOWN, only those of the texts at hand are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._between = self._list([_BETWEEN])[0]
        self.known = pa.array([], pa.string())
        self._sizes, self._ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _list(self, texts: list[str]) -> list[list[int]]:
        return [done.ids for done in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all)."""
        sizes, flat = [self._sizes[:0]], [self._ids[:0]]
        lots = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for lot, ids in zip(lots, self._list([f" {_BETWEEN} ".join(lot) for lot in lots]), strict=True):
            found = np.frombuffer(array("I", [*ids, *self._between]), np.uint32)
            inside = found != self._between[0]
            ends = np.flatnonzero(~inside)
            if len(self._between) == 1 and len(ends) == len(lot):
                sizes.append((np.diff(ends, prepend=-1) - 1).astype(np.int32))
                flat.append(found[inside])
            else:  # one of the words holds what is put between them
                own = self._list(lot)
                sizes.append(np.array([len(o) for o in own], np.int32))
                flat += [np.array(o, np.uint32) for o in own]
        return np.concatenate(sizes), np.concatenate(flat)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct words lie among the known ones; new ones are added."""
        found = pc.index_in(words, value_set=self.known)
        places = pc.fill_null(found, 0).to_numpy().copy()
        is_new = pc.is_null(found)
        new = words.filter(is_new)
        sizes, ids = self._new(new.to_pylist())
        places[is_new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self._sizes, self._ids = np.concatenate((self._sizes, sizes)), np.concatenate((self._ids, ids))
        if len(self.known) > KNOWN:
            self._ids = self._take(places)
            self.known, self._sizes = words, self._sizes[places]
            places = np.arange(len(words), dtype=places.dtype)
        return places

    def _take(self, places: np.ndarray) -> np.ndarray:
        """The ids of known words, one after another."""
        firsts = np.cumsum(self._sizes, dtype=np.int32) - self._sizes
        sizes = self._sizes[places]
        total = np.cumsum(sizes, dtype=np.int64)
        shift = firsts[places] - (total - sizes)
        return self._ids[np.repeat(shift, sizes) + np.arange(total[-1] if len(total) else 0)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end; number of ids per text); null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        places = self._places(words.dictionary)[words.indices.to_numpy()]
        total = np.concatenate(([0], np.cumsum(self._sizes[places], dtype=np.int64)))
        ends = total[np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)]
        ids = np.insert(self._take(places), ends, end_id)
        return ids, np.diff(ends, prepend=0) + 1


def _segments(tokenizer_path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _words(tokenizer_path), TaskContext.get().partitionId()
        seq = first = n = 0
        doc_ids, counts, held = [], [], []

        def closed() -> pa.RecordBatch:
            blob = write_segment(doc_ids, counts, np.concatenate(held))
            row = {"part": part, "seq": seq, "first": first, "n_ids": n, "n_docs": len(doc_ids), "segment": blob}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            for a, b in chunks(np.concatenate(([0], np.cumsum(sizes))), SLICE):
                ids, own = words.encode(texts.slice(a, b - a), end_id)
                doc_ids += names.slice(a, b - a).to_pylist()
                counts += own.tolist()
                held.append(ids)
                n += len(ids)
                if n >= SEGMENT:
                    yield closed()
                    seq, first, n = seq + 1, first + n, 0
                    doc_ids, counts, held = [], [], []
        if doc_ids:
            yield closed()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Write the token ids of whole texts, `end_id` after each, in ascending order of doc_id.

    A null text is empty and has its end only; null ids come first; equal ids are ordered by
    a hash of their texts. No documents make a table without segments. Other columns than
    doc_id and text are not looked at. The tokenizer must drop white space (see Words). Texts
    move once, to the range of ids they belong to; a segment takes memory for its ids, which
    for one very long text are its own."""
    rows = docs.select("doc_id", "text").withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    in_order = rows.orderBy("doc_id", "_hash", "_row").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    in_order.mapInArrow(_segments(tokenizer_path, end_id), SEGMENTS).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def _read(kind: str, values: Callable[[np.ndarray], object]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, blob in zip(*[batch.column(c) for c in ("part", "first", "segment")], strict=True):
                segment = Segment(blob.as_py())
                ids, ends = segment.ids(), np.cumsum(segment.counts)
                starts = ends - segment.counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), part.as_py(), np.int32)),
                        pa.array(segment.doc_ids, pa.int64(), mask=segment.no_id),
                        pa.array(starts + first.as_py()),
                        pa.array(segment.counts),
                        pa.array([values(ids[a:b]) for a, b in zip(starts, ends, strict=True)], kind),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "found"],
                )

    return run


def _documents(segments: DataFrame, name: str, sql_kind: str, kind: pa.DataType, values: Callable) -> DataFrame:
    """One row per document of the segments; `start` counts the ids of all documents before it."""
    rows = segments.select("part", "first", "segment").mapInArrow(
        _read(kind, values), f"part int, doc_id long, start long, n_tokens long, found {sql_kind}"
    )
    # One row per part, that is per task that wrote segments: few enough to add up in one task.
    parts = segments.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", F.col("found").alias(name)
    )


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, in no order of rows."""
    return _documents(segments, "ids", "array<long>", pa.list_(pa.int64()), lambda ids: ids.astype(np.int64))


def read_digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of the ids as little-endian
    unsigned 32-bit numbers."""
    return _documents(segments, "ids_crc32", "long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4")))
