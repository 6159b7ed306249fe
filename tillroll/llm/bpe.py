"""Byte-level BPE: every distinct word is encoded once, by folding ranked merges over its bytes.

Texts are dealt over blocks. The words of each block, each once, are gathered by word, so a
word is encoded once for all texts: a fold over its bytes merges the pair with the lowest rank
until none is left, with the ranks in literal maps. The encoded words go back to the blocks
that have them, where the texts are put together. Decoding looks up the bytes of every id in a
literal array and concatenates them.

Bytes are written as characters of ISO-8859-1 in the expressions. A word is a match of the
pattern; blanks are those of Unicode. The tables are those of the given file, so their size
does not grow with the data.

Null texts are empty and have no ids; repeated rows and null ids are kept; an empty table
gives no rows; other columns stay, those named like the results are replaced."""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.llm.blocks import block_of, even_blocks
from tillroll.llm.bytes import trim

RESULTS = "n_tokens long, ids string, decoded binary"
_NO_RANK = 1 << 30
# Ids are sent less this number, so that those of up to 65,536 tokens take two bytes.
_SHORT = 1 << 15
_BYTES = "ISO-8859-1"
LONG = 256  # bytes of a word from which on all pairs of one rank are merged in a step
LOT = 8 << 20  # bytes of texts packed at a time
PART = 4 << 20  # bytes of texts cut or put together at a time
LEVEL = 6  # of compression


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """{token: rank} of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that `body` uses several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Numbers:
    """Whole numbers as one binary literal: decimal digits of one width, read where they lie. All
    uses in a plan share its bytes."""

    def __init__(self, numbers: list[int]):
        self.width = len(str(max(numbers)))
        if self.width > 18:
            raise ValueError("numbers of up to 18 digits can be read")
        self.literal = F.lit("".join(str(n).zfill(self.width) for n in numbers).encode())

    def at(self, place: Column) -> Column:
        start = (place * self.width + 1).cast("int")
        return F.substring(self.literal, start, F.lit(self.width)).cast("string").cast("bigint")


class RankTable:
    """The rank map as literals. A pair of ids leads to the id of both joined, which is its
    rank. Spark searches a literal map from its start, so the map is laid out over flat tables
    without collisions: the pairs of a bucket are moved by the bucket's offset to free slots."""

    BUCKETS, SLOTS, PAIR, SPREADS = 65_521, 1 << 17, 1_000_003, range(1_299_709, 1_299_909, 2)

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values())
        self.base = 10 ** len(str(top + 1))
        pieces = [b""] * (top + 1)
        buckets: dict[int, list[tuple[int, int]]] = {}  # of (pair, code)
        for token, rank in ranks.items():
            pieces[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pair = (left + 1) * self.PAIR + right + 1
                    code = ((left + 1) * self.base + right + 1) * self.base + rank
                    buckets.setdefault(pair % self.BUCKETS, []).append((pair, code))
        self.spread = next(s for s in self.SPREADS if self._fits(buckets, s))
        codes, offsets = [0] * self.SLOTS, [0] * self.BUCKETS
        free = bytearray(b"\1" * self.SLOTS)
        for bucket in sorted(buckets, key=lambda b: -len(buckets[b])):
            at = [pair % self.spread for pair, _ in buckets[bucket]]
            # One pair goes to any free slot.
            tried = ((free.index(1) - at[0]) % self.SLOTS,) if len(at) == 1 else range(self.SLOTS)
            offset = next(d for d in tried if all(free[(a + d) % self.SLOTS] for a in at))
            offsets[bucket] = offset
            for a, (_, code) in zip(at, buckets[bucket], strict=True):
                slot = (a + offset) % self.SLOTS
                free[slot], codes[slot] = 0, code
        self.codes, self.offsets = Numbers(codes), Numbers(offsets)
        self.of_byte = F.array(*[F.lit(ranks[bytes([b])]) for b in range(256)])
        longest = max(map(len, pieces)) + 1
        starts = [0]
        for piece in pieces:
            starts.append(starts[-1] + len(piece))
        self.longest, self.pieces = longest, F.lit(b"".join(pieces))
        self.spans = Numbers([s * longest + len(p) for s, p in zip(starts, pieces)])

    def _fits(self, buckets: dict[int, list[tuple[int, int]]], spread: int) -> bool:
        """No two pairs of a bucket fall into one slot."""
        return all(len({p % spread % self.SLOTS for p, _ in own}) == len(own) for own in buckets.values())

    def rank(self, left: Column, right: Column) -> Column:
        """_NO_RANK if there is no such pair, or no right one."""

        def found(pair: Column) -> Column:
            slot = (pair % self.spread + self.offsets.at(pair % self.BUCKETS)) % self.SLOTS
            same = ((left.cast("bigint") + 1) * self.base + right + 1) * self.base
            return _let(self.codes.at(slot), lambda code: F.when(code - code % self.base == same, code % self.base))

        pair = (left.cast("bigint") + 1) * self.PAIR + right + 1
        return F.coalesce(_let(pair, found).cast("int"), F.lit(_NO_RANK))

    def bytes_of(self, token: Column) -> Column:
        """The bytes of an id, as characters of ISO-8859-1."""

        def cut(span: Column) -> Column:
            size = span % self.longest
            return F.substring(self.pieces, ((span - size) / self.longest + 1).cast("int"), size.cast("int"))

        return F.decode(_let(self.spans.at(token), cut), _BYTES)


def encode_word(word: Column, table: RankTable) -> Column:
    """array<int>: the ids of one word. The state of the fold are the ids of the parts, for each
    part the rank of its pair with the next one, and the lowest of these ranks."""
    as_bytes = F.decode(F.encode(word, "UTF-8"), _BYTES)
    chars = F.filter(F.split(as_bytes, ""), lambda b: b != "")
    parts = F.transform(chars, lambda b: F.get(table.of_byte, F.ascii(b)))

    def state_of(p: Column, r: Column) -> Column:
        return _let(r, lambda x: F.struct(p.alias("p"), x.alias("r"), F.coalesce(F.array_min(x), F.lit(_NO_RANK)).alias("least")))

    def with_ranks(p: Column) -> Column:
        """A part past the end is null and so has no rank."""
        return state_of(p, F.transform(p, lambda x, i: table.rank(x, F.get(p, i + 1))))

    def merge_first(state: Column) -> Column:
        """The first pair with the lowest rank becomes one part; only the ranks of its two new
        pairs are looked up."""
        p, r, joined = state["p"], state["r"], state["least"]

        def at(m: Column) -> Column:
            def new_rank(x: Column, i: Column) -> Column:
                first = F.when(i == m, joined).otherwise(F.get(p, i))
                second = F.when(i == m, F.get(p, m + 2)).otherwise(joined)
                return F.when((i == m) | (i == m - 1), table.rank(first, second)).otherwise(x)

            left = F.filter(p, lambda x, i: i != m + 1)
            ranks = F.filter(r, lambda x, i: i != m + 1)
            return state_of(F.transform(left, lambda x, i: F.when(i == m, joined).otherwise(x)), F.transform(ranks, new_rank))

        return _let(F.array_position(r, joined).cast("int") - 1, at)

    def merge_all(state: Column) -> Column:
        """All pairs with the lowest rank become one part each, of overlapping ones the first. A
        part made of them only has pairs of higher rank, so this is what merging them one by one
        comes to, in as many steps as there are ranks."""
        p, r, joined = state["p"], state["r"], state["least"]
        flags = F.array_join(F.transform(r, lambda x: F.when(x == joined, "1").otherwise("0")), "")

        def chosen(marks: Column) -> Column:
            def here(i: Column) -> Column:
                return F.substring(marks, i + 1, F.lit(1)) == F.lit(b"1")

            def gone(i: Column) -> Column:
                return (i > 0) & here(F.greatest(i, F.lit(1)) - 1)

            def part(x: Column, i: Column) -> Column:
                return F.when(gone(i), F.lit(None)).when(here(i), joined).otherwise(x)

            def rank(x: Column, i: Column) -> Column:
                after = F.when(here(i), i + 2).otherwise(i + 1)
                first = F.when(here(i), joined).otherwise(F.get(p, i))
                second = F.when(here(after), joined).otherwise(F.get(p, after))
                changed = here(i) | here(after)
                return F.when(gone(i), F.lit(None)).when(changed, table.rank(first, second)).otherwise(x)

            return state_of(F.array_compact(F.transform(p, part)), F.array_compact(F.transform(r, rank)))

        return _let(F.regexp_replace(flags, "11", "10").cast("binary"), chosen)

    # Steps copy the parts. The first merge costs less a step, the second takes fewer.
    merged = lambda state: F.when(F.octet_length(word) > LONG, merge_all(state)).otherwise(merge_first(state))
    step = lambda state, _: F.when(state["least"] < _NO_RANK, merged(state)).otherwise(state)
    rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    return F.aggregate(rounds, _let(parts, with_ranks), step, lambda s: s["p"])


def decode_ids(ids: Column, table: RankTable) -> Column:
    """binary: the bytes of the ids, joined."""
    return F.encode(F.array_join(F.transform(ids, table.bytes_of), ""), _BYTES)


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The word pattern, with \s as the blanks of Unicode."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _escaped(char: str) -> str:
    return f"\\U{ord(char):08x}"


@lru_cache(4)
def plain_pattern(pattern: str) -> re.Pattern | None:
    r"""split_pattern() for texts of the first 65,536 code points, for `re`, which is twice as fast:
    \p{L}, \p{N} and blanks are spelled out. None if the pattern has other classes or options."""
    first = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    # White_Space first: what is neither letter nor number ends in it most often.
    spelled = {c: "".join(f"{_escaped(r[0])}-{_escaped(r[-1])}" for r in regex.findall(f"{c}+", first)) for c in (r"\p{White_Space}", r"\p{L}", r"\p{N}")}
    short = {r"\s": spelled[r"\p{White_Space}"], r"\p{L}": spelled[r"\p{L}"], r"\p{N}": spelled[r"\p{N}"]}
    out, inside = [], False
    for piece in re.findall(r"\\p\{\w+\}|\\.|\(\?!|\(\?.|.", pattern, re.DOTALL):
        if piece in short:
            out.append(short[piece] if inside else f"[{short[piece]}]")
        elif piece == r"\S" and not inside:
            out.append(f"[^{short[chr(92) + 's']}]")
        elif len(piece) > 1 and piece != "(?!" or inside and piece in "[&~|-":
            return None
        else:
            inside = piece == "[" or inside and piece != "]"
            out.append(piece)
    return re.compile("".join(out))


class Cutter:
    """Finds what split_pattern() finds, by plain_pattern() where it may."""

    def __init__(self, pattern: str):
        self.whole, plain = split_pattern(pattern), plain_pattern(pattern)
        self.plain = self.whole if plain is None or plain.groups else plain

    def findall(self, text: str) -> list[str]:
        # Code points beyond the first 65,536 take four bytes here.
        low = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.plain if low else self.whole).findall(text)


def _decimal(lists: pa.Array) -> pa.Array:
    """Every list of ids as decimal numbers with spaces between them."""
    numbers = pc.cast(pc.add(pc.cast(lists.flatten(), pa.int32()), _SHORT), pa.string())
    offsets = pc.subtract(lists.offsets, lists.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, numbers), " ")


def _cut(texts: list[str], cut: regex.Pattern | Cutter) -> tuple[pa.Array, pa.Array]:
    """Per text its words, joined, and their lengths: a byte each, after as many 255 as fit."""
    found = [cut.findall(t) for t in texts]
    ends = np.cumsum([0, *map(len, found)])
    words = pa.array(itertools.chain.from_iterable(found), pa.string(), size=int(ends[-1]))
    lengths = pc.binary_length(words).to_numpy()
    last = np.concatenate(([0], np.cumsum(lengths // 255 + 1)))
    cuts = np.full(last[-1], 255, np.uint8)
    cuts[last[1:] - 1] = lengths % 255
    return (
        pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), words), ""),
        pa.ListArray.from_arrays(last[ends].astype(np.int32), pa.array(cuts)),
    )


def _pack(pattern: str) -> Callable:
    """Rows with a block to (block, blob): what a task has for a block, compressed, some LOT bytes
    of all blocks at a time. Texts are cut into words here, once."""

    def packed(held: list[pa.RecordBatch], cut: Cutter) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        step = max(1, int(rows.num_rows * PART / max(rows.nbytes, 1)))
        parts = [_cut(rows.column("text").slice(a, step).to_pylist(), cut) for a in range(0, rows.num_rows, step)]
        text, cuts = (pa.chunked_array(list(c)).combine_chunks() for c in zip(*parts, strict=True))
        rows = rows.drop_columns("text").append_column("text", text).append_column("cuts", cuts)
        blocks, firsts = np.unique(rows.column("block").to_numpy(), return_index=True)
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        for block, a, b in zip(blocks, firsts, [*firsts[1:], rows.num_rows], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_table(rows.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, cut = [], 0, Cutter(pattern)
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > LOT:
                yield from packed(held, cut)
                held, size = [], 0
        if size:
            yield from packed(held, cut)
        del held
        trim()

    return run


def _words(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(words of packed rows, one after another; where each row's end): the bytes of the texts as
    they are, with other offsets."""
    text, cuts = rows.column("text").combine_chunks(), rows.column("cuts").combine_chunks()
    _, offsets, data = text.buffers()
    flat = cuts.flatten().to_numpy()
    last = flat < 255
    total = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
    at = np.concatenate(([0], total[1:][last])) + np.frombuffer(offsets, np.int32)[text.offset]
    rows_end = np.concatenate(([0], np.cumsum(pc.list_value_length(cuts).to_numpy())))
    ends = np.concatenate(([0], np.cumsum(last)))[rows_end].astype(np.int32)
    at = at.astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data or pa.py_buffer(b"")), ends


def _unpack(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """The other columns of `docs` with n_tokens, ids (decimal, joined by spaces) and decoded,
    the bytes that the ids stand for. A block's texts and words are one task's memory: give
    `blocks` (by default a third of the shuffle partitions: a word is sent once to every block
    that has it) for tens of megabytes each. Equal texts are
    told apart by their id, so copies spread over the blocks."""
    spark = docs.sparkSession
    # Printed plans hold their literals in full, and the driver keeps every printed plan.
    spark.conf.set("spark.sql.maxPlanStringLength", "100000")
    n = blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    table = RankTable(ranks)
    trim()
    added = ("n_tokens", "ids", "decoded")
    others = [c for c in docs.columns if c not in (text_col, *added)]
    named = docs.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`").alias(f"_other_{i}") for i, c in enumerate(others)],
    )
    block = block_of(F.xxhash64("text", F.col(f"_other_{others.index(id_col)}")), even_blocks(spark, n))
    # This shuffle serves both the gathering of the words and the texts themselves.
    dealt = named.withColumn("block", block)
    texts = dealt.mapInArrow(_pack(pattern), "block int, blob binary").repartition(n, "block")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        seen: dict[int, list[pa.Array]] = {}
        for batch in batches:
            for blob, block in zip(batch.column("blob"), batch.column("block").to_pylist(), strict=True):
                found = seen.setdefault(block, [])
                found.append(_words(_unpack(blob))[0].unique())
                if sum(map(len, found[1:])) > len(found[0]):
                    seen[block] = [pa.concat_arrays(found).unique()]
        for block, found in seen.items():
            distinct = pa.concat_arrays(found).unique()
            for i in range(0, len(distinct), 10_000):
                part = distinct.slice(i, 10_000)
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), block, np.int32))], ["word", "block"])

    gathered = texts.mapInArrow(words, "word string, block int").groupBy("word").agg(F.collect_list("block").alias("blocks"))
    encoded = gathered.select("word", "blocks", encode_word(F.col("word"), table).alias("ids"))
    written = encoded.select(
        F.explode("blocks").alias("block"),
        "word",
        F.transform("ids", lambda i: (i - _SHORT).cast("smallint" if max(ranks.values()) < 2 * _SHORT else "int")).alias("ids"),
        decode_ids(F.col("ids"), table).alias("bytes"),
    )
    # The decoded bytes are nearly always those of the word and then need not be sent.
    sent = written.withColumn("bytes", F.when(F.col("bytes") != F.encode("word", "UTF-8"), F.col("bytes"))).repartition(n, "block")
    fields = [dealt.schema[f"_other_{i}"] for i in range(len(others))]
    kind = StructType([*fields, *StructType.fromDDL(RESULTS).fields])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        known, ids = (right.column(c).combine_chunks() for c in ("word", "ids"))
        # What a word's ids decode to is sent where it is not the word itself.
        meant = pc.coalesce(right.column("bytes").combine_chunks(), known.cast(pa.binary()))
        spelled, sizes = _decimal(ids), pc.list_value_length(ids).to_numpy()
        done, held, size = [], [], 0
        blobs = left.column("blob")

        def put_together(rows: pa.Table) -> pa.Table:
            found, offsets = _words(rows)
            found = found.dictionary_encode()
            place = pc.index_in(found.dictionary, value_set=known).take(found.indices)
            total = np.concatenate(([0], np.cumsum(sizes[place.to_numpy()]) if len(place) else np.zeros(0, np.int64)))
            joined, decoded = (
                pc.binary_join(pa.ListArray.from_arrays(offsets, of.take(place)), between)
                for of, between in ((spelled, " "), (meant, b""))
            )
            columns = [rows.column(f"_other_{i}") for i in range(len(others))]
            columns += [pa.array(np.diff(total[offsets])), joined, decoded]
            return pa.table(columns, names=[f.name for f in kind.fields])

        for i, blob in enumerate(blobs):
            held.append(_unpack(blob))
            size += held[-1].nbytes
            if size > PART or i == len(blobs) - 1:
                rows, held, size = pa.concat_tables(held), [], 0
                step = max(1, int(rows.num_rows * PART / max(rows.nbytes, 1)))
                for a in range(0, rows.num_rows, step):
                    done.append(put_together(rows.slice(a, step)))
                trim()
        return pa.concat_tables(done) if done else pa.table([[]] * len(kind.fields), names=[f.name for f in kind.fields])

    whole = texts.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(assemble, kind)
    return whole.select(*[F.col(f"_other_{i}").alias(c) for i, c in enumerate(others)], *added)
