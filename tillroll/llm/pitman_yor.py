"""A hierarchical Pitman-Yor language model and the scores of texts under it.

Restaurants: one per context, which is the previous token, all with one parent, the restaurant
of single tokens, whose base is uniform. Tables are seated by Gibbs sampling: a sweep takes the
customers of every (context, token) block out and seats them again, given the tables of all
others; probabilities are averaged over the sweeps after the first.

Blocks lie in buckets by their token, so a token's parent restaurant is in one task. Customers
and tables per context are a distributed table: each bucket sends the sums of its contexts to
the buckets of the contexts, which add them up and answer with the totals. Only sums over all
restaurants reach the driver. A task repeats the earlier sweeps with the seeds and totals they
had instead of storing its tables.

To be scored, a batch of texts asks once for each of its distinct (context, token) pairs, so a
frequent token costs one row per context and batch, and none is too large for a task.

Tokens are words in lower case (A-Z) and one end token per text. A token is its 64-bit hash.
Null texts have the end token only; repeated rows count and are scored like any others; an
empty table gives no rows; other columns are not read. Without training rows every token has
the base probability."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import blocks
from tillroll.llm.blocks import even_blocks
from tillroll.llm.bytes import BLANK, LOWER, chunks, padded, run_hashes, runs, utf8
from tillroll.sources.shared import stage

SWEEPS, BURN_IN = 4, 1
THETA, THETA_PARENT = 1.0, 1.0
SEED = 11
# Tokens of one map task that are packed together.
BATCH = 1_000_000
# Up to so many customers of a block are seated one by one; then a sixteenth of those seated
# so far at a time, who find nearly the same tables.
ONE_BY_ONE = 64
# Bits of a key that number the context inside a bucket.
WIDTH = 32
_END = np.uint64(0x51ED270B9F8C3A00)


@dataclass
class Totals:
    """Customers per context, distinct tokens, discounts; and per sweep the tables per context,
    the tables of the parent and the tables of all contexts (None: the given contexts are all)."""

    customers: np.ndarray
    distinct: int
    discount: float
    discount_parent: float
    tables: list[np.ndarray]
    parent_tables: list[float]
    all_tables: list[float] | None = None


def pack(columns: tuple[np.ndarray, ...]) -> bytes:
    """Packed columns, compressed before the JVM has to hold them."""
    plain = blocks.pack(columns)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(blob: pa.Buffer, n: int) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return blocks.unpack(pa.decompress(blob[8:], decompressed_size=size, codec="zstd"), n)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, row) of every token."""
    buf, starts, _ = padded(data, offsets, 1, 0x0A)
    first, last = runs(~BLANK[buf])
    n = len(starts)
    row = np.concatenate([np.searchsorted(starts, first, "right") - 1, np.arange(n)])
    token = np.concatenate([run_hashes(LOWER[buf], first, last), np.full(n, _END)])
    order = np.argsort(row, kind="stable")  # the end token after the words of its text
    row, token = row[order], token[order]
    return token, np.concatenate([[_END], token[:-1]]), row


def _bucket(token: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the upper bits: tokens in order are in order of buckets, too."""
    return (((token >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _cut(token: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted tokens."""
    of = _bucket(token, n)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(token)).tolist(), strict=True)


def _batches(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Lists of (batch, from, to) with all tokens, contexts and rows of their texts, about `size` tokens."""
    held, found, n, count = [], [], 0, 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in chunks(offsets):
            token, context, row = _tokens(data, offsets[i : j + 1])
            held.append((batch, i, j))
            found.append((token, context, row + n))
            n, count = n + j - i, count + len(token)
            if count >= size:
                yield held, *map(np.concatenate, zip(*found, strict=True))
                held, found, n, count = [], [], 0, 0
    if held:
        yield held, *map(np.concatenate, zip(*found, strict=True))


def _pairs(token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs, and which of them in that order are the first of their kind."""
    order = np.lexsort((context, token))
    t, c = token[order], context[order]
    return order, np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])[: len(t)]


def spread(rows: DataFrame, labels: list[int]) -> DataFrame:
    """(bucket, texts, at, names, packed), written once. Per group of texts: its distinct pairs
    and how often they are learned from, by bucket, `at` being the first one's number; and one
    row without a bucket that names the texts and tells which pairs they hold how often."""
    n = len(labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (held, token, context, row) in enumerate(_batches(batches)):
            group = (task << 32) | number
            names = pa.Table.from_batches([b.slice(i, j - i).select([1, 2]) for b, i, j in held])
            learned = names.column("train").to_numpy().astype(np.int64)
            order, new = _pairs(token, context)
            first = np.flatnonzero(new)
            learned = np.add.reduceat(learned[row[order]], first)
            joint, times = np.unique((row[order] << 32) | (np.cumsum(new) - 1), return_counts=True)
            token, context = token[order][first], context[order][first]
            parts = [(labels[b], i, None, pack((token[i:j], context[i:j], learned[i:j]))) for b, i, j in _cut(token, n)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, names.schema) as writer:
                writer.write_table(names)
            parts.append((None, len(token), sink.getvalue().to_pybytes(), pack((joint, times.astype(np.int64)))))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array([p[k] for p in parts], kind) for k, kind in enumerate(kinds)]
            columns.insert(1, pa.array([group] * len(parts), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "texts", "at", "names", "packed"])

    return stage(rows.mapInArrow(work, "bucket int, texts long, at long, names binary, packed binary"), "spread")


def count_pairs(asked: DataFrame, n: int) -> DataFrame:
    """(bucket, packed): the (token, context, count) of each bucket in order, written once. Pairs
    that are only asked for count 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}

        def settle(b: int) -> None:
            token, context, count = np.concatenate(waiting[b], axis=1)
            order, new = _pairs(token, context)
            first = np.flatnonzero(new)
            total = np.add.reduceat(count[order].view(np.int64), first)
            waiting[b] = [np.stack([token[order][first], context[order][first], total.view(np.uint64)])]

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting.setdefault(b, []).append(unpack(blob.as_buffer(), 3))
                if len(waiting[b]) >= 16:
                    settle(b)
        for b in list(waiting):
            settle(b)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(tuple(waiting.pop(b)[0]))], pa.binary())], ["bucket", "packed"])

    return stage(asked.select("bucket", "packed").repartition(n, "bucket").mapInArrow(add, "bucket int, packed binary"), "pairs")


def _seat(customers: np.ndarray, pull: np.ndarray, discount: float, dice: np.random.Generator) -> np.ndarray:
    """Tables of each block of customers of one dish. The first opens a table; a later one
    opens another with odds of `pull` against those seated less the discount per table."""
    tables = np.ones(len(customers))
    at = np.flatnonzero(customers >= 2)
    seated = 1
    while len(at):
        step = 1 if seated < ONE_BY_ONE else seated // 16
        n = np.minimum(customers[at] - seated, step)
        odds = pull[at] / np.maximum(pull[at] + seated - discount * tables[at], 1e-12)
        tables[at] += dice.binomial(n, np.minimum(odds, 1.0)) if step > 1 else dice.random(len(at)) < odds
        seated += step
        at = at[customers[at] > seated]
    return tables


class Seating:
    """The restaurants of the tokens of one bucket, taken through the sweeps."""

    def __init__(self, key: np.ndarray, count: np.ndarray, totals: Totals, width: int = 8, seed: int | None = None):
        """The lowest `width` bits of a key number the context, the others the token."""
        self.count, self.totals = count, totals
        self.context = (key & np.uint64((1 << width) - 1)).astype(np.int64)
        token = key >> np.uint64(width)
        self.first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(key) else np.zeros(0, int)
        self.token = token[self.first]
        self.of = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(key))))
        self.tables = np.ones(len(key))
        self.parent_tables = np.ones(len(self.first))
        self.seed = seed if seed is not None else int(token[0]) if len(key) else 0

    def parent_customers(self) -> np.ndarray:
        return np.add.reduceat(self.tables, self.first) if len(self.first) else np.zeros(0)

    def parent_probability(self, customers: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        t = self.totals
        all_customers = t.tables[sweep].sum() if t.all_tables is None else t.all_tables[sweep]
        all_tables = t.parent_tables[sweep]
        spare = (THETA_PARENT + t.discount_parent * all_tables) / (t.distinct + 1)
        own = np.maximum(customers - t.discount_parent * tables, 0)
        return (own + spare) / (THETA_PARENT + all_customers)

    def sweep(self, k: int) -> None:
        """One sweep, given the totals after the one before."""
        t, dice = self.totals, np.random.default_rng([SEED, k, self.seed])
        others = self.parent_customers()[self.of] - self.tables
        spare = (THETA + t.discount * t.tables[k][self.context]) * self.parent_probability(
            others, np.minimum(self.parent_tables[self.of], others), k
        )
        self.tables = _seat(self.count, spare, t.discount, dice)
        pull = np.full(len(self.first), (THETA_PARENT + t.discount_parent * t.parent_tables[k]) / (t.distinct + 1))
        self.parent_tables = _seat(self.parent_customers().astype(np.int64), pull, t.discount_parent, dice)


class Bucket:
    """The pairs of one bucket, with tokens and contexts numbered in order, and what the answers
    of the contexts' buckets, one lot per sweep, tell about the contexts."""

    def __init__(self, kinds: list[int], packed: list[bytes], totals: Totals | None):
        self.token, self.context, count = unpack(packed[kinds.index(-1)], 3)
        self.tokens, self.contexts = np.unique(self.token), np.unique(self.context)
        key, count = self.numbered(self.token, self.context), count.view(np.int64)
        self.key, self.count = key[count > 0], count[count > 0]
        self.seed = int(self.tokens[0])
        if totals is None:
            return
        customers = np.zeros(len(self.contexts))
        tables = [np.zeros(len(self.contexts)) for _ in range(max(kinds) + 1)]
        for kind, blob in zip(kinds, packed, strict=True):
            if kind >= 0:
                got = unpack(blob, 2 if kind else 3)
                at = np.searchsorted(self.contexts, got[0])
                tables[kind][at] = got[1].view(np.float64)
                if kind == 0:
                    customers[at] = got[2].view(np.float64)
        self.totals = replace(totals, customers=customers, tables=tables)

    def numbered(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        at, near = np.searchsorted(self.tokens, token), np.searchsorted(self.contexts, context)
        return (at.astype(np.uint64) << np.uint64(WIDTH)) | near.astype(np.uint64)

    def sums(self, context: np.ndarray, values: list[np.ndarray], labels: list[int]) -> list[tuple[int, bytes]]:
        """Sums of the values per context, by the bucket of the context."""
        n = len(self.contexts)
        sums = [np.bincount(context, v, n).astype(np.float64) for v in values]
        return [(labels[b], pack((self.contexts[i:j], *[s[i:j] for s in sums]))) for b, i, j in _cut(self.contexts, len(labels))]


def _state(pairs: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """(bucket, kind, packed): the pairs (-1) and the answers of the sweeps so far."""
    out = pairs.select("bucket", F.lit(-1).alias("kind"), "packed")
    for kind, answer in enumerate(answers):
        out = out.unionByName(answer.select("bucket", F.lit(kind).alias("kind"), "packed"))
    return out


def _round(state: DataFrame, work, size: int, width: int) -> tuple[np.ndarray, DataFrame]:
    """work(kinds, packed) gives the sums of a bucket by bucket of the context, `width` values per
    context, and a vector of fixed size. The vectors are added up here; the sums are added up
    per context and sent back to the buckets that have the context."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        sums, vector = work(group.column("kind").to_pylist(), [b.as_buffer() for b in group.column("packed")])
        rows = [*sums, (None, np.asarray(vector, np.float64).tobytes())]
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            names=["home", "bucket", "packed"],
        )

    def answer(group: pa.Table) -> pa.Table:
        got = [unpack(b.as_buffer(), 1 + width) for b in group.column("packed")]
        contexts = np.unique(np.concatenate([g[0] for g in got]))
        at = [np.searchsorted(contexts, g[0]) for g in got]
        total = np.zeros((width, len(contexts)))
        for where, g in zip(at, got, strict=True):
            total[:, where] += g[1:].view(np.float64)
        packed = [pack((g[0], *[np.ascontiguousarray(t[where]) for t in total])) for where, g in zip(at, got, strict=True)]
        return pa.table([group.column("bucket"), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    sent = stage(state.groupBy("bucket").applyInArrow(run, "home int, bucket int, packed binary"), "sums")
    vectors = [np.frombuffer(r["packed"], np.float64) for r in sent.where("home is null").orderBy("bucket").select("packed").collect()]
    answers = stage(sent.where("home is not null").groupBy("home").applyInArrow(answer, "bucket int, packed binary"), "contexts")
    return sum(vectors, np.zeros(size)), answers


def fit(pairs: DataFrame, labels: list[int], sweeps: int = SWEEPS) -> tuple[Totals, DataFrame]:
    """Run the sweeps. Totals over all restaurants, and per bucket the pairs with the customers
    and, after each sweep, the tables of their contexts."""

    def counted(kinds: list[int], packed: list[bytes]) -> tuple[list, list]:
        b = Bucket(kinds, packed, None)
        s = Seating(b.key, b.count, None, WIDTH)
        per_token = np.bincount(s.of)
        ones = [(b.count == 1).sum(), (b.count == 2).sum(), (per_token == 1).sum(), (per_token == 2).sum()]
        return b.sums(s.context, [s.tables, b.count], labels), [b.count.sum(), len(b.key), len(s.first), *ones]

    got, answers = _round(_state(pairs, []), counted, 7, 2)
    customers, tables, distinct, ones, twos, parent_ones, parent_twos = got

    def discount(a: float, b: float) -> float:
        return float(np.clip(a / max(a + 2 * b, 1.0), 0.1, 0.95))

    totals = Totals(
        np.array([customers]), int(distinct), discount(ones, twos), discount(parent_ones, parent_twos), [], [distinct], [float(tables)]
    )
    state = _state(pairs, [answers])
    for k in range(1, sweeps + 1):

        def seated(kinds: list[int], packed: list[bytes], upto: int = k) -> tuple[list, list]:
            b = Bucket(kinds, packed, totals)
            s = Seating(b.key, b.count, b.totals, WIDTH, b.seed)
            for earlier in range(upto):
                s.sweep(earlier)
            return b.sums(s.context, [s.tables], labels), [s.tables.sum(), s.parent_tables.sum()]

        got, answers = _round(state, seated, 2, 1)
        state = state.unionByName(answers.select("bucket", F.lit(k).alias("kind"), "packed"))
        totals.all_tables.append(float(got[0]))
        totals.parent_tables.append(float(got[1]))
    return totals, state


class Predictive:
    """Averaged probabilities of the tokens of one bucket."""

    def __init__(self, key: np.ndarray, count: np.ndarray, totals: Totals, burn_in: int, width: int = 8, seed: int | None = None):
        self.key, self.totals, self.width = key, totals, width
        s = Seating(key, count, totals, width, seed)
        self.count = np.add.reduceat(count, s.first) if len(s.first) else np.zeros(0, np.int64)
        self.token = s.token
        sweeps = len(totals.tables) - 1
        all_customers = THETA + totals.customers
        self.own = np.zeros(len(key))
        self.parent, self.share = [], []
        none = np.zeros(1)
        for k in range(sweeps):
            s.sweep(k)
            if k < burn_in and sweeps > burn_in:
                continue
            self.own += np.maximum(count - totals.discount * s.tables, 0) / all_customers[s.context]
            seen = s.parent_probability(s.parent_customers(), s.parent_tables, k + 1)
            self.parent.append(np.append(seen, s.parent_probability(none, none, k + 1)))
            self.share.append((THETA + totals.discount * totals.tables[k + 1]) / all_customers)
        self.own /= max(len(self.parent), 1)

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of the token, probability of token given context) of each key."""
        token, context = key >> np.uint64(self.width), (key & np.uint64((1 << self.width) - 1)).astype(np.int64)
        n = len(self.token)
        at = np.minimum(np.searchsorted(self.token, token), max(n - 1, 0))
        known = self.token[at] == token if n else np.zeros(len(key), bool)
        at = np.where(known, at, n)
        p = sum(share[context] * parent[at] for share, parent in zip(self.share, self.parent, strict=True)) / len(self.share)
        if len(self.key):
            pair = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            p = p + np.where(self.key[pair] == key, self.own[pair], 0.0)
        return np.append(self.count, 0)[at], p


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; `train`
    is a condition on `docs` that says which rows are learned from."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = even_blocks(spark, n)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"))
    parts = spread(rows, labels)
    asked = parts.where("bucket is not null").select("bucket", "texts", "at", "packed")
    totals, state = fit(count_pairs(asked, n), labels, sweeps)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Training counts and probabilities of the pairs that each group of texts asks for."""
        b = Bucket(right.column("kind").to_pylist(), [x.as_buffer() for x in right.column("packed")], totals)
        model = Predictive(b.key, b.count, b.totals, burn_in, WIDTH, b.seed)
        out = []
        for blob in left.column("packed"):
            token, context, _ = unpack(blob.as_buffer(), 3)
            count, p = model.look(b.numbered(token, context))
            out.append(pack((count, np.log10(p))))
        return pa.table([left.column("texts"), left.column("at"), pa.array(out, pa.binary())], names=["texts", "at", "packed"])

    known_tokens, spare = int(totals.customers[0]), np.log10(totals.customers[0] + totals.distinct + 1)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of the texts of one group."""
        names = pa.ipc.open_stream(left.column("names")[0].as_buffer()).read_all()
        joint, times = unpack(left.column("packed")[0].as_buffer(), 2)
        count, p = np.zeros(left.column("at")[0].as_py()), np.zeros(left.column("at")[0].as_py())
        for at, blob in zip(right.column("at").to_pylist(), right.column("packed"), strict=True):
            got = unpack(blob.as_buffer(), 2)
            count[at : at + got.shape[1]], p[at : at + got.shape[1]] = got[0].view(np.int64), got[1].view(np.float64)
        row, pair = (joint >> np.uint64(32)).astype(np.int64), (joint & np.uint64(0xFFFFFFFF)).astype(np.int64)
        times, size = times.view(np.int64), names.num_rows
        n_tokens, n_known = (np.bincount(row, times * v, size).astype(np.int64) for v in (np.ones(len(row)), count[pair] > 0))
        return pa.table(
            [
                names.column("doc_id"),
                pa.array(~names.column("train").to_numpy().astype(bool)),
                pa.array(n_tokens),
                pa.array(n_known),
                pa.array(np.full(size, known_tokens, np.int64)),
                pa.array(np.bincount(row, times * np.log10(count[pair] + 1.0), size) - n_tokens * spare),
                pa.array(np.bincount(row, times * p[pair], size)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    judged = asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(judge, "texts long, at long, packed binary")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return parts.where("bucket is null").select("texts", "at", "names", "packed").groupBy("texts").cogroup(judged.groupBy("texts")).applyInArrow(
        total,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
