"""Benchmark decontamination by template windows.

Texts are read as templates: numbers, units after numbers and names (capitalised words) become
typed placeholders, the other words stay in lower case. A capitalised word that begins a sentence
may be a name or not, so there are two forms: INSIDE takes it for a word, ANYWHERE for a name; an
item is found if either form finds it. A third form, VERBATIM, keeps all tokens as they are
and finds what was copied as a whole; an item shorter than a window is one window of its length.
Windows of WINDOW
tokens of the benchmark are hash-joined with those of all documents. The placeholders' fillers
of a match are then compared: one filler of the item, of one type, must stand for one filler of
the document; two of the item's may have become one. Windows with a filler that stands for
several are dropped, and all windows of an alignment if these are not fewer than the others.
So an item is found if it was copied, and also if it was asked again with other numbers or names.
Windows that many items hold, as their instructions, say little: a window weighs one by the number
of its items, and an item is found by the average weight of as many windows as it needs. Items are
looked for by the windows that they cannot be found without, the rarest ones, first.

Document windows first pass a bit map of fixed size over the benchmark's hashes, so only likely
matches are shuffled; what the map lets through by chance the join removes.

Null texts have no tokens; items of fewer than WINDOW tokens are found only verbatim; repeated rows count once; an empty table on either side gives no rows; other columns
are not read. Rows with a null id are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.bytes import LOWER, chunks, mix, padded, run_hashes, runs, utf8
from tillroll.sources.shared import stage

WINDOW = 8
# A window says nothing if it is made of placeholders only.
LEAST_WORDS = 4
# An item is found from so many of its windows on, or from so large a share if it has few.
LEAST_WINDOWS = 6
LEAST_SHARE = 2 / 3
MAP_BITS = 24
SLACK = 1e-9  # of sums of weights
VERBATIM, INSIDE, ANYWHERE = 0, 1, 2
# Words that are a unit when they follow a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams pound pounds lb lbs ounce ounces oz "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month "
    "months year years percent dollar dollars euro euros cent cents degree degrees mph kmh watt watts volt volts"
).split()

_WORD, _DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = True
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STOP[[ord(c) for c in ".!?:\n"]] = True
_JOINT = np.isin(np.arange(256), [ord("."), ord(",")])
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B))
_TYPES = {_NUMBER: "number ", _UNIT: "unit ", _NAME: "name "}
_STEP = np.uint64(0xD6E8FEB86659FD93)
# Told apart from the other forms' hashes by these.
_FORM = {VERBATIM: np.uint64(0xC2B2AE3D27D4EB4F), INSIDE: np.uint64(0), ANYWHERE: np.uint64(0xA54FF53A5F1D36F1)}


def _unit_hashes() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    first, last = runs(text != 0x20)
    return np.sort(run_hashes(text, first, last))


_UNIT_HASHES = _unit_hashes()


def _capitals(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which tokens begin with a capital letter of any script."""
    out = _UPPER[buf[first]]
    wide = np.flatnonzero(buf[first] >= 0xC3)
    byte = [np.append(buf, np.zeros(3, np.uint8))[first[wide] + k].astype(np.uint32) for k in range(4)]
    low = [b & np.uint32(0x3F) for b in byte]
    two = ((byte[0] & np.uint32(0x1F)) << np.uint32(6)) | low[1]
    three = ((byte[0] & np.uint32(0x0F)) << np.uint32(12)) | (low[1] << np.uint32(6)) | low[2]
    four = ((byte[0] & np.uint32(0x07)) << np.uint32(18)) | (low[1] << np.uint32(12)) | (low[2] << np.uint32(6)) | low[3]
    points, of = np.unique(np.select([byte[0] < 0xE0, byte[0] < 0xF0], [two, three], four), return_inverse=True)
    out[wide] = np.array([c < 0x110000 and (chr(c).isupper() or chr(c).istitle()) for c in points.tolist()], bool)[of]
    return out


class Templates:
    """Tokens of some texts: where they stand, their template hashes, and which are slots; the
    latter two by form."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.buf, self.starts, ends = padded(data, offsets, 1, 0x0A)
        buf = self.buf
        inside = _WORD[buf]
        # A point or comma between digits belongs to the number.
        inside[1:-1] |= _JOINT[buf[1:-1]] & _DIGIT[buf[:-2]] & _DIGIT[buf[2:]]
        # Quotes, dashes and the like (U+2000 to U+203F, U+00AB, U+00BB) are in no word.
        sign = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80))
        inside[sign] = inside[sign + 1] = inside[sign + 2] = False
        sign = np.flatnonzero((buf[:-1] == 0xC2) & np.isin(buf[1:], [0xAB, 0xBB]))
        inside[sign] = inside[sign + 1] = False
        self.first, self.last = runs(inside)
        self.doc = np.searchsorted(self.starts, self.first, "right") - 1
        words = run_hashes(LOWER[buf], self.first, self.last)
        number = _DIGIT[buf[self.first]]
        follows = np.concatenate([[False], number[:-1] & (self.doc[1:] == self.doc[:-1])])[: len(number)]
        unit = follows & np.isin(words, _UNIT_HASHES) & ~number
        # The last sign before a token that is no blank tells if a sentence begins.
        stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
        before = np.concatenate([[0], self.last[:-1]])[: len(self.first)]
        begins = stops[self.first] > stops[before]
        capital = _capitals(buf, self.first) & ~number & ~unit
        names = {INSIDE: capital & ~begins, ANYWHERE: capital}
        self.slot = {form: number | unit | name for form, name in names.items()}
        self.token = {form: np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], words) for form, name in names.items()}
        self.slot[VERBATIM] = np.zeros(len(words), bool)
        self.token[VERBATIM] = run_hashes(buf, self.first, self.last)

    def windows(self, form: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows that hold enough words."""
        n = len(self.first) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.token[form]
        for step in (1, 2, 4):
            h = mix(h[:-step] * _STEP + h[step:])
        h = h ^ _FORM[form]
        words = np.concatenate([[0], np.cumsum(~self.slot[form])])
        enough = (words[WINDOW:] - words[:n] >= LEAST_WORDS) | (form == VERBATIM)
        at = np.flatnonzero((self.doc[:n] == self.doc[WINDOW - 1 :]) & enough)
        return at, h[at]

    def short_windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the verbatim windows of a length below WINDOW, equal ones of
        a text once."""
        token = self.token[VERBATIM]
        n = len(token) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, np.uint64(length))
        for k in range(length):
            h = mix(h * _STEP + token[k : k + n])
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        order = at[np.lexsort((h[at], self.doc[at]))]
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (self.doc[order][1:] != self.doc[order][:-1])])[: len(order)]
        at = np.sort(order[new])
        return at, h[at]

    def fillers(self, form: int, at: int) -> list[str]:
        """The type and text of each slot, nothing for words; none where nothing is a slot."""
        if form == VERBATIM:
            return []
        where, slot, token = range(at, at + WINDOW), self.slot[form], self.token[form]
        return [_TYPES[token[k]] + self.buf[self.first[k] : self.last[k]].tobytes().decode("utf-8", "replace") if slot[k] else "" for k in where]


def _windows(rows: DataFrame, seen: object = None, lengths: list[int] | None = None) -> DataFrame:
    """(id, form, pos, hash, fillers, length) of the windows; of those in the bit map only, if one
    is given. Short windows are those of the given lengths or else the texts that are one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if seen is None else np.unpackbits(seen.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                t = Templates(data, offsets[i : j + 1])
                size = np.bincount(t.doc, minlength=j - i)
                parts = [(form, WINDOW, *t.windows(form)) for form in _FORM]
                for length in range(1, WINDOW) if lengths is None else lengths:
                    at, h = t.short_windows(length)
                    whole = size[t.doc[at]] == length if lengths is None else np.ones(len(at), bool)
                    parts.append((VERBATIM, length, at[whole], h[whole]))
                for form, length, at, h in parts:
                    if bits is not None:
                        likely = bits[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)] > 0
                        at, h = at[likely], h[likely]
                    if not len(at):
                        continue
                    row = t.doc[at]
                    position = at - np.searchsorted(t.doc, row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[i + row]),
                            pa.array(np.full(len(at), form, np.int32)),
                            pa.array(position.astype(np.int32)),
                            pa.array(h.view(np.int64)),
                            pa.array([t.fillers(form, k) for k in at], pa.list_(pa.string())),
                            pa.array(np.full(len(at), length, np.int32)),
                        ],
                        ["id", "form", "pos", "hash", "fillers", "length"],
                    )

    return rows.mapInArrow(work, "id long, form int, pos int, hash long, fillers array<string>, length int")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )


def _weighed(items: DataFrame) -> DataFrame:
    """The items' windows with `weight`, one by the number of items that hold them, and per item
    and form `item_windows`, `enough` and `needed`: the least number of windows and weight from
    which on it is found. `telling` are the windows that no item is found without: of the
    commonest ones together, as many are left out as weigh less than is needed."""
    shared = items.groupBy("hash").agg(F.countDistinct("id").alias("_in"))
    rows = items.join(shared, "hash").withColumn("weight", 1 / F.col("_in")).drop("_in")
    form = Window.partitionBy("id", "form")
    n = F.size(F.collect_set("pos").over(form))
    rows = rows.withColumn("item_windows", n.cast("long"))
    some = F.least(F.lit(LEAST_WINDOWS), F.ceil(F.lit(LEAST_SHARE) * F.col("item_windows")))
    rows = rows.withColumn("enough", F.when(F.col("form") == VERBATIM, F.col("item_windows")).otherwise(some))
    needed = F.sum("weight").over(form) * F.col("enough") / F.col("item_windows")
    commoner = F.sum("weight").over(form.orderBy("weight", "pos", "hash"))
    return rows.withColumns({"needed": needed, "_up_to": commoner}).withColumn("telling", F.col("_up_to") >= F.col("needed") - SLACK).drop("_up_to")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, reworded): one row per document and item
    found in it; `reworded` if any placeholder is filled otherwise than in the item."""
    spark = docs.sparkSession
    items = stage(_windows(_rows(benchmark, item_col, item_text_col)).distinct(), "items")
    shift = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    # At most 2**MAP_BITS numbers, whatever the size of the benchmark.
    set_bits = items.select(shift.cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()
    flags = np.zeros(1 << MAP_BITS, np.uint8)
    flags[set_bits] = 1
    shared = spark.sparkContext.broadcast(np.packbits(flags))
    lengths = sorted(r["length"] for r in items.where(F.col("length") < WINDOW).select("length").distinct().collect())
    found = stage(_windows(_rows(docs, id_col, text_col), shared, lengths).drop("length"), "windows")
    weighed = stage(_weighed(items), "weighed")
    telling = weighed.where("telling").select("hash", F.col("id").alias("item_id"))
    candidates = stage(
        found.select(F.col("id").alias("doc_id"), "hash").join(telling, "hash").select("doc_id", "item_id").distinct(), "candidates"
    )
    of_item = weighed.select(F.col("id").alias("item_id"), "hash", F.struct("form", "pos", "fillers", "weight").alias("item"))
    matched = (
        found.select(F.col("id").alias("doc_id"), "hash", "pos", F.col("fillers").alias("doc_fillers"))
        .join(candidates, "doc_id")
        .join(of_item, ["item_id", "hash"])
    )
    pair = ["doc_id", "item_id", "form", "diagonal"]
    aligned = stage(
        matched.select(
            "doc_id",
            "item_id",
            F.col("item.form").alias("form"),
            F.col("item.pos").alias("item_pos"),
            F.col("item.weight").alias("weight"),
            (F.col("pos") - F.col("item.pos")).alias("diagonal"),
            F.filter(F.arrays_zip(F.col("doc_fillers").alias("d"), F.col("item.fillers").alias("i")), lambda z: z["i"] != "").alias("slots"),
        ),
        "aligned",
    )
    slots = aligned.select(*pair, F.explode("slots").alias("s")).select(*pair, "s.d", "s.i").distinct()
    torn = slots.groupBy(*pair, "i").count().where("count > 1").groupBy(*pair).agg(F.collect_list("i").alias("torn"))
    clean = F.col("torn").isNull() | ~F.exists("slots", lambda z: F.array_contains("torn", z["i"]))
    differs = F.exists("slots", lambda z: z["d"] != z["i"])
    position = F.struct("item_pos", "weight", differs.alias("differs"))
    # Clean windows count if they are more than those with a torn filler.
    alignments = (
        aligned.join(torn, pair, "left")
        .groupBy(*pair)
        .agg(F.collect_set(F.when(clean, position)).alias("clean"), F.countDistinct(F.when(~clean, F.col("item_pos"))).alias("n_torn"))
        .where(F.size("clean") > F.col("n_torn"))
    )
    sizes = weighed.select(F.col("id").alias("_item"), F.col("form").alias("_form"), "item_windows", "enough", "needed").distinct()
    by_position = alignments.select(*pair, F.explode("clean").alias("w")).groupBy("doc_id", "item_id", "form", "w.item_pos")
    return (
        by_position.agg(F.max("w.weight").alias("weight"), F.max("w.differs").alias("differs"))
        .groupBy("doc_id", "item_id", "form")
        .agg(F.count(F.lit(1)).alias("n_windows"), F.sum("weight").alias("weight"), F.max("differs").alias("reworded"))
        .join(sizes, (F.col("item_id") == F.col("_item")) & (F.col("form") == F.col("_form")))
        .drop("_item", "_form")
        .where((F.col("n_windows") >= F.col("enough")) & (F.col("weight") >= F.col("needed") - SLACK))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_windows", "item_windows")).alias("best"), F.max("reworded").alias("reworded"))
        .select("doc_id", "item_id", "best.n_windows", "best.item_windows", "reworded")
    )
