"""Quality rules: counts over whole texts, and a logistic regression over hashed n-grams.

The counts (words, symbols, repeated lines and repeated eight-word windows) feed fixed rules.
The classifier sees hashed words, word pairs and byte four-grams as shares of a text; it is
trained on labelled rows, its output calibrated on rows kept out of the training, and a text
is kept if it passes the rules and its probability reaches THRESHOLD.

Null texts have no words. At most PER_CLASS labelled rows of each class are used, chosen by a
hash of their id. Without both classes every text has the share of good labels (0.5 if there
are none) as its probability. Equal texts get equal results; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bytes import BLANK, LOWER, chunks, mix, padded, run_hashes, runs, utf8

PER_CLASS = 1500
BITS = 15
BINS = 1 << BITS
KINDS = 3
WINDOW = 8
THRESHOLD = 0.5
# Rules: too few words, or too large a share of repeated words.
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class QualityModel:
    """`weights` over KINDS x BINS shares; probability = sigmoid(slope * (score + bias) + shift)."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


def _words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = ~BLANK[buf]
    first, last = runs(inside)
    return inside, first, last, np.searchsorted(starts, first, "right") - 1


def _repeats(keys: np.ndarray, n: int) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(n, bool)
    equal = keys[order][1:] == keys[order][:-1]
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    return same


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    buf, starts, ends = padded(data, offsets, 1, 0x0A)
    n = len(starts)
    inside, first, last, doc = _words(buf, starts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends] - total[starts]

    n_words = np.bincount(doc, minlength=n)
    # Lines with a word: a line is what lies between two line feeds.
    feeds = np.flatnonzero(buf == 0x0A)
    line_start, line_end = feeds[:-1] + 1, feeds[1:]
    words_upto = np.concatenate(([0], np.cumsum(inside)))
    worded = words_upto[line_end] > words_upto[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = np.searchsorted(starts, line_start, "right") - 1
    key = run_hashes(buf, line_start, line_end) ^ mix(line_doc.astype(np.uint64) + _SALT)
    _, one = np.unique(key, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[one], minlength=n)
    # Eight-word windows: hashes of two, four and eight words.
    repeated = np.zeros(n, np.int64)
    if len(first) >= WINDOW:
        h = run_hashes(buf, first, last)
        for step in (1, 2, 4):
            h = mix(h[:-step] * _SALT + h[step:])
        whole = doc[: len(h)] == doc[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        twice = at[_repeats(h[at] ^ mix(doc[at].astype(np.uint64) + _SALT), len(at))]
        edge = np.zeros(len(first) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        repeated = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": per_text(inside & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
    }


def _grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bin) of every word, word pair and byte four-gram."""
    buf, starts, ends = padded(data, offsets, 4, 0x0A)
    _, first, last, doc = _words(buf, starts)
    words = run_hashes(LOWER[buf], first, last)
    shift = np.uint64(64 - BITS)
    pairs = mix(words[:-1] * _SALT + words[1:])
    same = np.flatnonzero(doc[:-1] == doc[1:])
    wide = buf.astype(np.uint32)
    four = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    char_doc = np.repeat(np.arange(len(starts)), ends - starts)
    char_at = np.arange(len(char_doc)) + np.repeat(starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts)
    char = (four[char_at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return [
        (doc, (words >> shift).astype(np.int64)),
        (doc[same], (pairs[same] >> shift).astype(np.int64)),
        (char_doc, char.astype(np.int64)),
    ]


def _scores(data: np.ndarray, offsets: np.ndarray, model: QualityModel) -> np.ndarray:
    n = len(offsets) - 1
    score = np.full(n, model.bias)
    for kind, (doc, at) in enumerate(_grams(data, offsets)):
        w = model.weights[kind * BINS : (kind + 1) * BINS]
        score += np.bincount(doc, w[at], n) / np.maximum(np.bincount(doc, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(model.slope * score + model.shift, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", per_class: int = PER_CLASS,
) -> QualityModel:
    """Train on at most `per_class` labelled texts of each class. What is gathered is bounded:
    no more than KINDS x BINS shares per text."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        "_y in (0, 1) and _id is not null"
    )
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        p = 0.5 if not share else float(1 in share)
        return QualityModel(np.zeros(KINDS * BINS, np.float32), shift=float(np.log((p + 1e-9) / (1 - p + 1e-9))))
    once = known.distinct()
    chosen = [once.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), F.col("_doc") == F.col("_id")
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets, most_rows=64):
                parts = []
                for kind, (doc, at) in enumerate(_grams(data, offsets[i : j + 1])):
                    key, n = np.unique(doc * (KINDS * BINS) + kind * BINS + at, return_counts=True)
                    total = np.maximum(np.bincount(doc, minlength=j - i), 1)
                    parts.append((key, n / total[key // (KINDS * BINS)]))
                key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                cuts = np.searchsorted(key, np.arange(j - i + 1) * KINDS * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.ListArray.from_arrays(cuts, pa.array((key % (KINDS * BINS)).astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32))),
                    ],
                    ["order", "y", "at", "share"],
                )

    got = rows.select("text", F.xxhash64("_doc"), "_y").mapInArrow(
        gather, "order long, y int, at array<int>, share array<float>"
    ).toArrow()
    if got.num_rows == 0:
        return QualityModel(np.zeros(KINDS * BINS, np.float32))
    return _train(got, share[1] / (share[0] + share[1]))


def _train(got: pa.Table, prior: float) -> QualityModel:
    rank = np.argsort(got.column("order").to_numpy(), kind="stable")
    got = got.take(pa.array(rank))
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("at").combine_chunks()
    at, value = lists.flatten().to_numpy(), got.column("share").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    # Every fifth row is kept out of the training, for the calibration.
    out = np.arange(len(y)) % 5 == 4
    fits = ~out[row]
    rms = np.sqrt(np.bincount(at[fits], value[fits] ** 2, KINDS * BINS) / max(1, (~out).sum()))
    scale = 1 / (rms + 0.05 * rms[rms > 0].mean())
    x = value * scale[at]
    w, bias = np.zeros(KINDS * BINS), 0.0
    weight = np.where(y == 1, 0.5 / max(1, ((y == 1) & ~out).sum()), 0.5 / max(1, ((y == 0) & ~out).sum())) * ~out
    m, v = np.zeros(KINDS * BINS + 1), np.zeros(KINDS * BINS + 1)
    for step in range(1, 81):  # Adam, on the whole sample each time
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(y)) + bias, -30, 30)))
        error = (p - y) * weight
        g = np.append(np.bincount(at, x * error[row], KINDS * BINS) + 1e-4 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    score = np.bincount(row, x * w[at], len(y)) + bias
    slope, shift = _calibrate(score[out], y[out], prior) if 0 < y[out].sum() < out.sum() else (1.0, 0.0)
    return QualityModel((w * scale).astype(np.float32), float(bias), slope, shift)


def _calibrate(score: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a sigmoid, by gradient steps on the standardised scores. The classes
    count by their shares among all labels; smoothed targets keep the slope finite."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0)
    centre, spread = score.mean(), score.std() + 1e-9
    x = (score - centre) / spread
    a = b = 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(a * x + b)))
        error = (p - target) * weight
        a, b = a - (error * x).sum(), b - error.sum()
    return float(a / spread), float(b - a * centre / spread)


def score(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Counts, rules, calibrated probability and verdict of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                own = offsets[i : j + 1]
                got = counts(data, own)
                p = _scores(data, own, shared.value)
                failed = (got["n_words"] < MIN_WORDS) | (
                    100 * got["n_repeat_words"] > MAX_REPEATED_PERCENT * got["n_words"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        *[pa.array(got[n].astype(np.int64)) for n in names],
                        pa.array(failed),
                        pa.array(p),
                        pa.array(~failed & (p >= threshold)),
                    ],
                    ["doc_id", *names, "base_failed", "quality", "kept"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = ", ".join(f"{n} long" for n in names)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, {columns}, base_failed boolean, quality double, kept boolean")
