"""Language ID by nearest centroids.

A text is a TF-IDF vector over hashed byte trigrams of its letters, of length one. Every
language has several centroids (spherical k-means over its training vectors); the language of
the nearest centroid by cosine is predicted, and a text whose nearest centroid is too far is
rejected. What is too far depends on the language and on the number of trigrams, as few trigrams
are far from every centroid: it is less than the lowest cosine of training rows, cut down to
that number, to centroids learned from the other half of them, and never more than MIN_COSINE.

Null texts and texts without a letter are `und`, score 0, rejected. With no training rows all
texts are `und`. Rows keep their other columns; columns named like the results are replaced.
The fit uses at most PER_LANGUAGE rows per language, chosen by a hash of their id; ties between
languages go to the first in order of name."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.llm.bytes import LOWER, chunks, padded, trim, utf8

PER_LANGUAGE = 500
CENTROIDS = 3
BINS = 4096
# Cosine below which no language is near, however short the texts that were learned from.
MIN_COSINE = 0.12
# Numbers of trigrams with a limit of their own; in between the smaller one's holds.
SIZES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128])
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of_centroid: np.ndarray
    least: np.ndarray  # per language and size the cosine below which a text is rejected

    def limits(self, centroid: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
        size = np.maximum(np.searchsorted(SIZES, trigrams, "right") - 1, 0)
        return self.least[self.of_centroid[centroid], size]


# Bytes that are neither ASCII letters nor part of longer characters separate words.
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[65:91] = LOWER[65:91]
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, one row of BINS per text."""
    raw, starts, ends = padded(data, offsets, 3, 0x20)
    text = _LETTER[raw]
    # Capitals of the Latin-1 letters, whose first byte is 0xC3.
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capital = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
    text[capital] += 0x20
    wide = text.astype(np.uint32)
    gram = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    bins = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts - 1, len(raw) - 3)))
    gram, bins = gram[2 : 2 + len(row)], bins[2 : 2 + len(row)]
    shown = gram != 0x202020
    found = np.bincount(row[shown] * BINS + bins[shown], minlength=len(starts) * BINS)
    return found.reshape(len(starts), BINS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    for i in range(len(out)):
        part = data[offsets[i] : offsets[i + 1]]
        if ((part | 0x20) - 97 < 26).any():
            out[i] = True
        elif (part >= 0x80).any():
            out[i] = any(map(str.isalpha, part.tobytes().decode("utf-8", "ignore")))
    return out


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starts; the same rows give the same centroids."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(12):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centres


def _least(counts: np.ndarray, x: np.ndarray, idf: np.ndarray, centroids: int, most: float) -> np.ndarray:
    """The limits of one language by size, out of its rows' counts and vectors."""
    out = np.full(len(SIZES), most)
    dice = np.random.default_rng(len(x))
    lowest = np.full(len(SIZES), np.inf)
    for half in (0, 1):
        own, other = np.arange(len(x)) % 2 == half, np.arange(len(x)) % 2 != half
        if not own.any() or not other.any():
            return out
        centres = _clusters(x[other], centroids)
        bins = np.arange(BINS, dtype=np.int16)
        drawn = [dice.permutation(np.repeat(bins, row.astype(np.int64)))[: SIZES[-1]] for row in counts[own]]
        for s, size in enumerate(SIZES):
            cut = [np.bincount(d[:size], minlength=BINS).astype(np.float32) for d in drawn if len(d) >= size]
            if cut:
                near = (_vectors(np.array(cut), idf) @ centres.T).max(axis=1)
                lowest[s] = min(lowest[s], near.min())
    return np.where(np.isfinite(lowest), np.minimum(lowest, most), most)


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    centroids: int = CENTROIDS,
    min_cosine: float = MIN_COSINE,
) -> LanguageModel:
    """Learn from rows with a language; at most `per_language` of each are gathered, as counts
    of bounded size."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.where(F.col("lang").isNotNull()).select("lang", "id")
    # Twice the share that is asked for goes on to be ranked, so no language fills a task.
    share = ids.groupBy(F.col("lang").alias("_of")).agg((F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("_share"))
    u = (F.xxhash64("id") / float(1 << 63) + 1) / 2
    chosen = (
        ids.join(F.broadcast(share), (F.col("lang") == F.col("_of")) & ((u < F.col("_share")) | (F.col("_share") > 0.5)))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_language)
        .select(F.col("id").alias("_id"), F.col("lang").alias("_lang"))
        .distinct()
    )
    picked = rows.join(F.broadcast(chosen), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets, most_rows=512):
                counts = _counts(data, offsets[i : j + 1])
                row, column = np.nonzero(counts)
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(i, j - i),
                        pa.ListArray.from_arrays(ends, pa.array(column.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(counts[row, column].astype(np.int32))),
                    ],
                    ["lang", "bins", "counts"],
                )

    got = picked.select("text", "lang").mapInArrow(count, "lang string, bins array<int>, counts array<int>").toArrow()
    langs = got.column("lang").to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.ones(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, int), np.zeros((0, len(SIZES))))
    dense = np.zeros((len(langs), BINS), np.float32)
    for i, (bins, counts) in enumerate(zip(got.column("bins"), got.column("counts"), strict=True)):
        dense[i, bins.values.to_numpy()] = counts.values.to_numpy()
    idf = (np.log((1 + len(dense)) / (1 + (dense > 0).sum(axis=0))) + 0.1).astype(np.float32)
    x, label = _vectors(dense, idf), np.array([languages.index(lang) for lang in langs])
    # Rows gather in no fixed order; sorting them makes the clusters repeatable.
    order = np.lexsort((x @ np.arange(1, BINS + 1, dtype=np.float32), label))
    x, label, dense = x[order], label[order], dense[order]
    found = [_clusters(x[label == n], centroids) for n in range(len(languages))]
    owner = np.repeat(np.arange(len(languages)), [len(f) for f in found])
    least = np.stack([_least(dense[label == n], x[label == n], idf, centroids, min_cosine) for n in range(len(languages))])
    model = LanguageModel(languages, idf, np.concatenate(found).astype(np.float32), owner, least)
    del got, dense, x
    trim()
    return model


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows with `lang_pred`, `score` (cosine to the nearest centroid) and `rejected`."""
    added = ("lang_pred", "score", "rejected")
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in added])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            letters = _has_letter(data, offsets)
            names, scores, least = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.full(len(letters), np.inf)
            for i, j in chunks(offsets, most_rows=512) if len(model.languages) else ():
                counts = _counts(data, offsets[i : j + 1])
                near = _vectors(counts, model.idf) @ model.centroids.T
                best = near.argmax(axis=1)
                least[i:j] = model.limits(best, counts.sum(axis=1))
                names[i:j] = np.array(model.languages, object)[model.of_centroid[best]]
                scores[i:j] = np.clip(near[np.arange(j - i), best], 0, 1)
            names[~letters], scores[~letters] = UNKNOWN, 0.0
            rejected = ~letters | (scores < least)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                [*batch.schema.names, *added],
            )

    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.mapInArrow(label, schema)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
