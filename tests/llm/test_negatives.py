import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import negatives
from tillroll.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, slot string"


def brute(rows, step, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = []
    for i, (vec, emb, label, *_) in enumerate(rows):
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        kept.append((i, vec, label, [math.floor(scale * float(np.float32(x))) for x in emb]))

    def order(pair):
        return -pair[0], pair[1] is None, pair[1] or 0

    out = []
    for i, vec, label, a in kept:
        if vec is None or vec % step:
            continue
        scored = [(sum(p * q for p, q in zip(a, x)), v, other) for j, v, other, x in kept if j != i]
        best = sorted([(s, v) for s, v, other in scored if other == label], key=order)[:positives]
        for p, pid in best:
            fits = sorted([(s, v) for s, v, other in scored if other != label and low * p <= 100 * s <= high * p], key=order)
            out += [(vec, pid, r, nid, p, s) for r, (s, nid) in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


def clustered(n, dims, seed, labels=3):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(6, dims))
    vectors = centres[dice.integers(0, 6, n)] + dice.normal(size=(n, dims)) * 0.4
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return [(i, v.astype(np.float32).tolist(), int(dice.integers(0, labels))) for i, v in enumerate(vectors)]


def found(spark, rows, step=5, **how):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in hard_negatives(docs, F.col("vec_id") % step == 0, **how).collect()], key=repr)


@pytest.mark.parametrize(("n", "dims", "small"), [(300, 64, False), (260, 10, True), (200, 2, True)])
def test_matches_brute_force(spark, monkeypatch, n, dims, small):
    if small:  # many chunks, blocks and stripes; workers take the driver's constants along
        monkeypatch.setattr(negatives, "CHUNK", 40 * dims)
        monkeypatch.setattr(negatives, "BLOCK", 7 * dims)
        monkeypatch.setattr(negatives, "PASS", 9000)
    rows = clustered(n, dims, dims)
    assert found(spark, rows) == brute(rows, 5) != []


def test_nulls_ties_and_odd_lengths(spark):
    dice = random.Random(4)
    rows = clustered(80, 8, 1, labels=2)
    rows += [(5, rows[5][1], rows[5][2]), (100, rows[5][1], rows[5][2]), (7, rows[6][1], 1 - rows[6][2])]
    rows += [(200 + i, rows[0][1], i % 2) for i in range(40)]  # one vector many times
    rows += [(300, None, 1), (305, [0.1, None], 1), (310, [float("nan")] * 8, 0), (315, [float("inf")] * 8, 0), (320, rows[3][1], None)]
    rows += [(None, rows[0][1], 0), (None, rows[10][1], 1), (325, [], 0), (330, [0.5] * 3, 1), (335, [0.2] * 20, 0)]
    rows += [(340, [-x for x in rows[0][1]], 0), (345, [1e12] * 8, 1), (350, [9e11] * 8, 1), (351, [4e11] * 8, 0)]
    dice.shuffle(rows)
    assert found(spark, rows) == brute(rows, 5)


def test_other_numbers(spark):
    rows = clustered(150, 16, 9)
    how = {"positives": 2, "negatives": 4, "low": 10, "high": 80, "scale": 100.0}
    assert found(spark, rows, 3, **how) == brute(rows, 3, **how)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []


def test_bounds_hold():
    dice = np.random.default_rng(3)
    a, x = (np.floor(256 * dice.normal(size=(50, 24))) for _ in range(2))
    exact = a @ x.T
    packed = [negatives.Packed(negatives.pack(np.arange(50), np.ma.masked_array(np.arange(50)), np.zeros(50, int), v)) for v in (a, x)]
    width = np.inf
    for (ma, da), (mx, dx) in zip(packed[0].levels, packed[1].levels, strict=True):
        gap = np.abs(exact - ma @ mx.T) - da @ dx.T
        assert gap.max() < negatives.SLACK * 1e6
        assert (da @ dx.T).mean() < width  # finer segments bound closer
        width = (da @ dx.T).mean()
