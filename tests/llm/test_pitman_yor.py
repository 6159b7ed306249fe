import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import pitman_yor


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def rows():
    dice = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    out = []
    for i in range(200):
        word, text = dice.choice(words), []
        for _ in range(40):  # the next word mostly follows from the last one
            word = words[(words.index(word) * 7 + dice.choice([1, 1, 1, 2, 11])) % 30]
            text.append(word)
        out.append((i, " ".join(text)))
    return [*out, (200, None), (201, ""), (202, "Never SEEN words"), (None, "w1 w2"), (7, out[7][1]), (203, "w1 " * 3000)]


def test_scores(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in data], "doc_id long, text string, score double, texts int")
    train = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False))
    got = pitman_yor.score(docs, train).toPandas()
    assert len(got) == len(data)
    learned = [d is not None and d % 7 != 2 for d, _ in data]
    c = collections.Counter(w for (_, t), use in zip(data, learned, strict=True) if use for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        repr((d, not use, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)))
        for (d, t), use in zip(data, learned, strict=True)
    )
    found = sorted(
        repr((None if np.isnan(r.doc_id) else int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        for r in got.itertuples()
    )
    assert found == want
    held = got[got.held_out & (got.doc_id < 200)]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()
    again = pitman_yor.score(docs, train).toPandas()
    assert sorted(again.score.round(9)) == sorted(got.score.round(9))
    assert pitman_yor.score(docs.where("false"), train).count() == 0


def test_probabilities_add_up_to_one():
    key = np.sort(np.array([(w << 8) | u for w in range(1, 40) for u in (3, w % 5)], np.uint64))
    key = np.unique(key)
    count = np.random.default_rng(0).integers(1, 50, len(key))
    s = pitman_yor.Seating(key, count, None)
    totals = pitman_yor.Totals(
        np.bincount(s.context, count, 256), len(s.first), 0.7, 0.6, [np.bincount(s.context, minlength=256).astype(float)], [float(len(s.first))]
    )
    for k in range(1, 4):
        t = pitman_yor.Seating(key, count, totals)
        for earlier in range(k):
            t.sweep(earlier)
        totals.tables.append(np.bincount(t.context, t.tables, 256))
        totals.parent_tables.append(float(t.parent_tables.sum()))
    model = pitman_yor.Predictive(key, count, totals, 1)
    for context in (3, 1, 200):
        every = np.array([(w << 8) | context for w in range(0, 40)], np.uint64)  # 0 stands for all unseen
        assert abs(model.look(every)[1].sum() - 1) < 1e-9


def test_every_context_has_its_own_restaurant(spark):
    # Each of 3,000 words is always followed by a word of its own.
    dice = random.Random(5)
    texts = [" ".join(f"a{i} b{i}" for i in dice.sample(range(3000), 1000)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pitman_yor.score(docs, F.col("doc_id") < 36).where("held_out").toPandas()
    # The second words are all but certain; the first ones have one chance in 3,000.
    assert got.score.sum() / got.n_tokens.sum() > -2.0
