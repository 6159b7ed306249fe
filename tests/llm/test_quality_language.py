import re

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import language, quality
from tillroll.llm.bytes import utf8, xxhash64

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "word", "a b\n\na b\nc\n c", "é ü ñ #*$%&|<>", "x " * 3000, "one two\r\none two\r\n", "7 8 9 10", "1 2 3 4 5 6 7 8 " * 3]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 500 else {w for w in windows}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_counts_match_brute_force():
    got = quality.counts(*utf8(pa.array(ODD)))
    rows = list(zip(*[got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True))
    assert rows == [brute_counts(t) for t in ODD]


def test_quality_on_labelled_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").toPandas()
    right = (got.kept == (got.quality_y if "quality_y" in got else got.iloc[:, -2] == 1)).mean()
    assert right > 0.85


def test_quality_with_odd_rows_and_clashing_names(spark):
    rows = [(i, t, 1.0, "z") for i, t in enumerate(ODD)] + [(None, "null id", None, None), (1, "", 2.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept double, base_failed string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (None, 1), (77, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == len(rows)
    nothing = quality.fit(docs, labels.where("false"))
    assert {r.quality for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.where("false"), nothing).count() == 0


def test_language_by_centroids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = language.remainder(docs["doc_id"], 3) == 1
    model = language.fit(docs.where(~held_out))
    got = language.predict(docs.where(held_out), model).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9
    assert not got.rejected.any() and got.score.between(0, 1).all()


def test_language_with_odd_rows(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(ODD)] + [(50, "the the", None, None), (51, "的", "zh", ""), (51, "的", "zh", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    for i in (0, 1, 2, 8, 9):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[51].lang_pred == "zh" and got[50].lang_pred in ("en", "zh")
    nothing = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.where("false"), nothing).count() == 0


def test_hash_of_longs_is_that_of_spark(spark):
    values = [0, 1, -1, 123456789, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v long").selectExpr("xxhash64(v) h")
    assert [r.h for r in frame.collect()] == xxhash64(np.array(values, np.int64)).tolist()


@pytest.mark.parametrize("prior", [0.5, 0.9])
def test_calibration_follows_the_shares(prior):
    dice = np.random.default_rng(1)
    y = dice.integers(0, 2, 4000)
    score = (y * 2 - 1) + dice.normal(0, 2, 4000)
    slope, shift = quality._calibrate(score, y, prior)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    p = 1 / (1 + np.exp(-(slope * score + shift)))
    assert abs(np.average(p, weights=weight) - prior) < 0.03
