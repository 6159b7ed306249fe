import itertools
import math
import random

from tillroll.llm import licenses
from tillroll.llm.licenses import UNKNOWN, LicenseModel, strong_words


def test_paragraphs_without_strong_words_stay_unknown():
    """Every paragraph over the grams of a small model, against its weights."""
    dice = random.Random(7)
    for _ in range(40):
        grams = ["a", "b", "c", "d", "a b", "b c", "c d", "d a"]
        families = ["A", "B", UNKNOWN]
        weights = {g: [dice.gauss(0, 2) for _ in families] for g in grams}
        model = LicenseModel(families, weights, [dice.gauss(-1, 1), dice.gauss(-1, 1), 2.0], 1.0)
        strong = strong_words(model)
        if strong is None:
            assert max(model.bias[:2]) >= 2.0 - 1e-3
            continue
        for n in range(1, 5):
            for words in itertools.product("abcd", repeat=n):
                if set(words) & set(strong):
                    continue
                held = {*words, *(" ".join(p) for p in itertools.pairwise(words))} & set(grams)
                z = [sum(weights[g][i] for g in held) / math.sqrt(len(held)) + model.bias[i] for i in range(3)]
                assert max(z) == z[2]


def test_documents_with_templates_are_read(spark):
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licenses.fit(plain)
    strong = strong_words(model)
    assert strong is not None
    templates = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    # What is said of others may look like a family, but is not confirmed.
    foreign = ["Licensed under the ISC License", "Eclipse Public License 2.0", "The Apache helicopter flew over the city.", "Version 3 of the software is out."]
    texts = [f"Plain words of the day.\n{t}" for _, t in templates] + foreign
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(docs, model).collect()
    assert {(r.doc_id, r.family) for r in got if r.confirmed} == {(i, f) for i, (f, _) in enumerate(templates)}
