import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_simhash import brute_components
from tests.llm.test_texts import ITEM, WORDS, brute_cut
from tillroll.llm import bpe


def fixture():
    dice = random.Random(12)
    rows = [(i, " ".join(dice.choices(WORDS, k=60)).capitalize(), "en") for i in range(40)]
    passage = " ".join(dice.choices(WORDS, k=60))
    rows += [(40, rows[3][1], "en"), (41, rows[3][1] + " once more", "en"), (42, f"{rows[5][1]}\n{passage}", "en")]
    rows += [(43, " ".join(dice.choices(WORDS, k=50)) + f" {passage} " + " ".join(dice.choices(WORDS, k=50)), "en")]
    rows += [(44, " ".join(dice.choices(WORDS, k=50)) + f". {ITEM}. " + " ".join(dice.choices(WORDS, k=50)), "en")]
    rows += [(45, "1234 5678 !!", None), (46, None, "en"), (47, "", "en"), (48, "é" * 200, "fr"), (49, "y" + "é" * 200, "fr")]
    return [(d, t, lang, "src", len(t or "")) for d, t, lang in rows]


def brute(rows):
    left = {d: t for d, t, *_ in rows if t and any(map(str.isalpha, t))}
    left = {d: left[d] for d, _, root in brute_components(sorted(left.items())) if d == root}
    cut = {}
    for d, kept in brute_cut(sorted(left.items())):
        if kept or not left[d]:
            cut[d] = kept.decode("utf-8", "ignore")
    return {d: t for d, t in cut.items() if "apples for 5 dollars" not in t}


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert {d: bytes(r.decoded).decode() for d, r in got.items()} == want
    assert 40 not in got and 44 not in got and 45 not in got and 46 not in got and 43 in got
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {d: r.ids for d, r in got.items()} == {d: " ".join(map(str, encoding.encode_ordinary(t))) for d, t in want.items()}
    assert all(r.n_chars == len(want[d]) for d, r in got.items())


def test_stages_keep_the_columns(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_level_bpe",
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
