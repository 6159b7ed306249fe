import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillroll.llm import tokenfile
from tillroll.sources.shared import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part int, segment string"


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    encoded = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    out, start = [], 0
    for d, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def stored(spark, rows):
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    tokenfile.write_tokens(docs, path, PATH)
    return tokenfile.read_segments(spark, path)


numbers = st.integers(0, 2**64 - 1) | st.integers(0, 49_407) | st.integers(0, 3) | st.sampled_from([2**60 - 1, 2**60, 2**20 - 1])


@settings(max_examples=60, deadline=None)
@given(st.lists(numbers, max_size=400), st.integers(1, 60))
def test_words_round_trip(values, times):
    ids = np.array(values * times, np.uint64)
    data = tokenfile.write_segment([4, None], [1, 2], ids)
    segment = tokenfile.Segment(data)
    assert segment.ids().tolist() == ids.tolist()
    a, b = sorted((len(ids) // 3, len(ids) * 3 // 4))
    assert segment.ids(a, b).tolist() == ids[a:b].tolist()
    assert segment.doc_ids.tolist() == [4, 0] and segment.no_id.tolist() == [False, True]


def test_words_take_the_most_ids_that_fit():
    words, firsts, escapes = tokenfile.encode(np.array([1] * 60 + [2**20 - 1] * 3 + [2**61], np.uint64))
    assert [int(w) >> 60 for w in words] == [1, 12, tokenfile.ESCAPE]
    assert firsts.tolist() == [0] and escapes.tolist() == [2**61]
    ids = np.random.default_rng(1).integers(0, 1 << 15, 100_000).astype(np.uint64)
    assert len(tokenfile.encode(ids)[0]) == -(-4096 // 4) * (100_000 // 4096) + -(-(100_000 % 4096) // 4)


def test_other_data_is_refused():
    with pytest.raises(ValueError):
        tokenfile.Segment(b"x" * 200)


def test_documents_match_brute_force(spark):
    dice = random.Random(2)
    words = ["Hello", "wörld", "éte", "it's", "42", "<|endoftext|>", "…!?", " ", "中文", "\n", "A" * 30]
    rows = [(i * 3 - 20, " ".join(dice.choices(words, k=dice.randrange(60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (2, "twin"), (2, "twin"), (None, "no id"), (1003, "ab" * 5000)]
    dice.shuffle(rows)
    got = tokenfile.read_digests(stored(spark, rows))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([r[:4] for r in brute(rows)], key=repr)


def test_words_give_the_ids_of_their_texts(monkeypatch):
    dice = random.Random(5)
    blanks = " \t\n\r\v\f\x1c\x1f\x85\xa0\u2003\u200b"
    text = "".join(dice.choices("abcdéΣ'st.\u0301\u0345<|>12" + blanks, k=60_000))
    texts = [text[i : i + dice.randrange(1, 90)] for i in dice.choices(range(60_000), k=3000)]
    texts += ["a\0b \0 c", "\0 \0\0", text, "", None, "x" * 3000, "x " * 3000, "ΑΣ ΑΣ. ΑΣ", " \u0301a", "it 's it's IT'S", "\u212b e\u0301"]
    words = tokenfile.Words(PATH)
    for known in (tokenfile.KNOWN, 50):
        monkeypatch.setattr(tokenfile, "KNOWN", known)
        for part in (texts[:1500], texts[1500:]):
            ids, counts = words.encode(pa.array(part), 7)
            want = [[*words._tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in part]
            assert counts.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]
    assert [len(a) for a in words.encode(pa.array([], pa.string()), 7)] == [0, 0]


def test_many_segments(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 3000)
    monkeypatch.setattr(tokenfile, "SLICE", 2000)
    dice = random.Random(6)
    rows = [(i, "a bc déf 12 " * dice.randrange(1, 900)) for i in range(60)]
    segments = stored(spark, rows)
    assert segments.count() > 12
    found = sorted((r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in tokenfile.read_tokens(segments).collect())
    assert found == [(d, s, n, ids) for d, s, n, _, ids in brute(rows)]


def test_empty_table(spark):
    assert tokenfile.read_digests(stored(spark, [])).count() == 0
