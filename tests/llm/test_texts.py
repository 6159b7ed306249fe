import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from tillroll.llm import bpe, chat, decontaminate, licenses, sharding, suffixes

WORDS = [f"{a}{b}{c}" for a in ("the", "ver", "on") for b in ("an", "é", "ing", "st") for c in ("", "ly", ".")]


def brute_cut(rows):
    texts = sorted(((d, (t or "").encode()) for d, t in rows if d is not None), key=lambda r: r[0])
    first = {}
    for d, b in texts:
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_suffixes_match_brute_force(spark):
    dice = random.Random(3)
    long = [" ".join(dice.choices(WORDS, k=dice.randrange(5, 90))) for _ in range(60)]
    rows = []
    for i in range(120):
        parts = [dice.choice(long)[dice.randrange(20) :] for _ in range(dice.randrange(1, 4))]
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "b" + "a" * 300), (204, "x" * 49), (205, "x" * 50), (206, "x" * 50)]
    rows += [(None, long[0] * 2), (5, rows[5][1]), (5, "other " + rows[7][1]), (207, "é" * 60), (208, "yé" + "é" * 60), (-3, long[1])]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, kept int, block string")
    got = suffixes.remove_repeats(docs)
    assert got.columns == ["doc_id", "block", "n_bytes", "kept", "spans"]
    found = sorted(((r.doc_id, bytes(r.kept)) for r in got.collect()), key=repr)
    assert found == brute_cut(rows)
    assert suffixes.remove_repeats(docs.where("false")).count() == 0


def test_index_family_merges_levels():
    dice = np.random.default_rng(2)
    family, smallest, settled = suffixes.IndexFamily(), {}, set()
    for _ in range(16):
        context = dice.integers(0, 500, 300).astype(np.uint64)
        doc = dice.integers(0, 1000, 300).astype(np.int64)
        for docs, keys in family.add((context % np.uint64(7), context, doc)):
            settled |= set(zip(docs.tolist(), keys.tolist(), strict=True))
        for c, d in zip(context.tolist(), doc.tolist(), strict=True):
            smallest.setdefault(c, set()).add(d)
        assert len(family.levels) <= 12
    assert settled == {(d, c) for c, ds in smallest.items() for d in ds if d > min(ds)}


def test_bpe_matches_tiktoken(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(9)
    texts = [None, "", " ", "\n\n  \t x", "it's we'll 12345 ½ ²", "日本語 ünïcödé 😀😀", "a" * 300, "<|endoftext|> \x1c\x85　z", "!?!?--"]
    texts += [" ".join(dice.choices(WORDS, k=50)) + "  \n" for _ in range(20)]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "null id", 1, None), (3, texts[3], 1, None), (90, texts[9], 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, block string")
    got = sorted((repr((r.doc_id, r.n_tokens, r.ids, bytes(r.decoded))) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN, blocks=3).collect()))
    want = []
    for d, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append(repr((d, len(ids), " ".join(map(str, ids)), (t or "").encode())))
    assert got == sorted(want)


def test_rank_file_is_read():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        token, rank = next(iter(lines)).split()
    assert ranks[base64.b64decode(token)] == int(rank)


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "assistant", "<s>[x] 100% </s>\n%3C"), (1, 0, "user", "hi"), (2, 0, "assistant", "first"), (3, 0, "user", None),
        (3, 1, "assistant", ""), (4, 0, "we]ird", "[INST]"), (4, None, None, "x"), (None, 0, "user", "no id"),
        (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "é" * 5000),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, valid int")
    formatted = chat.format_chats(frame)
    got = {r.conv_id: r for r in formatted.withColumn("t", chat.read_turns(formatted["formatted"])).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [(t.role, t.text) for t in got[conv].t] == want
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
    assert {c for c, r in got.items() if r.valid} == {1, 3, 6}
    told = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert told[6].loss_chars == 5000 and told[6].loss_sha256 == hashlib.sha256(("é" * 5000).encode()).hexdigest()
    assert chat.format_chats(frame.where("false")).count() == 0


def test_shards_are_even(spark):
    dice = random.Random(4)
    rows = [(i, "x" * dice.randrange(400)) for i in range(600)] + [(i, "copy " * 20) for i in range(600, 900)]
    rows += [(None, None), (None, ""), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, shard int, size int")
    got = sharding.shard(docs, 8, ranges_per_shard=16).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max() and len(sizes) == 8
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard(docs.where("false"), 8).count() == 0


ITEM = "Mr Smith sold 12 apples for 5 dollars and then Mr Smith bought 7 pears in the town of York on the same day"


def test_decontamination_finds_rewordings(spark):
    other = ITEM.replace("Smith", "Jones").replace("12", "1,300").replace("York", "Leeds")
    uneven = ITEM.replace("Smith sold", "Jones sold")
    filler = " ".join(random.Random(1).choices(WORDS, k=80))
    rows = [(1, f"{filler} {ITEM}. {filler}"), (2, f"{filler}\n{other}"), (3, f"{filler}\n{uneven}"), (4, filler), (5, None), (6, ""), (1, ITEM), (None, ITEM)]
    rows += [(7, "12 5 7 " * 50), (8, ITEM[:40]), (9, ITEM.lower())]
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, item_id int, hash string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (13, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 10): False, (1, 13): False, (2, 10): True, (2, 13): True}
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_licenses(spark):
    lines = {
        "Released under the MIT License.": "MIT",
        "licensed under the apache license, version 2.0": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "All rights reserved.": "proprietary",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "He lost his driving license last week.": "unknown",
    }
    rows = [(i, f"text\n{t}\nmore text") for i, t in enumerate(lines)] + [(50, None), (51, ""), (0, "x"), (None, "MIT License")]
    docs = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, line_no int, family string")
    model = licenses.fit(docs)
    got = {r.doc_id: r for r in licenses.scan(docs, model).where("doc_id is not null").collect()}
    assert {i: got[i].family for i in got} == dict(enumerate(lines.values()))
    assert [i for i in got if got[i].confirmed] == [i for i in got if got[i].family != "unknown"]
    assert licenses.scan(docs.where("false"), model).count() == 0


def test_long_words_equal_tiktoken(spark):
    """Words beyond the length from which all pairs of a rank are merged at once."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(1)
    words = ["a" * n for n in (1, 255, 256, 257, 258, 999)] + ["ab" * 500, "aab" * 400, "x" * 20_000]
    words += ["".join(dice.choices("abcdeé", k=n)) for n in (300, 1000, 3000)]
    table = bpe.RankTable(ranks)
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    coded = df.select("w", bpe.encode_word(F.col("w"), table).alias("ids"))
    for r in coded.select("*", bpe.decode_ids(F.col("ids"), table).alias("back")).collect():
        assert r.ids == own.encode_ordinary(r.w)
        assert bytes(r.back) == r.w.encode()


def test_cut_words_come_back():
    cut = bpe.split_pattern(public_tokenizers.PATTERN)
    texts = ["", "a b", "é" * 127 + " " + "x" * 254 + " " + "y" * 255 + " " + "z" * 256 + " " + "w" * 1021, "", " 中文 12"]
    text, cuts = bpe._cut(texts, cut)
    words, ends = bpe._words(pa.table({"text": text, "cuts": cuts}).slice(1))
    found = [cut.findall(t) for t in texts[1:]]
    assert words.to_pylist() == [w for f in found for w in f]
    assert ends.tolist() == np.cumsum([0, *map(len, found)]).tolist()
