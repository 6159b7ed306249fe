import random
import re

import numpy as np
import pytest
import xxhash

from tillroll.llm import simhash
from tillroll.llm.components import components, forest

SCHEMA = "doc_id long, text string, fp string, root int"


def brute_fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [words] if len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[find(i)] = min(d, lowest.get(find(i), d))
    return sorted((d, f"{fps[i]:016x}", lowest[find(i)]) for i, (d, _) in enumerate(rows))


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())


def test_matches_brute_force_with_odd_rows(spark):
    dice = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(dice.choices(words, k=60))) for i in range(40)]
    for i in range(40, 160):  # near copies of a few texts, in chains
        base = rows[dice.randrange(i) if i > 80 else i % 3][1].split()
        base[dice.randrange(len(base))] = dice.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "ONE two"), (205, "É Éa x y é"), (206, "é éa x y é")]
    rows += [(207, "one  Two"), (3, rows[3][1]), (3, rows[3][1]), (208, "a " * 5000)]
    assert result(spark, rows) == brute_components(rows)


def test_dense_group_gives_no_pairs(spark):
    fps = np.array([0] + [1 << b for b in range(64)] + [1 << a | 1 << b for a in range(64) for b in range(a)], np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(frame).collect()
    assert all(0 < (r.a ^ r.b).bit_count() <= 64 for r in links)
    assert len(links) < 40 * len(fps)
    roots = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node for r in roots} == set(fps.view(np.int64).tolist())
    assert len({r.root for r in roots}) == 1


def test_empty_table_and_null_id(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, "a b c d")]) == [(None, f"{brute_fingerprint('a b c d'):016x}", None)]


def test_other_distances_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), 5)


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_forest_keeps_components():
    a, b = np.array([5, 6, 9, 9]), np.array([6, 7, 10, 9])
    x, y = forest(a, b)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(6, 5), (7, 5), (10, 9)]
