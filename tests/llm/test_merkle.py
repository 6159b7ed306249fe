import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tillroll.llm import merkle
from tillroll.llm.queries import op11_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def way(tree, i, fanout):
    steps = []
    for nodes in tree[:-1]:
        first = i - i % fanout
        steps.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        i //= fanout
    return steps


def brute(rows, fanout=2):
    def key(r):
        return (r[2] is not None, (r[2] or "").encode())

    names = sorted({key(r) for r in rows})
    trees, members = {}, {}
    for name in names:
        own = sorted([r for r in rows if key(r) == name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        members[name], trees[name] = own, levels([leaf(*r) for r in own], fanout)
    top = levels([trees[n][-1][0] for n in names], fanout)
    root, out = top[-1][0], []
    for t, name in enumerate(names):
        for i, (doc, source, lang, n, text) in enumerate(members[name]):
            steps = way(trees[name], i, fanout) + way(top, t, fanout)
            changed = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            node = leaf(doc, source, lang, n + changed if n is not None else None, text)
            for before, after in steps:
                node = sha(*before, node, *after)
            proof = sha(*[s for before, after in steps for s in (*before, *after)])
            out.append((doc, trees[name][0][i], trees[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def rows_of(n, langs, seed):
    dice = random.Random(seed)
    rows = [(i, dice.choice(["web", None]), dice.choice(langs), dice.choice([i, i, None]), "x" * (i % 5)) for i in range(n)]
    return rows + [(3, "é", langs[0], 1, None), (3, "é", langs[0], 1, None), (None, None, langs[-1], 9, ""), (-5, "a", None, 0, "long " * 5000)]


@pytest.mark.parametrize(("n", "langs", "fanout"), [(0, ["en"], 2), (1, ["é", "z"], 2), (200, ["en", "de", "", None, "fr"], 2), (700, ["en"], 2), (150, ["en", "de"], 3), (90, [f"l{i}" for i in range(80)], 5)])
def test_audit_matches_brute_force(spark, n, langs, fanout):
    rows = rows_of(n, langs, n)
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA).repartition(5)
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    if fanout == 2:
        got = merkle.audit(docs, changed)
        assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)
        return
    leaves = docs.select(F.col("lang").alias("tree"), "doc_id", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("digest"))
    found = merkle.proofs(merkle.manifest(leaves, ["doc_id"], fanout)).select("doc_id", "digest", "subroot", merkle.proof_digest(F.col("steps")))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == sorted([(r[0], r[1], r[2], r[4]) for r in brute(rows, fanout)], key=repr)


def test_node_intervals_nest(spark):
    leaves = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("tree"), "id", merkle.leaf(F.col("id")).alias("digest"))
    nodes = merkle.manifest(leaves, ["id"]).nodes().collect()
    for tree, n in (("=a", 200), ("", 100)):
        own = {(r.level, r.lo): r for r in nodes if r.tree == tree}
        assert sorted(r.lo for r in own.values() if r.level == 0) == list(range(n))
        for r in own.values():
            if r.parent_lo is None:
                assert (r.lo, r.hi) == (0, n)
                continue
            parent = own[r.level + 1, r.parent_lo]
            assert parent.hi == r.parent_hi and parent.lo <= r.lo < r.hi <= parent.hi
            inside = [own[r.level, lo] for lo in range(parent.lo, parent.hi, 1 << r.level)]
            assert parent.digest == sha(*[c.digest for c in inside])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = merkle.audit(docs, F.lit(True))
    assert got.count() == 0 and got.columns[:4] == ["doc_id", "leaf", "subroot", "root"]


def test_query_finds_changed_rows(spark):
    got = op11_merkle(spark, "/root/testdata/sf0.001").collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
