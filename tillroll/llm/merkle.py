"""Merkle manifests: one digest per row, one tree per group of rows, one root over all groups.

A node is labelled by the interval [lo, hi) of leaf ranks that it covers. Levels are bucketed
into bands of a few levels each; the entries of a band meet the nodes of their bucket in a
containment join: a node whose parent's interval holds the entry, but whose own does not, is a
sibling on the way to the root. A bucket has at most WIDTH entries, so neither a large group
nor a repeated row makes a hot key, and what lies above a bucket is attached to it once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.sources.shared import stage

#: Most entries of a bucket.
WIDTH = 64

_STEPS = "array<struct<before: string, after: string>>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated inputs."""
    return F.sha2(F.concat(*inputs), 256)


def leaf(*values: Column) -> Column:
    """The digest of typed values: `-` for null, else the byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


@dataclass(frozen=True)
class Manifest:
    """`leaves` (tree, pos, size, digest and the columns that came along), `bands` (the nodes,
    as written), `tops` (tree, subroot, steps from there to the root), `root` (null if there
    is no leaf)."""

    leaves: DataFrame
    bands: list[DataFrame]
    tops: DataFrame
    root: str | None
    fanout: int

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, parent_lo, parent_hi, digest) of all nodes up to the subroots."""
        rows = [_nodes(band, b, self.fanout) for b, band in enumerate(self.bands)]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out.drop("bucket")


def _levels(fanout: int) -> int:
    """Levels of a band."""
    levels = 1
    while fanout ** (levels + 1) <= WIDTH:
        levels += 1
    return levels


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `pos`, gapless from 0 within each `tree` by `order`, and `size`, the rows of
    the tree. Rows are sorted over all trees, so that a large tree is spread over tasks; ties
    keep any order of their own. `tree` must not be null."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    in_order = numbered.orderBy("tree", *order, "_row").drop("_row")
    placed = stage(in_order.withColumn("_place", F.monotonically_increasing_id()), "placed")
    # The upper bits of a place are its partition; partitions and trees are few against rows.
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("_n").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = stage(
        runs.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(by_tree).alias("size")),
        "shifts",
    )
    return placed.join(shifts, ["tree", "_part"]).withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _build(entries: DataFrame, fanout: int) -> list[DataFrame]:
    """Bands from the leaves up: (tree, n, size, bucket, levels) with the digests of a bucket's
    levels. `n` counts the leaves of the tree, `size` its entries in the band."""
    levels = _levels(fanout)
    width = fanout**levels

    def up(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, fanout), ""), 256))

    def grown(below: Column, _: Column) -> Column:
        last = F.element_at(below, -1)
        done = (F.col("size") <= width) & (F.size(last) == 1)
        return F.when(done, below).otherwise(F.concat(below, F.array(up(last))))

    rows = entries.select("tree", F.col("size").alias("n"), "size", "pos", "digest")
    largest = rows.agg(F.max("size")).head()[0] or 0
    bands = []
    while largest:
        buckets = rows.groupBy("tree", "n", "size", F.expr(f"pos div {width}").alias("bucket")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"].alias("lowest")
        )
        folded = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array("lowest"), grown)
        bands.append(stage(buckets.select("tree", "n", "size", "bucket", folded.alias("levels")), "band"))
        rows = bands[-1].where(F.col("size") > width).select(
            "tree", "n", F.expr(f"(size + {width - 1}) div {width}").alias("size"), F.col("bucket").alias("pos"),
            F.element_at(F.element_at("levels", -1), 1).alias("digest"),
        )
        largest = -(-largest // width) if largest > width else 0
    return bands


def _ends(band: DataFrame, fanout: int) -> DataFrame:
    """The trees whose root lies in this band."""
    return band.where(F.col("size") <= fanout ** _levels(fanout))


def _nodes(band: DataFrame, b: int, fanout: int) -> DataFrame:
    """The nodes of a band with their intervals of leaf ranks. Its top level is the lowest one
    of the next band and listed there, but for roots, which have no parent."""
    levels = _levels(fanout)
    spans = F.array(*[F.lit(fanout ** (b * levels + h)) for h in range(levels + 2)])
    rows = band.select("tree", "n", "size", "bucket", F.posexplode("levels").alias("_h", "_digests"), F.size("levels").alias("_height"))
    rows = rows.where((F.col("_h") < levels) | (F.col("size") <= fanout**levels))
    nodes = rows.select("*", F.posexplode("_digests").alias("_i", "digest"))
    inside = F.array(*[F.lit(fanout ** (levels - h)) for h in range(levels + 1)])
    index = F.col("bucket") * F.get(inside, F.col("_h")) + F.col("_i")
    span, wider = F.get(spans, F.col("_h")), F.get(spans, F.col("_h") + 1)
    lo, parent_lo = index * span, F.floor(F.col("_i") / fanout) * wider + F.col("bucket") * F.lit(fanout ** (levels * (b + 1)))
    has_parent = (F.col("size") > fanout**levels) | (F.col("_h") < F.col("_height") - 1)
    return nodes.select(
        "tree", "bucket",
        (F.col("_h") + b * levels).alias("level"),
        lo.alias("lo"),
        F.least(lo + span, "n").alias("hi"),
        F.when(has_parent, parent_lo).alias("parent_lo"),
        F.when(has_parent, F.least(parent_lo + wider, "n")).alias("parent_hi"),
        "digest",
    )


def _proofs(entries: DataFrame, bands: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """`entries` with `subroot` and `steps` (the siblings before and after, per level) up to
    the root. `tops` says how each tree goes on from its subroot."""
    levels = _levels(fanout)
    width = fanout**levels
    above = None
    for b in reversed(range(len(bands))):
        band = bands[b]
        here = entries if b == 0 else band_entries(bands[b - 1], width)
        kept = [c for c in here.columns if c not in ("tree", "pos", "size", "digest")]
        here = here.select("tree", "pos", F.expr(f"pos div {width}").alias("bucket"), (F.col("pos") * F.lit(width**b)).alias("_rank"), F.struct(F.col("digest"), *kept).alias("_row"))
        nodes = _nodes(band, b, fanout).where("parent_lo is not null").withColumnsRenamed({"tree": "_tree", "bucket": "_bucket", "digest": "_sibling"})
        # Inside the parent's interval, outside the node's own.
        beside = (
            (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket"))
            & (F.col("_rank") >= F.col("parent_lo")) & (F.col("_rank") < F.col("parent_hi"))
            & ((F.col("_rank") < F.col("lo")) | (F.col("_rank") >= F.col("hi")))
        )
        sibling = F.struct("level", "lo", (F.col("lo") < F.col("_rank")).alias("before"), F.col("_sibling").alias("digest"))
        found = here.join(nodes, beside, "left").groupBy("tree", "bucket", "pos").agg(
            F.any_value("_row").alias("_row"),
            F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), sibling))).alias("_siblings"),
        )
        heights = _ends(band, fanout).join(tops, "tree").select(
            "tree", "bucket", "subroot", "steps", (F.size("levels") - 1).alias("_height")
        )
        if above is not None:
            heights = heights.unionByName(above.select("tree", F.col("pos").alias("bucket"), "subroot", "steps", F.lit(levels).alias("_height")))
        joined = found.join(heights, ["tree", "bucket"])
        own = F.when(F.col("_height") > 0, F.transform(F.sequence(F.lit(0), F.col("_height") - 1), lambda h: _step(F.col("_siblings"), h + b * levels)))
        steps = F.concat(F.coalesce(own, F.array().cast(_STEPS)), F.col("steps"))
        above = joined.select("tree", "pos", "_row.*", "subroot", steps.alias("steps"))
    return above


def band_entries(band: DataFrame, width: int) -> DataFrame:
    """The tops of a band's buckets, which are the entries of the next band."""
    top = F.element_at(F.element_at("levels", -1), 1)
    return band.where(F.col("size") > width).select("tree", F.col("bucket").alias("pos"), top.alias("digest"))


def _step(siblings: Column, level: Column) -> Column:
    def joined(before: bool) -> Column:
        side = F.filter(siblings, lambda s: (s["level"] == level) & (s["before"] == F.lit(before)))
        return F.array_join(F.transform(side, lambda s: s["digest"]), "")

    return F.struct(joined(True).alias("before"), joined(False).alias("after"))


def manifest(leaves: DataFrame, order: list[str], fanout: int = 2) -> Manifest:
    """The trees over `leaves` (tree, digest, the columns of `order` and any others).

    A null tree is a tree of its own and comes first; trees are ordered by the bytes of their
    name. Within a tree leaves ascend by `order`, then by digest; nulls come first. Every
    `fanout` consecutive nodes have one parent, the last ones, fewer, as well. Equal rows are
    leaves of their own. Without leaves there is no root. Columns must not be named as those
    of the manifest (pos, size, bucket, subroot, steps)."""
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("")))
    own = stage(ranked(stage(named, "leaves"), [*order, "digest"]), "ranked")
    bands = _build(own, fanout)
    none = F.array().cast(_STEPS)
    if not bands:
        nothing = own.select("tree", F.col("digest").alias("subroot"), none.alias("steps"))
        return Manifest(own, bands, nothing, None, fanout)
    roots = [_ends(band, fanout).select("tree", F.element_at(F.element_at("levels", -1), 1).alias("digest")) for band in bands]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    listed = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    listed = stage(listed, "subroots")
    top_bands = _build(listed, fanout)
    root = _ends(top_bands[-1], fanout).select(F.element_at(F.element_at("levels", -1), 1)).head()[0]
    start = listed.select("tree").limit(1).select("tree", F.lit(root).alias("subroot"), none.alias("steps"))
    ways = _proofs(listed, top_bands, start, fanout)
    tops = stage(ways.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "steps"), "tops")
    return Manifest(own, bands, tops, root, fanout)


def proofs(built: Manifest) -> DataFrame:
    """All leaves with `subroot` and `steps`: per level, the joined digests of the siblings
    before and after the node, up to the root."""
    if not built.bands:
        none = built.leaves.withColumns({"subroot": F.lit(None).cast("string"), "steps": F.array().cast(_STEPS)})
        return none.drop("size")
    return _proofs(built.leaves, built.bands, built.tops, built.fanout)


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda node, s: digest(s["before"], node, s["after"]))


def audit(docs: DataFrame, changed: Column) -> DataFrame:
    """The manifest of documents, one tree per language, and each row checked against it as if
    `n_chars` had grown by one where `changed` holds.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per
    document. A null `changed` or a null n_chars changes nothing; nulls of other columns and
    empty texts have leaves like any other; an empty table gives no rows; further columns are
    not looked at."""
    grown = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(
        F.col("lang").alias("tree"),
        "doc_id",
        leaf(*values).alias("digest"),
        F.when(changed & F.col("n_chars").isNotNull(), leaf(*values[:3], grown, values[4])).alias("changed_leaf"),
    )
    built = manifest(leaves, ["doc_id"])
    root = F.lit(built.root).cast("string")
    folded = fold(F.coalesce("changed_leaf", "digest"), F.col("steps"))
    checked = proofs(built).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
