"""Licence scans over the paragraphs of documents, by column expressions only.

A paragraph is a line, or a line and what follows it before the next line without words, as far
as a template can reach; the latter counts if the line alone belongs to no family and what
follows, without the line, holds less of a template. Its sparse features are the words and word pairs that also occur in the
licence templates; a multinomial logistic regression over them, trained on the templates and
on a bounded number of other lines, gives every family and `unknown` a probability, which a
temperature fitted on rows kept out of the training calibrates. Plain sentences and statements of
foreign licences are `unknown`. A family is confirmed if the paragraph also holds enough of the
words of one of its templates, among them all that tell it from other families.

What the model cannot give to a family is passed over: documents without a strong gram (see
strong_words), and in the others lines without a word that a gram begins with which speaks for a
family more than for `unknown`. Null and empty texts have no lines; repeated rows are kept; an empty
table gives no rows; other columns are not read."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentences by which each family is stated.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the Apache License 2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GPL version 3",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright: CC0 1.0, public domain.",
        "Dedicated to the public domain under the CC0 license.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved. No part may be copied without permission.",
        "Confidential and proprietary; copyright of the company.",
    ],
}
# Lines with one of these are not learned from as plain lines.
CUES = ("licen", "copyright", "rights reserved", "permission is hereby", "redistribut", "public domain")
# Lines about licences in the plain sense, which belong to no family.
OTHERS = [
    "He lost his driving license last year.",
    "The dog license costs ten dollars.",
    "She took some poetic license with the story.",
    "A fishing licence is required here.",
    "The license was renewed by the office.",
    "They argued about copyright for hours.",
    "The permission is hereby refused.",
    "The museum is open and in the public domain of the city.",
    "The state redistributed the land.",
    "licensed drivers only",
    "Our table has the rights reserved for guests.",
    "The Apache helicopter flew over the city.",
    "Version 3 of the software is out.",
    "Version 2.0 of the program was released to the public in the spring.",
    "The free software for this work may be used without charge by any person.",
    "He got a copy of the source code and the binary from the author.",
    "The general said that the public may use this form.",
    "You may not go to the house without the key that is under the stone.",
    "It is subject to change, and all of the terms are part of this work.",
    "In this part of the world the law is made by the people and for the people.",
    "The creative commons room is by the door, and you can use it to read.",
    "Attribution of the work to the author is to be done by the company.",
    "The MIT campus is by the river in the east of the city.",
    "This is the source of the water, and these are the forms in use.",
    "With or without the permission of the king, the people modify and copy the form.",
    "The lesser of the two was distributed to any person on the list.",
    "Only the owner can give the work to you under these terms.",
    "International trade and the extent of possible use are of no concern to us.",
    "The charge was free of error, and the program is granted to you hereby.",
    "This project has a public list of names, dates and places.",
    "A domain name is not the same as a public place or a redistribution.",
]
# How licences are stated that are none of the families.
FOREIGN = [
    "Licensed under the ISC License.",
    "Released under the zlib license.",
    "Eclipse Public License 2.0",
    "Licensed under the Eclipse Public License, version 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: ISC",
    "Licensed under the Artistic License 2.0.",
    "Released under the Boost Software License, version 1.0.",
    "This work is licensed under the Open Software License, version 3.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Python Software Foundation License, version 2.",
    "Released under the Unlicense.",
    "SPDX-License-Identifier: Zlib",
    "Licensed under the Common Development and Distribution License, version 1.0.",
]
UNKNOWN = "unknown"
OTHER_LINES = 500
LEAST_PROBABILITY = 0.5
LEAST_SHARE = 0.6
# Slots of the table of grams, of which there are some hundreds.
SLOTS = 4096


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def _variants(sentence: str) -> list[str]:
    """The sentence as it stands in other surroundings, and with a word left out."""
    words = sentence.split()
    out = [sentence, f"This project is {sentence}", f"{sentence} See the file for details.", f"2020 the authors {sentence}"]
    step = max(1, len(words) // 5)
    return out + [" ".join(words[:i] + words[i + 1 :]) for i in range(0, len(words), step)] if len(words) > 2 else out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _pairs(words: Column, pair) -> Column:
    """pair(a, b) of all words and the ones after them."""
    fewer = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, fewer), F.slice(words, 2, fewer), pair)


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, _pairs(words, lambda a, b: F.concat(a, F.lit(" "), b))))


def _grams_among(words: Column, among: Column) -> Column:
    """The grams, in the same order, whose words are all in `among`."""
    held = lambda w: F.array_contains(among, w)
    pairs = _pairs(words, lambda a, b: F.when(held(a) & held(b), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(F.filter(words, held), F.array_compact(pairs)))


REACH = max(len(t.split()) for ts in TEMPLATES.values() for t in ts) * 2


def cue_words(model: LicenseModel) -> list[str] | None:
    """Words of which a line must hold one to reach LEAST_PROBABILITY for a family: its score must
    be above that of `unknown`, so some gram must speak for it if the bias does not. None if the
    bias does for any family."""
    out = model.families.index(UNKNOWN)
    if any(b >= model.bias[out] for i, b in enumerate(model.bias) if i != out):
        return None
    return sorted({g.split()[0] for g, w in model.weights.items() if any(z > w[out] - 1e-5 for i, z in enumerate(w) if i != out)})


def strong_words(model: LicenseModel) -> list[str] | None:
    """Words of which a document must hold one for any of its paragraphs to be given to a family;
    None if the bias alone may do that.

    For a family, a gram counts by how much more it speaks for the family than for `unknown`, and
    a paragraph by the sum over its k grams, divided by the root of k. The weak grams are the
    largest set, by rising weight, out of which no paragraph outweighs the bias: for every k its
    k best do not. Any other gram is strong, and each of these has one of its words listed."""
    out = model.families.index(UNKNOWN)
    others = [i for i in range(len(model.families)) if i != out]
    grams = sorted(model.weights, key=lambda g: (max(model.weights[g][i] for i in others) - model.weights[g][out], g))
    gaps = np.array([[model.weights[g][i] - model.weights[g][out] for i in others] for g in grams]).reshape(-1, len(others))
    needed = np.array([model.bias[out] - model.bias[i] for i in others]) - 1e-4  # weights are rounded

    def weak(n: int) -> bool:
        best = np.cumsum(-np.sort(-gaps[:n], axis=0), axis=0) / np.sqrt(np.arange(1, n + 1))[:, None]
        return bool((needed > 0).all() and (best < needed).all())

    if not weak(0):
        return None
    n = max(n for n in range(len(grams) + 1) if weak(n))
    strong = [g.split() for g in grams[n:]]
    listed = {words[0] for words in strong if len(words) == 1}
    for words in strong:
        if not listed & set(words):
            listed.add(max(words, key=lambda w: (len(w), w)))
    return sorted(listed)


def lines(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, words, after) of the lines that may belong to a family; `after` are the
    words that follow in the paragraph, REACH at most."""
    cues = cue_words(model)
    held = lambda w: F.lit(True) if cues is None else F.arrays_overlap(w, F.array(*[F.lit(c) for c in cues]))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.transform(F.split(F.col(text_col), "\n"), _words).alias("_all"))
    strong = strong_words(model)
    if strong is not None:
        among = F.array(*[F.lit(c) for c in strong])
        rows = rows.where(F.exists("_all", lambda w: F.arrays_overlap(w, among)))
    rows = rows.withColumn("_heads", F.transform("_all", lambda w: F.slice(w, 1, REACH)))

    def after(i: Column) -> Column:
        # A line has a word at least, so REACH lines are enough.
        near = F.slice("_heads", i + 2, REACH)
        end = F.array_position(F.transform(near, lambda w: F.size(w) == 0), F.lit(True)).cast("int")
        return F.slice(F.flatten(F.when(end > 0, F.slice(near, 1, end - 1)).otherwise(near)), 1, REACH)

    found = F.filter(F.transform("_all", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda z: (F.size(z["w"]) > 0) & held(z["w"]))
    spans = F.transform(found, lambda z: F.struct(z["i"].alias("line_no"), z["w"].alias("words"), after(z["i"]).alias("after")))
    return rows.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.line_no", "s.words", "s.after")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", other_lines: int = OTHER_LINES) -> LicenseModel:
    """Train on variants of the templates and of the plain lines above and at most `other_lines` lines of the
    documents that hold no cue; what is gathered is bounded by that number."""
    spark = docs.sparkSession
    families = sorted(TEMPLATES) + [UNKNOWN]
    rows = [(family, v) for family, ts in TEMPLATES.items() for t in ts for v in _variants(t)]
    rows += [(UNKNOWN, v) for t in OTHERS + FOREIGN for v in _variants(t)]
    known = spark.createDataFrame(rows, "family string, line string")
    every = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).withColumn("h", F.xxhash64("line"))
    plain = every.where(~reduce(or_, [F.contains(F.lower("line"), F.lit(cue)) for cue in CUES]))
    # One line per hash bucket, found by its hash alone; other_lines hashes are broadcast. Only
    # lines without a cue have such a hash, so the others need not be told apart again.
    chosen = plain.groupBy(F.pmod("h", F.lit(other_lines))).agg(F.min("h").alias("h")).select("h")
    others = every.join(F.broadcast(chosen), "h", "left_semi").select(F.lit(UNKNOWN).alias("family"), "line").distinct()
    got = [(r["family"], r["g"]) for r in known.select("family", _grams(_words(F.col("line"))).alias("g")).collect()]
    vocabulary = sorted({g for family, gs in got if family != UNKNOWN for g in gs})
    inside = F.array_intersect(_grams(_words(F.col("line"))), F.array(*[F.lit(v) for v in vocabulary]))
    got += [(r["family"], r["g"]) for r in others.select("family", inside.alias("g")).collect()]
    return _train(got, families, vocabulary)


def _train(got: list[tuple[str, list[str]]], families: list[str], vocabulary: list[str]) -> LicenseModel:
    at = {v: i for i, v in enumerate(vocabulary)}
    x = np.zeros((len(got), len(vocabulary)))
    y = np.array([families.index(f) for f, _ in got])
    for i, (_, grams) in enumerate(got):
        x[i, [at[g] for g in grams if g in at]] = 1
    x /= np.maximum(np.sqrt(x.sum(axis=1)), 1)[:, None]
    goal = np.eye(len(families))[y]
    weight = 1 / np.bincount(y, minlength=len(families))[y]

    def learn(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], len(families))), np.zeros(len(families))
        share = (weight * use / (weight * use).sum())[:, None]
        for _ in range(400):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - goal) * share
            w -= 20.0 * (x.T @ error + 2e-4 * w)
            b -= 20.0 * error.sum(axis=0)
        return w, b

    # Cross-fitting: the rows of each fold are scored by a model that has not seen them.
    fold = np.arange(len(got)) % 3
    z = np.zeros(goal.shape)
    for k in range(3):
        w, b = learn(fold != k)
        z[fold == k] = x[fold == k] @ w + b
    best = min((_loss(z / t, goal, weight), t) for t in np.geomspace(0.25, 4, 33))[1]
    w, b = learn(np.ones(len(got), bool))
    return LicenseModel(families, {v: w[i].tolist() for v, i in at.items()}, b.tolist(), float(best))


def _loss(z: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float((weight * -((z * goal).sum(axis=1) - np.log(np.exp(z).sum(axis=1)))).sum())


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, family, probability, template_share, confirmed) of every line that may
    belong to a family; `unknown` where no family is probable enough."""
    # The grams with their weights, by a checksum: a gram is compared with the few of its slot only.
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for v, w in model.weights.items():
        slots[zlib.crc32(v.encode()) % SLOTS].append({"gram": v, "weights": [float(round(z, 6)) for z in w]})
    # One literal, as JSON: a column per weight would take seconds to plan.
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<gram string, weights array<double>>>>")
    vocabulary = F.split(F.lit(" ".join(sorted({word for v in model.weights for word in v.split()}))), " ")
    zero = F.array(*[F.lit(0.0) for _ in model.families])
    bias = F.array(*[F.lit(float(z)) for z in model.bias])
    names = F.array(*[F.lit(f) for f in model.families])

    def entries(gram: Column) -> Column:
        slot = F.get(table, (F.crc32(gram) % SLOTS).cast("int"))
        return F.filter(slot, lambda e: e["gram"] == gram)

    def judged(rows: DataFrame, words: str, name: str) -> DataFrame:
        """The rows with `name`: family, probability and template_share of the words."""
        total = F.aggregate("_known", zero, lambda acc, g: F.zip_with(acc, g["weights"], lambda a, b: a + b))
        norm = F.sqrt(F.greatest(F.size("_known"), F.lit(1)).cast("double"))
        logits = F.zip_with(total, bias, lambda a, b: (a / norm + b) / F.lit(model.temperature))
        # Most words are in no gram; those that are, once a line, decide which pairs are built.
        known = F.transform(_grams_among(F.col(words), F.col("_among")), entries)
        scored = rows.withColumn("_among", F.array_intersect(vocabulary, F.col(words)))
        scored = scored.withColumn("_known", F.flatten(known)).withColumn("_z", logits)
        scored = scored.withColumn("_p", F.transform("_z", lambda v: F.exp(v - F.array_max("_z"))))
        scored = scored.withColumn("_best", F.array_max(F.arrays_zip(F.col("_p").alias("p"), names.alias("family"))))
        p = F.col("_best.p") / F.aggregate("_p", F.lit(0.0), lambda a, b: a + b)
        named = F.when(p >= LEAST_PROBABILITY, F.col("_best.family")).otherwise(F.lit(UNKNOWN))
        out = F.struct(named.alias("family"), p.alias("probability"), _share(F.col("_best.family"), F.col(words)).alias("template_share"))
        return scored.withColumn(name, out).drop("_among", "_known", "_z", "_p", "_best")

    rows = judged(lines(docs, model, id_col, text_col), "words", "line")
    # Only lines of no family are read on, by the words of the line and those after it.
    alone = (F.col("line.family") != UNKNOWN) | (F.size("after") == 0)
    rows = judged(rows.withColumn("wide", F.when(alone, F.array().cast("array<string>")).otherwise(F.concat("words", "after"))), "wide", "span")
    rest = _share(F.col("span.family"), F.col("after"))
    taken = ~alone & (F.col("span.family") != UNKNOWN) & (F.col("span.template_share") >= LEAST_SHARE) & (F.col("span.template_share") > rest)
    picked = rows.select("doc_id", "line_no", F.when(taken, F.col("span")).otherwise(F.col("line")).alias("x"))
    return picked.select(
        "doc_id",
        "line_no",
        "x.family",
        "x.probability",
        "x.template_share",
        ((F.col("x.family") != UNKNOWN) & (F.col("x.template_share") >= LEAST_SHARE)).alias("confirmed"),
    )


def _plain_words(template: str) -> list[str]:
    return re.findall(r"[^\W_]+", template.lower())


def telling_words(family: str, template: str) -> list[str]:
    """The template's words that no other family and no foreign licence is stated with."""
    others = {w for f, ts in TEMPLATES.items() if f != family for t in ts for w in _plain_words(t)}
    others |= {w for t in FOREIGN for w in _plain_words(t)}
    return sorted(set(_plain_words(template)) - others)


def _share(family: Column, words: Column) -> Column:
    """The largest share of a template of the family that the words hold. Without all the words
    that tell the family from others, or without any of the template's where there are none
    such, it is no match."""
    known = []
    for name, templates in TEMPLATES.items():
        for t in templates:
            wanted = sorted(set(_plain_words(t)))
            known.append((name, " ".join(telling_words(name, t) or wanted), " ".join(wanted)))
    table = F.array(*[F.struct(F.lit(n).alias("family"), F.split(F.lit(t), " ").alias("telling"), F.split(F.lit(w), " ").alias("wanted")) for n, t, w in known])

    def held(some: Column) -> Column:
        return F.size(F.array_intersect(words, some)) / F.size(some)

    own = F.filter(table, lambda t: t["family"] == family)
    return F.coalesce(F.array_max(F.transform(own, lambda t: F.when(held(t["telling"]) == 1, held(t["wanted"])).otherwise(0.0))), F.lit(0.0))
