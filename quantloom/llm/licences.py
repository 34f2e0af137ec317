"""Licence scan: a trained paragraph classifier confirmed by templates.

A paragraph is a line, or neighbouring lines that hold a wrapped notice together.
Its sparse features are the word pairs and triples of
the licence templates (those with a word that is no stop word).  A multinomial
logistic regression with an L1 penalty, trained here on the templates, their
parts and unrelated sentences, gives a probability to each licence family and
to ``unknown``; a temperature fitted on held-back parts calibrates them.  A
paragraph's family is accepted when its calibrated probability reaches CERTAIN
and at least CONFIRM of the n-grams of one of the family's templates occur in
the paragraph.

The scan is DataFrame functions only.  A line without any of the anchor words
(every feature has one) has no feature and is unknown; only other lines are
exploded, joined with the features (a few hundred rows, broadcast) and summed.

Lines are classified first.  What lines of no family hold is then classified by
windows of 2 * SPAN lines, each starting SPAN lines after the one before, with the
n-grams that cross from a line into the next: a notice wrapped over up to SPAN + 1
lines stands whole in one.  Neither windows nor n-grams cross a blank line.

Defined results: null text has no paragraphs; an empty table gives an empty
result; equal probabilities take the family that sorts first; repeated rows
each return their result; rows are told apart by doc_id and text.  Texts of any
length are processed whole.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CERTAIN, CONFIRM = 0.5, 0.6
EPOCHS, RATE, L1 = 400, 0.5, 2e-4
UNKNOWN = "unknown"
#: Half of the lines of a window, for wrapped notices.
SPAN = 8
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
LINE, WINDOW = ["doc_id", "th", "block", "line"], ["doc_id", "th", "block", "window"]

#: Short notices by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 2.", "You can redistribute it under the terms of the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-only"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it under the terms of the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License."],
    "proprietary": ["All rights reserved. Unauthorized copying is prohibited.", "Proprietary and confidential. Copying of this file is strictly prohibited."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense License."],
}
#: Sentences of no licence that share words with some.
OTHERS = [
    "The driver showed a license to the public officer.", "A fishing license is required at the lake.", "The software was released in the spring.", "General public opinion changed in version two of the story.",
    "Permission to enter was granted by the guard.", "Source and binary options are traded.", "The creative team works in the commons.", "All rights and duties follow from the contract.", "Copy the file to the folder and modify it.",
    "They use the public domain name.", "The version of the work is new.", "Free of charge for any person under ten.", "The terms of the general agreement.", "Distribution and use of water.", "International work is attribution of credit.",
]
STOP = set("a an all and any are as at be by can except for form forms free from in is it may not of on or that the this to under use used was with without work you your".split())
NOT_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", text.translate(str.maketrans(common.UPPER, common.LOWER))) if w]


def grams(text: str) -> set[str]:
    w = words(text)
    out = {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
    return {g for g in out if not set(g.split()) <= STOP}


def anchors(features: list[str]) -> list[str]:
    """Words, no stop words, of which every feature has at least one; the most useful first."""
    left, out = set(features), []
    while left:
        count: dict[str, int] = {}
        for f in left:
            for w in set(f.split()) - STOP:
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (count[w], w))
        out.append(best)
        left = {f for f in left if best not in f.split()}
    return out


def train() -> dict:
    """Features, families (unknown last), weights, biases and temperature; the same at every call."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    features = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)})
    column = {g: i for i, g in enumerate(features)}
    fit, held = [], []
    for k, f in enumerate(families[:-1]):
        for t in TEMPLATES[f]:
            fit.append((t, k))
            held += [("Copyright 2020 the authors. " + t, k), (t + " See the file for details.", k)]
            w = t.split()
            if len(w) > 8:
                fit += [(" ".join(w[: len(w) * 3 // 4]), k), (" ".join(w[len(w) // 4 :]), k)]
    fit += [(t, len(families) - 1) for t in OTHERS[::2] + [""] * 5]
    held += [(t, len(families) - 1) for t in OTHERS[1::2] + ["", "public license"]]

    def matrix(rows):
        x = np.zeros((len(rows), len(features)))
        for i, (t, _) in enumerate(rows):
            for g in grams(t):
                if g in column:
                    x[i, column[g]] = 1.0
        return x, np.array([k for _, k in rows])

    x, y = matrix(fit)
    w, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    goal = np.eye(len(families))[y]
    share = 1.0 / np.bincount(y, minlength=len(families))[y]
    share /= share.sum()
    for _ in range(EPOCHS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - goal) * share[:, None]
        w -= RATE * 20 * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * 20 * L1, 0)
        b -= RATE * d.sum(axis=0)
    hx, hy = matrix(held)
    z = hx @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - q.max(axis=1, keepdims=True)
        return -q[np.arange(len(hy)), hy].mean()

    temperature = min((0.25 * 1.15**k for k in range(25)), key=loss)
    return {"features": features, "families": families, "w": w, "b": b, "temperature": float(temperature)}


def tables(spark: SparkSession, model: dict) -> DataFrame:
    """(f, gram, weights by family, 1.0 for each template that has it): a few hundred rows."""
    sets = [grams(t) for f in model["families"][:-1] for t in TEMPLATES[f]]
    rows = [(i, g, [float(v) for v in model["w"][i]], [float(g in s) for s in sets]) for i, g in enumerate(model["features"])]
    return spark.createDataFrame(rows, "f int, gram string, w array<double>, t array<double>")


def _words(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _grams(words: str) -> Column:
    pair = F.transform(words, lambda w, i: F.when(i > 0, F.concat_ws(" ", F.get(words, i - 1), w)))
    triple = F.transform(words, lambda w, i: F.when(i > 1, F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1), w)))
    return F.array_distinct(F.array_compact(F.concat(pair, triple)))


def _found(docs: DataFrame, model: dict, features: DataFrame) -> DataFrame:
    """LINE, crosses and f (a feature) of the n-grams of lines with an anchor, and of those that cross into a neighbouring line."""
    gate = r"(?i)(?<![0-9a-z])(?:" + "|".join(anchors(model["features"])) + r")(?![0-9a-z])"
    d = common.id_text(docs).filter(F.col("text").rlike(gate)).withColumn("th", F.xxhash64("text"))
    blocks = d.select("doc_id", "th", F.posexplode(F.split("text", BLANK)).alias("block", "body"))
    blocks = blocks.select("doc_id", "th", "block", F.split("body", "\n").alias("ls"))
    near = F.transform("ls", lambda x, i: F.struct(x.alias("body"), F.get("ls", i - 1).alias("before"), F.get("ls", i + 1).alias("after")))
    lines = blocks.select("doc_id", "th", "block", F.posexplode(near).alias("line", "x")).filter(F.col("x.body").rlike(gate))
    lines = lines.select(*LINE, _words(F.col("x.body")).alias("words"), _words(F.col("x.before")).alias("before"), _words(F.col("x.after")).alias("after"))
    last = F.slice("before", F.greatest(F.size("before") - 1, F.lit(1)), 2)
    lines = lines.select(*LINE, "words", F.concat(last, "words", F.slice("after", 1, 2)).alias("wide"))
    lines = lines.select(*LINE, _grams("words").alias("own"), _grams("wide").alias("wide"))
    every = F.concat(
        F.transform("own", lambda g: F.struct(g.alias("gram"), F.lit(False).alias("crosses"))),
        F.transform(F.array_except("wide", "own"), lambda g: F.struct(g.alias("gram"), F.lit(True).alias("crosses"))),
    )
    rows = lines.select(*LINE, F.explode(every).alias("x")).select(*LINE, "x.gram", "x.crosses")
    return rows.join(F.broadcast(features.select("gram", "f")), "gram").select(*LINE, "crosses", "f")


def classify(rows: DataFrame, key: list[str], model: dict, features: DataFrame, certain: float, confirm: float) -> DataFrame:
    """key, family, probability and match of the distinct features f of each key."""
    families = model["families"]
    owner = [k for k, f in enumerate(families[:-1]) for _ in TEMPLATES[f]]
    size = [len(grams(t)) for f in families[:-1] for t in TEMPLATES[f]]
    rows = rows.join(F.broadcast(features.select("f", "w", "t")), "f")
    sums = [F.sum(F.get("w", i)).alias(f"z{i}") for i in range(len(families))] + [F.sum(F.get("t", j)).alias(f"t{j}") for j in range(len(size))]
    per = rows.groupBy(*key).agg(*sums)
    z = F.array(*[(F.col(f"z{i}") + float(model["b"][i])) / model["temperature"] for i in range(len(families))])
    best = [F.array_max(F.array(*[F.col(f"t{j}") / size[j] for j in range(len(size)) if owner[j] == k])) for k in range(len(families) - 1)]
    per = per.select(*key, z.alias("z"), F.array(*best, F.lit(0.0)).alias("best")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    per = per.withColumn("k", (F.array_position("z", F.col("top")) - 1).cast("int"))
    per = per.select(*key, F.get(F.array(*map(F.lit, families)), F.col("k")).alias("family"), (F.lit(1.0) / total).alias("probability"), F.get("best", F.col("k")).alias("match"))
    sure = (F.col("probability") >= certain) & (F.col("match") >= confirm)
    return per.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN))


def paragraphs(docs: DataFrame, model: dict, certain: float = CERTAIN, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, th, block, line, wrapped, family, probability and match of paragraphs.

    Of every line that has a feature (wrapped false; family may be unknown), and of every notice that only neighbouring
    lines hold together (wrapped true; the line is the first of its window).
    """
    features = tables(docs.sparkSession, model)
    found = common.stored(_found(docs, model, features), "licence-grams")
    single = classify(found.filter("not crosses"), LINE, model, features, certain, confirm)
    known = single.filter(F.col("family") != UNKNOWN).select(F.struct(*LINE).alias("_known"))
    rest = found.withColumn("_line", F.struct(*LINE)).join(known, F.col("_line").eqNullSafe(F.col("_known")), "left_anti")
    at = F.floor(F.col("line") / SPAN).cast("int")
    rest = rest.select(*WINDOW[:-1], F.explode(F.array(at - 1, at)).alias("window"), "f").filter("window >= 0").distinct()
    joined = classify(rest, WINDOW, model, features, certain, confirm).filter(F.col("family") != UNKNOWN)
    # Windows overlap: one notice may stand in two that follow each other.
    before = F.lag("window").over(Window.partitionBy(*WINDOW[:-1], "family").orderBy("window"))
    joined = joined.withColumn("before", before).filter("before is null or before < window - 1")
    out = ["family", "probability", "match"]
    single = single.select(*LINE, F.lit(False).alias("wrapped"), *out)
    return single.unionByName(joined.select(*WINDOW[:-1], (F.col("window") * SPAN).alias("line"), F.lit(True).alias("wrapped"), *out))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_licences (lines and wrapped notices with a family), families (sorted), probability (the highest) of every row."""
    found = paragraphs(docs, train()).filter(F.col("family") != UNKNOWN)
    per = found.groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("family")).alias("families"), F.max("probability").alias("p"))
    per = per.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "n", "families", "p")
    d = common.id_text(docs).select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_paragraphs"))
    d = d.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    return d.select(
        "doc_id", F.greatest("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("probability"),
    )
