"""Operator 3: licence scan by a paragraph classifier over word n-grams. DataFrame functions only."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import literal_rows

#: Short public notices of each family, from which the classifier is trained and with which it is confirmed.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "Released under the GNU General Public License version 2 or later."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the 3-Clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal public domain dedication."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright (c) 2020 the authors. All rights reserved. No part of this publication may be reproduced without permission."),
)
#: Notices of no family known here; `___` stands for any words. They train the class `unknown`.
OTHERS = (
    "Licensed under the ___ License.", "Licensed under ___ 1.0.", "Released under the ___ License.", "Released under the ___ licence, version 2.", "This work is licensed under the ___ License.",
    "This software is licensed under the terms of the ___ License.", "Use of this source code is governed by the ___ license.", "Published under the ___ Public License.", "Distributed under a ___ license.",
)
#: Words too common to tell anything alone; they count in pairs.
COMMON = frozenset("a an and any are as at be by for from in is it its may not of on or that the this to under was were which with without you your all no can 0 1 2 3 4 5".split())
#: Ordinary paragraphs that share words with notices; they train the class `none`.
ORDINARY = (
    "the driver showed a valid license at the border", "she renewed her fishing licence in march", "the general public was invited to the opening", "this work was finished in the spring",
    "all of them reserved a table for the evening", "the apache helicopter landed at noon", "students of mit presented their results", "you may not use this door after ten",
    "the source of the river lies in the north", "free of charge parking for any person", "under the bridge the version of events differed", "conditions of any kind were discussed at the meeting",
    "permission was granted by the council", "the foundation published a report on free trade", "creative people share what is common", "the library is open to the public", "rights and duties of all members",
)
#: Below this probability of the best family a paragraph that looks like a notice is `unknown`; from CONFIRMED on of a template's words in it, the template confirms.
KNOWN, CONFIRMED = 0.6, 0.6
#: The families outweigh `none` from 1 on; anchors are chosen with this bound, a little less, so rounding doesn't count.
BOUND = 0.999
WORD = "([\\p{L}0-9]+)"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _grams(words: list[str]) -> set[str]:
    return {*(w for w in words if w not in COMMON), *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@lru_cache(1)
def trained(steps: int = 400, l1: float = 1.5e-3, seed: int = 3) -> tuple[list[str], dict[str, list[float]], list[float], list[str]]:
    """(families, n-gram weights of each family, biases, anchors) of a sparse multinomial logistic regression.

    Trained on the notices above, with words dropped and ordinary words put around them, against ordinary paragraphs and
    random mixes of the notices' words. Soft-thresholding keeps few weights. Probabilities are calibrated by one temperature
    on examples held out. Anchors are the weightiest n-grams, so many that all others together can't bring the class none
    below one half: a paragraph without an anchor is no notice, by the weights.
    """
    rng = np.random.default_rng(seed)
    common = sorted({w for t in ORDINARY for w in _words(t)})
    every = sorted({w for _, t in TEMPLATES for w in _words(t)})
    samples: list[tuple[str, list[str]]] = []
    for family, text in TEMPLATES:
        w = _words(text)
        for k in range(40):
            kept = [x for x in w if k == 0 or rng.random() > 0.08]
            around = lambda: [common[i] for i in rng.integers(0, len(common), rng.integers(0, 12))] if k else []  # noqa: B023, E731
            samples.append((family, around() + kept + around()))
    for text in ORDINARY:
        samples += [("none", _words(text))] * 4
    for pool in (common, every):
        samples += [("none", [pool[i] for i in rng.integers(0, len(pool), rng.integers(3, 14))]) for _ in range(250)]
    made = lambda: ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 10)))) for _ in range(rng.integers(1, 4))]
    for text in OTHERS:
        for _ in range(40):
            head, _, tail = text.partition("___")
            samples.append(("unknown", [*_words(head), *made(), *_words(tail)]))
    families = ["none", *sorted({f for f, _ in TEMPLATES} | {"unknown"})]
    grams = [_grams(w) for _, w in samples]
    vocabulary = sorted({g for t in [*(t for _, t in TEMPLATES), *(part for t in OTHERS for part in t.split("___"))] for g in _grams(_words(t))})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(samples), len(vocabulary)))
    for r, gs in enumerate(grams):
        x[r, [at[g] for g in gs if g in at]] = 1
    y = np.array([families.index(f) for f, _ in samples])
    held = np.arange(len(samples)) % 5 == 4
    w, b, one = np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), np.eye(len(families))[y]
    rate = 0.2
    for _ in range(steps):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one[~held]) / (~held).sum()
        w = w - rate * 10 * (x[~held].T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 10 * l1, 0)
        b = b - rate * 10 * g.sum(0)
    z = x[held] @ w + b

    def surprise(t: float) -> float:
        u = z / t
        return float(np.mean(np.log(np.exp(u - u.max(1, keepdims=True)).sum(1)) + u.max(1) - u[np.arange(len(u)), y[held]]))

    t = min(np.linspace(0.2, 2, 37), key=surprise)
    w, b = np.round(w / t, 6), np.round(b / t, 6)
    w -= w[:, :1]  # the class none has no weights, so what isn't in the vocabulary counts nothing
    b -= b[0]
    rest = [int(i) for i in np.argsort(-w[:, 1:].max(1), kind="stable")]  # the weightiest first
    anchors: list[str] = []
    while np.exp(np.maximum(w[rest, 1:], 0).sum(0) + b[1:]).sum() > BOUND:  # what is left might still outweigh none
        anchors.append(vocabulary[rest.pop(0)])
    weights = {v: [float(c) for c in w[i, 1:]] for v, i in at.items() if np.abs(w[i, 1:]).max() > 0}
    return families[1:], weights, [float(c) for c in b[1:]], anchors


def _any_of(grams: list[str]) -> str:
    """Pattern of a lower-case text that has one of these words or pairs of words; alternatives go by their first letter."""
    by: dict[str, list[str]] = {}
    for g in sorted(grams):
        by.setdefault(g[0], []).append(g[1:].replace(" ", "[^\\p{L}0-9]+"))
    return "(?<![\\p{L}0-9])(?:" + "|".join(f"{c}(?:{'|'.join(v)})" for c, v in by.items()) + ")(?![\\p{L}0-9])"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchored: bool = True) -> DataFrame:
    """(id, paragraph, start, family, probability, template, similarity, confirmed, notice) for each paragraph that is likelier a notice than not.

    Paragraphs are lines; start is in code points. family is the likeliest licence family, `unknown` where its calibrated
    probability is below KNOWN. template is the number of the family's template (of any, where unknown) with the largest share
    of words in the paragraph, similarity that share, confirmed whether it reaches CONFIRMED. Null and empty texts give no
    rows; repeated rows give theirs each; null ids stay; other columns aren't read.

    Only paragraphs with an anchor can be notices, by the model's weights, so the others leave before any n-gram is made; not
    anchored scores every paragraph, with the same rows. N-grams are joined with the weights, a broadcast literal of a size
    fixed by the templates. Equal paragraphs at the same (id, place) are counted as one and given back as often.
    """
    spark = df.sparkSession
    families, weights, bias, anchors = trained()
    found = _any_of(anchors)
    fits = lambda c: F.lower(c).rlike(found) if anchored else F.col(c).isNotNull()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(fits("text"))
    lines = F.split("text", "\n", -1)
    pars = docs.select("id", F.posexplode(lines).alias("par", "notice"), lines.alias("lines")).filter(fits("notice"))
    start = F.aggregate(F.slice("lines", 1, F.col("par")), F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 1)
    pars = pars.select("id", "par", start.alias("start"), "notice").groupBy("id", "par", "start", "notice").agg(F.count("*").alias("n"))
    words = F.regexp_extract_all(F.lower("notice"), F.lit(WORD), 1)
    pairs = F.zip_with(F.slice(F.col("words"), 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice(F.col("words"), 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    grams = pars.withColumn("words", words).withColumn("gram", F.explode(F.array_distinct(F.concat("words", pairs))))
    table = literal_rows(spark, [{"gram": g, "w": w} for g, w in sorted(weights.items())], "gram string, w array<double>")
    row = ["id", "par", "start", "notice", "n"]
    sums = grams.join(F.broadcast(table), "gram").groupBy(*row).agg(*(F.sum(F.col("w")[k].cast("decimal(18,6)")).cast("double").alias(f"s{k}") for k in range(len(families))))
    scores = [F.exp(F.col(f"s{k}") + F.lit(b)) for k, b in enumerate(bias)]
    total = F.lit(1.0)
    for s in scores:
        total = total + s
    best = F.array_max(F.array(*(F.struct((s / total).alias("p"), F.lit(f).alias("family")) for s, f in zip(scores, families, strict=True))))
    judged = sums.withColumn("none", F.lit(1.0) / total).withColumn("best", best).filter("best.p + 0 > 0 AND none < 0.5")
    judged = judged.withColumn("family", F.when(F.col("best.p") >= KNOWN, F.col("best.family")).otherwise("unknown")).withColumn("has", F.array_distinct(words))
    shares = F.array(*(F.struct(_share(set(_words(t))).alias("similarity"), F.lit(-i).alias("t"), F.lit(f).alias("f")) for i, (f, t) in enumerate(TEMPLATES)))
    near = F.array_max(F.filter(shares, lambda s: (F.col("family") == "unknown") | (s["f"] == F.col("family"))))
    judged = judged.withColumn("near", near).withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    return judged.select(
        F.col("id").alias(id_col), F.col("par").alias("paragraph"), "start", "family", F.round("best.p", 6).alias("probability"), (-F.col("near.t")).alias("template"),
        F.round("near.similarity", 6).alias("similarity"), (F.col("near.similarity") >= CONFIRMED).alias("confirmed"), "notice",
    )


def _share(words: set[str]) -> Column:
    """Share of these words that the paragraph has."""
    return F.size(F.array_intersect("has", F.array(*(F.lit(w) for w in sorted(words))))) / F.lit(float(len(words)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of every whole text; null and empty texts have none, repeated rows each give theirs."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
