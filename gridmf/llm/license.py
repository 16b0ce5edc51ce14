"""Licence scan by a trained paragraph classifier (DataFrame and SQL functions and Spark's own logistic regression only).

A paragraph is a line; its features are which of the templates' words and pairs of neighbouring words
(runs of letters and digits, lower case) it holds.  A multinomial logistic regression tells ``none``, the licence
families of ``TEMPLATES`` and ``unknown`` (licence wording of no such family, ``OTHERS``) apart.  It is fitted on

* the templates and others, their beginnings, and each of them between corpus words;
* near misses, class ``none``: the same wordings without the words that make them a licence (``NAMING``, ``SUBJECT``), alone and with
  corpus words in their place, and the legal prose of ``PROSE``;
* corpus paragraphs without a naming word, class ``none``: a sample by hash of about ``SAMPLE_BYTES`` of text.

Probabilities are calibrated by one temperature: a fit on one half of these rows (by hash), the least log loss on the other half, with
Platt's smoothed targets so that a best temperature exists.

Every paragraph of every whole text is scored.  First a bound: the gain over ``none`` of a pair counts for that of its two words
that is in fewer pairs, so the words of a paragraph bound its whole gain; where the bound is below ``none`` the paragraph is ``none``,
the others are scored in full.  Decision: the likeliest family if its calibrated probability is at least ``SURE`` and template comparison
confirms it: the longest common subsequence of words with one of its templates covers ``CONFIRM`` of the template, and ``PAIRED`` of the
template's neighbouring pairs are there.  Any other paragraph that is not likeliest ``none`` is ``unknown``.

Null or empty texts have no paragraphs; blank lines are none.  Repeated rows are scanned alike.  Empty tables give no rows; without
corpus paragraphs (an empty or tiny corpus) the fixed wordings alone train the model.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import stored, table, text_bytes

SAMPLE_BYTES = 1 << 20
SURE = 0.5
CONFIRM = 0.7
PAIRED = 0.4
NONE, UNKNOWN = "none", "unknown"
TEMPERATURES = [2 ** (k / 2) for k in range(-8, 9)]

# Usual wordings of licence notices and paragraphs (public texts).
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
]
# Wordings of licences that are no family here.
OTHERS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This is free and unencumbered software released into the public domain",
    "Licensed under the EUPL",
    "Licensed under the European Union Public Licence",
    "This software is provided 'as-is', without any express or implied warranty",
    "SPDX-License-Identifier: Zlib",
    "Released under the terms of the Artistic License 2.0",
    "This font software is licensed under the SIL Open Font License, Version 1.1",
    "Distributed under the Boost Software License, Version 1.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "You may copy and distribute this software under the terms of its licence",
    "This file is licensed under the terms given in the licence file",
]
# Legal prose that is no licence.
PROSE = [
    "Members may not use the hall except in compliance with the rules of the club",
    "Permission is hereby granted to the council to meet in any person's house",
    "The above notice shall be included in all letters to the board",
    "All rights and duties of the tenant are set out in the lease",
    "The museum is open to the public and free of charge to any person",
    "The terms of the treaty were made available to the public",
    "He was granted permission to copy the painting without a fee",
    "Parking in any form is strictly prohibited",
    "You should have received a copy of the letter along with this parcel",
    "The general public is subject to the terms of the agreement",
    "The driver showed a licence and was free to go",
    "The restaurant is licensed to sell wine and beer",
]
NAMING = ["license", "licence", "licensed", "licenses", "licences", "licensing", "copyright", "reserved", "gnu", "spdx", "eupl",
          "gpl", "lgpl", "redistribution", "redistributions", "redistribute", "unauthorized", "unencumbered", "confidential"]
SUBJECT = ["software", "source", "code", "binary", "form", "forms", "file", "files", "program", "library", "mit", "apache", "bsd", "mozilla",
           "commons", "cc", "copies", "distribute"]
FAMILIES = sorted({f for f, _ in TEMPLATES})
CLASSES = [NONE, UNKNOWN, *FAMILIES]


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Pairs of neighbouring words of a word array."""
    two = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    return F.slice(two, 1, F.greatest(F.size(w) - 1, F.lit(0)))


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbouring words of a word array."""
    return F.array_distinct(F.concat(w, pairs(w)))


def listed(values: list, kind: str = "string") -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit("|".join(repr(v) if kind == "double" else str(v) for v in values)), r"\|").cast(f"array<{kind}>")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, place, line) of the non-blank lines of all texts."""
    lines = F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("place", "line")).where("trim(line) <> ''")


def wordings(spark, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(CLASSES.index(f), t) for f, t in rows], "label int, text string").select("label", words(F.col("text")).alias("w"))


def training_rows(docs: DataFrame) -> DataFrame:
    """(label, w, weight): the fixed wordings and their variants, near misses, and corpus paragraphs."""
    spark = docs.sparkSession
    t = wordings(spark, TEMPLATES + [(UNKNOWN, x) for x in OTHERS])
    one_in = max(1, text_bytes(docs) // SAMPLE_BYTES)
    corpus = stored(paragraphs(docs).where(F.pmod(F.xxhash64("line"), F.lit(one_in)) == 0).select("line").distinct()
                    .select(F.lit(0).alias("label"), words(F.col("line")).alias("w"))
                    .where(~F.arrays_overlap("w", listed(NAMING))), "licence-negatives")
    # six corpus paragraphs lend words to stand before and after the wordings, and in place of left out words
    around = corpus.where(F.size("w") >= 10).orderBy(F.xxhash64("w"), "w").limit(6) \
        .select(F.slice("w", 1, 5).alias("a"), F.slice("w", 6, 5).alias("b"))
    lent = [(r.a, r.b) for r in around.collect()]  # at most six
    gone = listed(NAMING + SUBJECT)
    left = t.select(F.lit(0).alias("label"), F.filter("w", lambda x: ~F.array_contains(gone, x)).alias("w")).where(F.size("w") >= 3)
    rows = [t.withColumn("weight", F.lit(10.0)), left.withColumn("weight", F.lit(3.0)),
            t.where(F.size("w") >= 8).select("label", F.slice("w", 1, F.ceil(F.size("w") * 0.7).cast("int")).alias("w"), F.lit(10.0).alias("weight")),
            wordings(spark, [(NONE, x) for x in PROSE]).withColumn("weight", F.lit(3.0)),
            corpus.withColumn("weight", F.lit(1.0))]
    for a, b in lent:
        before, after, instead = listed(a), listed(b), listed(a + b)
        rows.append(t.select("label", F.concat(before, "w", after).alias("w"), F.lit(10.0).alias("weight")))
        rows.append(t.select(F.lit(0).alias("label"), F.transform("w", lambda x, i: F.when(
            F.array_contains(gone, x), F.get(instead, i % (len(a) + len(b)))).otherwise(x)).alias("w"), F.lit(3.0).alias("weight")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


class Model:
    """Feature names, weights (class x feature), intercepts and the temperature they are divided by."""

    def __init__(self, names, weights, intercepts, temperature):
        self.names = names
        self.weights = [[x / temperature for x in row] for row in weights]
        self.intercepts = [x / temperature for x in intercepts]
        self.temperature = temperature

    def bounds(self) -> tuple[float, dict[str, float]]:
        """The start and the most each word can add to any class's lead over ``none``, pairs included."""
        n = len(self.intercepts)
        gain = {g: max(0.0, *(self.weights[c][i] - self.weights[0][i] for c in range(1, n))) for i, g in enumerate(self.names)}
        uses: dict[str, int] = {}
        for g in self.names:
            for x in set(g.split(" ")) if " " in g else ():
                uses[x] = uses.get(x, 0) + 1
        most = {g: x for g, x in gain.items() if " " not in g}
        for g, x in gain.items():
            if " " in g:
                most[min(g.split(" "), key=lambda y: (uses[y], y))] += x
        return max(b - self.intercepts[0] for b in self.intercepts[1:]), most


def fit(docs: DataFrame) -> Model:
    names = [r.g for r in wordings(docs.sparkSession, TEMPLATES + [(UNKNOWN, x) for x in OTHERS])
             .select(F.explode(grams(F.col("w"))).alias("g")).distinct().orderBy("g").collect()]
    rows = stored(training_rows(docs).select("label", "weight", F.xxhash64("w").alias("h"), grams(F.col("w")).alias("g")), "licence-training")
    counts = CountVectorizerModel.from_vocabulary(names, inputCol="g", outputCol="features")
    data = counts.setBinary(True).transform(rows.coalesce(2))  # a bounded sample
    learner = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", weightCol="weight", standardization=False)
    half = F.pmod("h", F.lit(2))
    # all wordings as they stand in both halves, so that both know every class
    known = learner.fit(data.where((half == 0) | (F.col("weight") > 9)))
    m = known.transform(data.where(half == 1)).select("label", "weight", vector_to_array("rawPrediction").alias("m")).cache()
    eps = 1.0 / ((m.agg(F.sum("weight")).first()[0] or 0.0) + 2.0)

    def loss(t: float) -> Column:
        top = F.array_max("m")
        log_sum = F.log(F.aggregate("m", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))) + top / t
        right = F.element_at("m", F.col("label") + 1)
        rest = F.aggregate("m", F.lit(0.0), lambda a, x: a + x) - right
        return F.sum(F.col("weight") * (log_sum - (right * (1 - eps) + rest * (eps / (len(CLASSES) - 1))) / t))

    losses = m.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    m.unpersist()
    temperature = min(zip(losses, TEMPERATURES))[1] if losses[0] is not None else 1.0
    model = learner.fit(data)
    return Model(names, model.coefficientMatrix.toArray().tolist(), list(model.interceptVector), temperature)


def common_length(w: Column, template: list[str]) -> Column:
    """Length of the longest common subsequence of a word array and a template of up to 60 words (bits of one BIGINT).

    Bit j of the state is 0 where the best subsequence of the first j + 1 template words is one longer than of the first j.
    """
    known = sorted(set(template))
    masks = listed([sum(1 << j for j, y in enumerate(template) if y == x) for x in known], "bigint")
    full = (1 << len(template)) - 1

    def step(v: Column, x: Column) -> Column:
        m = F.get(masks, (F.array_position(listed(known), x) - 1).cast("int"))
        return (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(F.lit(full))

    met = F.filter(w, lambda x: F.array_contains(listed(known), x))
    return len(template) - F.bit_count(F.aggregate(met, F.lit(full).cast("bigint"), step))


def scored(rows: DataFrame, model: Model, bounded: bool = True) -> DataFrame:
    """Rows (with word array ``w``) whose likeliest class is not ``none``: ``family`` and calibrated ``probability``."""
    start, most = model.bounds()
    some = sorted(x for x, g in most.items() if g > 0)
    if bounded:
        known, gains = listed(some), listed([most[x] for x in some], "double")
        rows = rows.where(F.aggregate(F.array_intersect("w", known), F.lit(start + 1e-6), lambda a, x: a + F.get(
            gains, (F.array_position(known, x) - 1).cast("int"))) >= 0)
    # explode of one value keeps the optimizer from computing it again in every later filter and column
    rows = rows.select("*", F.explode(F.array(grams(F.col("w")))).alias("g"))
    names = listed(model.names)
    at = F.transform(F.array_intersect("g", names), lambda g: F.array_position(names, g).cast("int"))
    rows = rows.select("*", F.explode(F.array(at)).alias("at"))

    def margin(c: int) -> Column:
        row = listed(model.weights[c], "double")
        return F.aggregate("at", F.lit(float(model.intercepts[c])), lambda a, i: a + F.get(row, i - 1))

    margins = [margin(c) for c in range(len(CLASSES))]
    rows = rows.select("*", F.explode(F.array(F.array(*margins))).alias("m")).withColumn("top", F.array_max("m"))
    rows = rows.withColumn("best", F.array_position("m", F.col("top")).cast("int")) \
        .withColumn("probability", 1.0 / F.aggregate("m", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    return rows.where("best > 1").withColumn("family", F.element_at(listed(CLASSES), F.col("best"))).drop("at", "m", "top", "best")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, place, line, license, probability, overlap) of every paragraph that is not ``none``."""
    model = model or fit(docs)
    found = F.explode(F.array(words(F.col("line")))).alias("w")
    rows = scored(paragraphs(docs).select("doc_id", "place", "line", found), model)
    kinds: dict[str, list[list[str]]] = {}
    for r in wordings(docs.sparkSession, TEMPLATES).collect():
        kinds.setdefault(CLASSES[r.label], []).append(r.w)

    def likest(of) -> Column:
        return F.coalesce(*[F.when(F.col("family") == f, F.greatest(*[of(t) for t in ts], F.lit(0.0))) for f, ts in kinds.items()], F.lit(0.0))

    # the template must be there in order, and in pieces of more than a word
    rows = rows.withColumn("overlap", likest(lambda t: common_length(F.col("w"), t) / float(len(t))))
    paired = likest(lambda t: F.size(F.array_intersect("g", listed([f"{x} {y}" for x, y in zip(t, t[1:])]))) / float(len(t) - 1))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= SURE) & (F.col("overlap") >= CONFIRM) & (paired >= PAIRED)
    return rows.select("doc_id", "place", "line", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("license"), "probability", "overlap")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """One row a licence paragraph: the document, the line's number in it, the family and its calibrated probability."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "place", "license", "probability", "overlap")
