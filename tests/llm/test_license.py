"""Licence scan: planted notices, near misses, licences of no family, and its parts against plain Python."""

import random
import re

import pytest

from gridmf.llm import license
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
R = random.Random(4)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return license.fit(corpus)


def found(spark, model, lines):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(lines)], "doc_id long, text string, line string, w int")
    return {(r.doc_id, r.place): r.license for r in license.scan(docs, model).collect()}


def test_planted_notices(corpus, model):
    planted = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
               "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary",
               "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    want = {(r.doc_id, i): planted[line] for r in corpus.collect() for i, line in enumerate((r.text or "").split("\n")) if line in planted}
    got = {(r.doc_id, r.place): r.license for r in license.scan(corpus, model).collect()}
    assert len(want) == 46 and got == want


@pytest.mark.parametrize("line, want", [
    ("The committee may not use this room except in compliance with the rules of the house", None),
    ("All rights of way were kept open by the council", None),
    ("He had to show his driving licence to the officer", None),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "LGPL"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that", "unknown"),
    ("Licensed under the EUPL, Version 1.2 or later", "unknown"),
    ("This is free and unencumbered software released into the public domain.", "unknown"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", "BSD"),
    ("Licensed under the Academic Free License version 3.0", "unknown"),
    ("This data is released under the Open Database License", "unknown"),
    ("you may not use this file except in compliance with the License.", "Apache-2.0"),
])
def test_near_misses_and_other_licences(spark, model, line, want):
    assert found(spark, model, [line]) == ({} if want is None else {(0, 0): want})


def test_blank_repeated_and_long_texts(spark, model):
    prose = " ".join(R.choice(["water", "stone", "river", "green", "house", "walked"]) for _ in range(60000))
    lines = [None, "", " \n\t\n", "Released under the MIT License.\n\nx\nReleased under the MIT License.", "Released under the MIT License.",
             prose, prose + "\nLicensed under CC BY 4.0"]
    assert found(spark, model, lines) == {(3, 0): "MIT", (3, 3): "MIT", (4, 0): "MIT", (6, 1): "CC-BY"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license.scan(empty, model).count() == 0 and license.scan(empty).count() == 0


def test_temperature_is_inside_its_grid(model):
    assert license.TEMPERATURES[0] < model.temperature < license.TEMPERATURES[-1]


def word_list(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_common_subsequence_matches_the_plain_table(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    templates = [word_list(t) for _, t in license.TEMPLATES][:6]
    lines = [[R.choice(templates[i % 6] + ["x"]) for _ in range(R.randint(0, 50))] for i in range(60)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lines)], "i int, w array<string>")
    got = rows.select("i", *[license.common_length(F.col("w"), t).alias(f"c{k}") for k, t in enumerate(templates)]).collect()
    for r in got:
        assert [r[f"c{k}"] for k in range(6)] == [plain(lines[r.i], t) for t in templates]


def test_the_bound_loses_no_paragraph(spark, model):
    known = sorted({w for _, t in license.TEMPLATES for w in word_list(t)} | {w for t in license.OTHERS for w in word_list(t)})
    runs = [word_list(t) for _, t in license.TEMPLATES]
    lines = []
    for _ in range(400):
        w = [R.choice(known + ["river"] * 60) for _ in range(R.randint(1, 12))]
        if R.random() < 0.5:
            t = R.choice(runs)
            a = R.randrange(len(t))
            w[len(w) // 2:len(w) // 2] = t[a:a + R.randint(1, 6)] * R.randint(1, 3)
        lines.append(w)
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lines)], "i int, w array<string>")
    with_bound, without = ({(r.i, r.family) for r in license.scored(rows, model, bounded=b).collect()} for b in (True, False))
    assert with_bound == without and 20 < len(without) < 400
