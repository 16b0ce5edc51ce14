"""The pipeline stage by stage against plain readings, with nulls, blanks, repeats, empty tables and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from test_brute_force import plain_repeats

import corpus_pipeline
from gridmf.llm.tokens import default_path, encoder

R = random.Random(303)
VOCAB = ["".join(R.choice("klmnopqrst") for _ in range(R.randint(3, 9))) for _ in range(900)]
CLASH = ["_id", "_h", "_key", "_n", "_turn", "_start", "_length", "label", "node", "key", "h", "n", "id", "toxic"]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


ITEMS = {i: prose(30) for i in range(12)}
PASSAGE = prose(90)
BASE = prose(150)
TEXTS = {0: BASE, 1: " ".join([*BASE.split()[:-4], "w", "x", "y", "z"]), 2: BASE, 3: None, 4: "", 5: "  \n ",
         6: prose(80) + " " + PASSAGE + " " + prose(60), 7: prose(90) + "\n" + PASSAGE + "\n" + prose(70),
         8: prose(60) + " " + ITEMS[3] + " " + prose(30), 9: prose(40) + " " + ITEMS[5].upper().replace(" ", "  ") + ".",
         10: prose(2500), 11: "short words"}
TOXIC = {200 + i: prose(50) + " vilex grumx hatebad" for i in range(40)}
CLEAN = {300 + i: prose(60) for i in range(120)}
ALL = {**TEXTS, **TOXIC, **CLEAN}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    clash = ", ".join(f"{c} string" for c in CLASH)

    def row(i, t, turn=0):
        return (i, t, "en", "s", len(t) if t is not None else None, *[f"{c}-{i}-{turn}" for c in CLASH])

    rows = [row(i, t) for i, t in ALL.items()] + [row(10, ALL[10], 1), row(None, None), row(None, prose(20))]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}") \
        .repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1) for i in TOXIC] + [(i, 0) for i in CLEAN] + [(None, 1), (8, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*ITEMS.items(), (90, None), (91, " ")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_id(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows))


def test_each_stage_does_what_it_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]

    def step(name, before):
        out = stages[name](spark, before, folder)
        if name != "packing":
            assert out.columns == columns and out.schema == docs.schema
        rows = out.collect()
        for r in rows if name != "packing" else ():
            turn = r["_id"].rsplit("-", 1)[1]
            assert all(r[c] == f"{c}-{r.doc_id}-{turn}" for c in CLASH)
        return rows, spark.createDataFrame(rows, out.schema).repartition(3) if name != "packing" else out

    rows, docs = step("toxicity", docs)
    assert {r.doc_id for r in rows} == {*TEXTS, *CLEAN, None} and len(rows) == len(TEXTS) + len(CLEAN) + 3

    sets = {i: shingles(ALL[i]) for i in (*TEXTS, *CLEAN)}
    root = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    rows, docs = step("near_dedup", docs)
    kept = sorted(i for i in sets if root[i] == i)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == kept and sum(r.doc_id is None for r in rows) == 2
    assert 1 not in kept and 2 not in kept

    texts = {i if i is not None else -1 - k: t for k, (i, t) in enumerate((r.doc_id, r.text) for r in rows)}
    want = dict(texts)
    for i, spans in plain_repeats(texts).items():
        raw, out, end = texts[i].encode(), [], 0
        for start, length, *_ in spans:
            out.append(raw[end:start])
            end = start + length
        want[i] = b"".join([*out, raw[end:]]).decode()
    rows, docs = step("substring_dedup", docs)
    assert sorted((r.text or "") for r in rows) == sorted((t or "") for t in want.values())
    got = {r.doc_id: r for r in rows}
    assert got[7].text == want[7] != ALL[7] and got[6].text == ALL[6]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)

    before = by_id(rows)
    rows, docs = step("decontamination", docs)
    assert by_id(rows) == [x for x in before if x[0] or x[1] not in (8, 9)]

    pieces, _ = step("packing", docs)
    enc, by_doc = encoder(default_path()), {}
    for r in pieces:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {r.doc_id for r in rows}
    for r in rows:
        if r.doc_id is None:
            continue
        ids, at = np.array([*enc.plain(r.text or ""), 1], "<u4"), 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_the_whole_run_chains_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert ids == {*(set(TEXTS) - {1, 2, 8, 9}), *CLEAN, None}
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    full = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.drop_contaminated(spark, corpus_pipeline.drop_toxic(spark, full, str(tmp_path)), str(tmp_path))
    assert kept.count() == full.count()
