"""Large groups of near copies: exact components, rows that follow the group's size, clashing column names."""

import random

import pytest

from gridmf.llm import neardup, substring
from test_llm_operators import VOCAB, prose, shingle_set

COLUMNS = "doc_id long, text string, _id string, _h string, _key string, _n string, _turn string, _start string, _length string, " \
          "label string, node string, key string, h string, n string, id string, turn string, start string, length string"


def copies(n, edits, seed, words=200):
    """Copies of one text with ``edits`` words replaced in each."""
    base, r = prose(words, seed).split(), random.Random(seed + 1)
    out = []
    for _ in range(n):
        w = base[:]
        for k in r.sample(range(words), edits):
            w[k] = r.choice(VOCAB) + str(r.randint(0, 10**9))
        out.append(" ".join(w))
    return out


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return [find(x) for x in range(len(texts))]


@pytest.mark.parametrize("part_bytes", [8 << 20, 20_000])
def test_groups_near_the_bound_equal_brute_force(spark, monkeypatch, part_bytes):
    """2 to 5 edits a copy: similarities on both sides of 0.75, in one part and in many."""
    monkeypatch.setattr(neardup, "PART_BYTES", part_bytes)
    texts = [t for k, e in enumerate((2, 3, 4, 5)) for t in copies(60, e, 10 + k)] + copies(40, 1, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_rows_follow_the_size_of_an_unlinked_group(spark, monkeypatch):
    """Copies with 7 edited words each share buckets and have no links: no table grows faster than about their number."""
    sizes = {}
    stored = neardup.stored

    def counted(df, name):
        out = stored(df, name)
        sizes.setdefault(name.rsplit("/", 1)[-1], []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    totals = []
    for n in (200, 400, 800):
        sizes.clear()
        docs = spark.createDataFrame(list(enumerate(copies(n, 7, 3))), "doc_id long, text string").repartition(4)
        assert neardup.near_duplicates(docs).where("kept").count() == n
        totals.append({k: sum(v) for k, v in sizes.items()})
    for small, large in zip(totals, totals[1:]):
        for name, rows in large.items():
            assert rows <= 2.5 * small.get(name, 0) + 50, (name, totals)


def test_user_columns_keep_their_values(spark):
    passage = prose(60, 5)
    texts = [prose(100, 1), prose(100, 1), prose(80, 2) + "\n" + passage, prose(90, 3) + "\n" + passage, None, ""]
    rows = [(k, t, *[f"{c}{k}" for c in range(16)]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.where("doc_id <> 1").collect())
    cut = substring.drop_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted(map(repr, cut.drop("text").collect())) == sorted(map(repr, docs.drop("text").collect()))
    assert {r.doc_id: r.text for r in cut.collect()}[3] != texts[3]


def test_work_tables_are_deleted(spark, tmp_path):
    import os

    from gridmf.llm.common import stored, workspace
    from gridmf.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    before = set(os.listdir(base))
    out = neardup.near_duplicates(docs)
    left = {x.split("-")[0] for x in set(os.listdir(base)) - before}
    assert left == {"classes", "nodes", "labels"}
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    try:
        with workspace(spark, "near") as work:
            stored(docs, f"{work}/x")
            raise ValueError
    except ValueError:
        pass
    assert work not in os.listdir(base)
