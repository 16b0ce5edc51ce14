"""Decontamination with its production values: recall of edited items, and items in text without spaces."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridmf.llm import decontaminate as dc
from gridmf.llm.words import slices

R = random.Random(12)
VOCAB = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(3000)]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, rate, r=R):
    out = list(text)
    for _ in range(int(rate * len(text))):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at:at + (kind < 2)] = [r.choice("abcdefghijklmnop ")] if kind else []
    return "".join(out)


def found(items, texts):
    block = dc.Block(list(enumerate(items)))
    out = set()
    for lo, buf, offs in slices(pa.array(texts), 1 << 20):
        out |= {(lo + doc, block.ids[i]) for doc, i, *_ in block.matches(buf, offs)}
    return out


@pytest.mark.parametrize("rate", [0.02, 0.05, 0.10, 0.14])
@pytest.mark.parametrize("words", [5, 7, 15, 40, 80, 200, 500, 1000])
def test_recall_of_edited_items(rate, words):
    """Every candidate passes the LSH, so this is its recall and the anchors' together."""
    r = random.Random(1000 * words + int(100 * rate))
    n = 200 if words <= 80 else 60 if words <= 200 else 30
    items = [prose(words, r) for _ in range(n)]
    copies = [edited(t, rate, r) for t in items]
    within = {(i, i) for i, (t, c) in enumerate(zip(items, copies))
              if dc.infix_distance(" ".join(t.split()).encode(), " ".join(c.split()).encode())[0] <= int(dc.MAX_EDIT_RATE * len(t))}
    got = found(items, [prose(30, r) + " " + c + " " + prose(30, r) for c in copies])
    assert len(within) > 0.7 * n and len(got & within) >= dc.TARGET * len(within), len(got & within) / len(within)
    assert got <= {(i, i) for i in range(n)}


def test_found_stretches_equal_a_plain_search():
    """Edits of every pair found are the least over the whole document."""
    r = random.Random(77)
    items = [prose(n, r) for n in (6, 20, 60, 120, 300)]
    texts = [prose(20, r) + " " + edited(t, 0.06, r) + " " + prose(20, r) for t in items] + [t for t in items]
    block = dc.Block(list(enumerate(items)))
    _, buf, offs = next(slices(pa.array(texts), 1 << 30))
    got = {(d, i): e for d, i, e, *_ in block.matches(buf, offs)}
    want = {(d, i): dc.infix_distance(t.encode(), " ".join(x.split()).encode())[0] for d, x in enumerate(texts) for i, t in enumerate(items)}
    want = {k: e for k, e in want.items() if e <= int(dc.MAX_EDIT_RATE * len(items[k[1]]))}
    assert got == want


def test_more_than_one_block(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, prose(30, r)) for i in range(12)]
    docs = spark.createDataFrame([(i, prose(20, r) + " " + t + " " + prose(9, r), "x") for i, t in items] + [(99, prose(80, r), "x"), (98, None, None)],
                                 "doc_id long, text string, item_id string")
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in dc.leaks(docs, bench).collect()} == {(i, i) for i, _ in items}
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == [98, 99]
    assert dc.leaks(docs.where("false"), bench).count() == 0
    twice = dc.leaks(docs.unionByName(docs), bench).collect()
    assert len(twice) == 24


def test_items_without_spaces_around_them():
    han = ["".join(chr(R.randint(0x4E00, 0x9000)) for _ in range(n)) for n in (12, 30, 200, 200)]
    items = [han[0], han[1], "https://example.org/a/b?c=1", "E=mc2", prose(30), "x=y"]
    joined = items[4].replace(" ", "", 3)
    texts = [han[2] + han[0] + han[3], han[2] + han[1] + han[3], f'see ("{items[2]}").', "(E=mc2)", "q" + joined + "q", "ax=yb", '"x=y"']
    assert found(items, texts) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 5)}


def spread(text, rate, r):
    """One change in every stretch of 1 / rate bytes, so that no long stretch stays whole."""
    out, step = list(text), 1 / rate
    for j in reversed(range(int(rate * len(text)))):
        at, kind = int((j + 0.5) * step), r.randrange(3)
        out[at:at + (kind < 2)] = ["#"] if kind else []
    return "".join(out)


@pytest.mark.parametrize("words", [1, 2, 3, 5, 9, 20, 60, 200, 1000])
def test_no_window_is_passed_over(monkeypatch, words):
    """With an LSH that lets every window through, every item within the bound is found, wherever its edits lie."""
    monkeypatch.setattr(dc.Block, "lsh", lambda self, text, first, size: np.zeros((len(first), 1), np.uint32))
    r = random.Random(words)
    items = [prose(words, r) for _ in range(60 if words < 200 else 12)]
    for rate in (0.08, 0.14):
        copies = [spread(t, rate, r) for t in items]
        texts = [prose(15, r) + " " + c + " " + prose(15, r) for c in copies]
        block = dc.Block(list(enumerate(items)))
        lo, buf, offs = next(slices(pa.array(texts), 1 << 30))
        got = {(doc, i): e for doc, i, e, *_ in block.matches(buf, offs) if doc == i and len(items[i]) >= dc.SHORT}
        want = {(i, i): dc.infix_distance(t.encode(), x.encode())[0] for i, (t, x) in enumerate(zip(items, texts)) if len(t) >= dc.SHORT}
        assert got == {k: e for k, e in want.items() if e <= int(dc.MAX_EDIT_RATE * len(items[k[0]]))}


@pytest.mark.parametrize("words", [15, 40, 200])
def test_recall_of_evenly_spread_edits(words):
    r = random.Random(words)
    items = [prose(words, r) for _ in range(100)]
    copies = [spread(t, 0.13, r) for t in items]
    got = found(items, [prose(15, r) + " " + c + " " + prose(15, r) for c in copies])
    assert len(got & {(i, i) for i in range(100)}) >= dc.TARGET * 100, len(got)
