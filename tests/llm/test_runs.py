"""Periodic runs against brute force: random small alphabets, planted periods, long periodic texts, nulls, ties, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridmf.llm import runs


def brute(words, least=12):
    """Every run by trying every period at every place."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            if len(stretch) >= max(least, 2 * q) and not any(
                    all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def hostile_texts(seed, count):
    r = random.Random(seed)
    out = [None, "", " \n\t ", "one", "Of " * 300, "Of of " * 50, "a " * 11, "a " * 12, "x " + "a b c d e f " * 2, "x " + "a b c d e f " * 2 + "a y"]
    for _ in range(count):
        words = [r.choice("ab" if r.random() < .3 else "abcdefgh") for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 4)):
            q, k = r.randint(1, 14), r.randint(2, 9)
            unit = [r.choice("abcXYZ") for _ in range(q)]
            at = r.randint(0, len(words))
            words[at:at] = (unit * k)[:q * k - r.randint(0, q - 1)]
        out.append(r.choice([" ", "\n", "  "]).join(words))
    return out


def fib(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    texts = [(t or "").split() for t in hostile_texts(4, 150)] + [fib(400)]
    names = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    seq, counts = [], [len(t) for t in texts]
    for k, t in enumerate(texts):
        seq += [names[w] for w in t] + [len(names) + k]
    text, start, length, period = runs.find_runs(np.array(seq), np.array(counts), least)
    got = [[] for _ in texts]
    for t, *r in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[t].append(tuple(r))
    assert got == [brute(t, least) for t in texts]


def test_extensions_equal_direct_comparison():
    r = np.random.default_rng(5)
    unit = r.integers(0, 3, 70)
    seq = np.concatenate([unit, unit, r.integers(0, 3, 50), unit, np.zeros(200, np.int64), unit, [99]])
    e = runs.Extensions(seq)
    i, j = r.integers(0, len(seq), (2, 4000))
    i, j = np.minimum(i, j), np.maximum(i, j)
    keep = i < j
    want = []
    for a, b in zip(i[keep], j[keep]):
        k = 0
        while b + k < len(seq) and seq[a + k] == seq[b + k]:
            k += 1
        want.append(k)
    assert e.ask(i[keep], j[keep]).tolist() == want
    assert e.rank is not None


def test_every_difference_has_a_shift_below_v():
    for d in range(runs.V):
        for i in range(runs.V):
            s = runs.SHIFT[d, i]
            assert (i + s) % runs.V in runs.COVER and (i + s + d) % runs.V in runs.COVER


def test_grid_blocks_do_not_change_the_runs(monkeypatch):
    seq = np.array([0, 1, 2] * 40 + [7] + [5] * 50 + [8] + [3] * 12 + [9])
    counts = np.array([120, 50, 12])
    whole = runs.find_runs(seq, counts)
    monkeypatch.setattr(runs, "grid_blocks", lambda c, m, f=runs.grid_blocks: f(c, m, 3))
    assert len(whole[0]) == 3 and all(np.array_equal(a, b) for a, b in zip(whole, runs.find_runs(seq, counts)))


def test_digests_equal_brute_force(spark, monkeypatch):
    rows = [(k, t, "x", 1) for k, t in enumerate(hostile_texts(9, 120))] + [(3, "one", "y", 2), (3, "one", "y", 2), (None, "a b " * 20, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int").repartition(3)
    got = runs.digests(runs.periodic_runs(docs, rearranged=True)).collect()
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows) > 5
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(contract(k, t)) for k, t, *_ in rows)
    assert runs.digests(runs.periodic_runs(docs.where("false"))).count() == 0


def test_long_periodic_text_is_one_run(spark):
    words = " ".join(f"w{k % 977}" for k in range(60_000))
    got = runs.periodic_runs(spark.createDataFrame([(1, words + " end")], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 60_000, 977)]
    assert got.collapsed.split() == [f"w{k}" for k in range(977)] + ["end"]
