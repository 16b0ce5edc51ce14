"""Suffix-tree scores against a plain dictionary model; contexts are words, and states grow with the corpus."""

import math
import random
from collections import Counter

import pytest

from gridmf.llm import lm

R = random.Random(8)
WORDS = [f"w{i}" for i in range(8)]
CHAIN = {(a, b): R.choice(WORDS) for a in WORDS for b in WORDS}


def walk(n):
    a, b, out = "w0", "w1", []
    for _ in range(n):
        a, b = b, CHAIN[a, b] if R.random() < 0.8 else R.choice(WORDS)
        out.append(b if R.random() < 0.97 else f"rare{R.randint(0, 300)}")
    return " ".join(out)


TRAIN = [walk(R.randint(0, 60)) for _ in range(150)] + [None, "", "only once"]
SHUFFLED = [" ".join(R.sample(t.split(), len(t.split()))) for t in TRAIN[:40]]
HELD = [walk(40) for _ in range(20)] + ["unseen words w1 w2", None] + SHUFFLED


def plain_scores(train, texts):
    seqs = [["<", *(t or "").split(), ">"] for t in train]
    c = Counter(tuple(s[i:i + k]) for s in seqs for k in range(1, lm.DEPTH + 2) for i in range(len(s) - k + 1))
    n = sum(x for g, x in c.items() if len(g) == 1 and g != ("<",))
    one = {g: x for g, x in c.items() if len(g) == 1 and g != ("<",)}
    unknown = (sum(x == 1 for x in one.values()) + 0.5) / (n + 1)
    after: dict = {}
    for g, x in c.items():
        if len(g) > 1:
            after.setdefault(g[:-1], {})[g[-1]] = x
    states: dict = {}

    def prob(context, w):
        if not context:
            return (1 - unknown) * (one[w,] + 0.5) / (n + 0.5 * len(one)) if (w,) in one else unknown
        p = prob(context[1:], w)
        if context not in states:
            return p
        return (after[context].get(w, 0) + states[context] * p) / (c[context] + states[context])

    for k in range(1, lm.DEPTH + 1):
        new = {}
        for g in (g for g in after if len(g) == k and c[g] >= lm.MIN_COUNT):
            t, m = len(after[g]), c[g]
            gain = sum(math.log(t / (m - 1 + t)) if x == 1 else x * math.log((x - 1) / (m - 1 + t) / prob(g[1:], w))
                       for w, x in after[g].items())
            if gain >= lm.DIVERGENCE:
                new[g] = t
        states.update(new)
    out = []
    for t in texts:
        s = ["<", *(t or "").split(), ">"]
        out.append(sum(math.log10(prob(tuple(s[max(0, i - lm.DEPTH):i]), s[i])) for i in range(1, len(s))))
    return out, states


@pytest.fixture(scope="module")
def scored(spark):
    texts = TRAIN + HELD
    docs = spark.createDataFrame([(i, t, i >= len(TRAIN)) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    return texts, {r.doc_id: r for r in lm.score_texts(docs.repartition(3), "held").collect()}


def test_scores_equal_a_plain_model(scored):
    texts, got = scored
    want, states = plain_scores(TRAIN, texts)
    assert {1, 2} <= {len(s) for s in states}
    for i, w in enumerate(want):
        assert got[i].score == pytest.approx(w, abs=1e-9)


def test_word_order_counts_and_training_texts_beat_the_base(scored):
    texts, got = scored
    first = len(texts) - len(SHUFFLED)
    assert sum(got[i].score for i in range(40)) > sum(got[first + i].score for i in range(40)) + 20
    trained = [got[i] for i in range(len(TRAIN))]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_a_rare_context_is_kept_in_a_large_corpus(spark):
    """Ten occurrences are below any share of 1e-5 of a million tokens, and still a state."""
    filler = " ".join(f"f{i % 97}" for i in range(5000))
    docs = spark.createDataFrame([(i, filler, False) for i in range(220)] + [(300 + i, "kuala lumpur", False) for i in range(10)]
                                 + [(400, "kuala lumpur", True), (401, "lumpur kuala", True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in lm.score_texts(docs, "held").collect()}
    assert got[400] > got[401] + 2
