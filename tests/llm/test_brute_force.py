"""Toxicity, substring dedup and language mixtures against plain readings of their methods."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gridmf.llm import langid, substring, toxicity
from gridmf.llm.words import LOWER, hash_word

R = random.Random(77)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


# ---- toxicity -------------------------------------------------------------------------------------------------------

def dense_loss(x, grade, par, grades, l1):
    w, theta = par[:x.shape[1]], par[x.shape[1]:]
    loss = 0.0
    up = 1 / (1 + np.exp(-((x @ w)[:, None] - theta[None, :])))
    up = np.hstack([np.ones((len(x), 1)), up, np.zeros((len(x), 1))])
    for i, g in enumerate(grade):
        loss -= math.log(max(up[i, g] - up[i, g + 1], 1e-12))
    return loss / len(x) + l1 * np.abs(w).sum()


def test_ordinal_fit_reaches_the_minimum_of_a_dense_search():
    rng = np.random.default_rng(4)
    x = (rng.random((160, 5)) < 0.4).astype(float)
    eta = x @ np.array([2.0, -1.5, 1.0, 0.0, 0.5]) + rng.logistic(size=160)
    grade = np.digitize(eta, [0.5, 1.5, 2.5])
    doc, feat = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(doc, feat, 5, grade, l1=1e-3, steps=2000)
    assert (np.diff(theta) > 0).all()
    got = dense_loss(x, grade, np.append(w, theta), 4, 1e-3)
    # coordinate search with shrinking steps, from a start of its own
    par, step = np.array([0.0] * 5 + [-1.0, 0.0, 1.0]), 1.0
    best = dense_loss(x, grade, par, 4, 1e-3)
    while step > 1e-4:
        moved = False
        for i in range(8):
            for d in (step, -step):
                trial = par.copy()
                trial[i] += d
                if (np.diff(trial[5:]) > 0).all() and (v := dense_loss(x, grade, trial, 4, 1e-3)) < best - 1e-9:
                    par, best, moved = trial, v, True
        step = step if moved else step / 2
    assert got <= best + 1e-3
    assert np.abs(w - par[:5]).max() < 0.1 and np.abs(theta - par[5:]).max() < 0.1


def plain_features(text):
    low = bytes(LOWER[np.frombuffer((text or "").encode(), np.uint8)])
    words, run = set(), b""
    for b in low + b" ":
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            run += bytes([b])
        else:
            words.add(run)
            run = b""
    words.discard(b"")
    return words | {w[:k] for w in words for k in toxicity.PREFIXES if len(w) > k}


def test_severity_equals_a_plain_sum_over_features(spark):
    rows = [(i, prose(40) + (" vilex vilexa grumx hatebad" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(160)]
    odd = [(900, None), (901, ""), (902, "VILEX vilex Vilexa"), (903, "é ñ 12 grumx"), (904, prose(20000) + " vilex"), (904, "other")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd + [(0, rows[0][1])] * 50, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.table.keys.tolist(), model.weights.tolist()))
    assert any(w > 0 for w in weight.values())
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) + 50
    want = {}
    for i, t in [*((i, t) for i, t, _ in rows), *odd]:
        eta = sum(weight.get(hash_word(f), 0.0) for f in plain_features(t))
        p = [1 / (1 + math.exp(-(eta - k))) for k in model.theta.tolist()]
        want.setdefault(i, []).append((round(sum(p), 6), p[0] >= 0.5))
    for r in got:
        assert (round(r.severity, 6), r.toxic) in want[r.doc_id]
    empty = docs.where("false")
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_repeats_of_a_document_do_not_change_the_model(spark):
    rows = [(i, prose(30) + (" vilex grumx" if i % 3 == 0 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    one = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    more = toxicity.fit(spark.createDataFrame(rows + [rows[3]] * 400 + [rows[4]] * 7, "doc_id long, text string").repartition(7), labels)
    assert np.array_equal(one.table.keys, more.table.keys) and np.allclose(one.weights, more.weights) and np.allclose(one.theta, more.theta)


# ---- substring dedup ------------------------------------------------------------------------------------------------

def test_scoring_holds_little_beyond_the_batch():
    """A worker's arrays follow the slice, not the batch: 6 workers share an executor's memory."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(500)]
    texts = pa.array([" ".join(r.choice(vocab) for _ in range(400)) for _ in range(1000)])
    model = toxicity.Model(np.sort(np.array([hash_word(w) for w in vocab[:100]], np.uint64)), np.ones(100), np.array([1.0, 2.0, 3.0]))
    whole = model.eta(*next(toxicity.slices(texts, 1 << 30))[1:])
    tracemalloc.start()
    try:
        severity, _, _ = model.scores(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * texts.nbytes
    assert np.allclose(severity, model.above(whole).sum(axis=1))


def plain_chunks(raw):
    """Chunk ends by the definition: the gear hash of 16 bytes is the largest of its neighbours."""
    n = len(raw)

    def value(i):
        if not 0 <= i < n or (i + 1 < n and raw[i + 1] & 0xC0 == 0x80):
            return 0
        return 1 + sum(int(substring.GEAR[raw[i - k]]) << k for k in range(16) if i >= k) % 65536

    v = [value(i) for i in range(n)]
    ends = set()
    for i in range(n):
        left, right = v[max(0, i - substring.REACH):i], v[i:i + substring.REACH + 1]
        if v[i] and v[i] == max(right) and v[i] > max(left, default=0):
            ends.add(i + 1)
    ends.add(n)
    start, out = 0, []
    for e in sorted(ends):
        for c in range(start + substring.LONGEST, e, substring.LONGEST):
            while c < e and raw[c] & 0xC0 == 0x80:
                c += 1
            if start < c < e:
                out.append((start, c))
                start = c
        out.append((start, e))
        start = e
    return out


def plain_repeats(texts):
    """{doc: [(start, length, words, first doc)]} of texts by ascending doc_id."""
    seen, found = {}, {}
    for d, text in sorted(texts.items()):
        raw = (text or "").encode()
        run = None
        for a, b in plain_chunks(raw) if raw else []:
            words = sum(not substring.SPACE[raw[i]] and (i == 0 or bool(substring.SPACE[raw[i - 1]])) for i in range(a, b))
            src = seen.setdefault(raw[a:b], (d, a))
            if src == (d, a):
                run = None
            elif run is None:
                run = [a, b - a, words, src[0]]
                found.setdefault(d, []).append(run)
            else:
                run[1], run[2] = run[1] + b - a, run[2] + words
    keep = {d: [tuple(r) for r in rs if r[2] >= substring.MIN_WORDS or r[1] >= substring.MIN_BYTES] for d, rs in found.items()}
    return {d: rs for d, rs in keep.items() if rs}


def test_repeats_match_plain_chunks(spark):
    passage, other, han = prose(70), prose(55), "".join(chr(R.randint(0x4E00, 0x9000)) for _ in range(300))
    texts = {0: prose(100) + " " + passage, 1: passage + " " + prose(30), 2: "x" + passage + "\n" + other, 3: None, 4: "", 5: " \t\n",
             6: prose(200) + other + prose(3) + passage + prose(40), 7: "Of " * 900, 8: "Of " * 900, 9: han + prose(20), 10: "a" + han,
             11: prose(20) + " " + prose(20), 12: passage, 13: " ".join(prose(30) + " " + other for _ in range(6)), 14: prose(4000) + passage}
    rows = list(texts.items())
    want = plain_repeats(texts)
    assert len(want) >= 8
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.id: [(s.start, s.length, s.words, s.first_id) for s in r.spans] for r in substring.repeats(docs).collect()}
        assert got == want
    cut = {r.doc_id: r.text for r in substring.drop_repeats(docs).collect()}
    for d, text in texts.items():
        raw, out, end = (text or "").encode(), [], 0
        for start, length, *_ in want.get(d, []):
            out.append(raw[end:start])
            end = start + length
        assert cut[d] == (None if text is None else b"".join([*out, raw[end:]]).decode())


def test_check_bits_depend_on_the_bytes_alone():
    texts = pa.array([prose(60) for _ in range(3)])
    raw = [t.as_py().encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    s, e, _ = substring.chunks(buf, offs)
    marks = substring._check(buf, s, e)
    assert marks.max() < 1 << substring.CHECK_BITS and len(set(marks.tolist())) > 0.9 * len(marks) * (1 - len(marks) / 2048)
    again = substring._check(np.concatenate([buf, buf]), np.concatenate([s, s + len(buf)]), np.concatenate([e, e + len(buf)]))
    assert np.array_equal(again, np.tile(marks, 2))


# ---- language mixtures ----------------------------------------------------------------------------------------------

def plain_counts(text):
    """Hashed byte trigrams of the words, blank-padded, one feature a byte and one an end."""
    low, out, run = bytes(LOWER[np.frombuffer(text.encode(), np.uint8)]), {}, b""
    words = []
    for b in low + b" ":
        if 97 <= b <= 122 or b >= 128:
            run += bytes([b])
        elif run:
            words.append(run)
            run = b""
    feats = []
    for w in words:
        padded = b"  " + w + b" "
        feats.append([((x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32) >> 16 for x, y, z in zip(padded, padded[1:], padded[2:])])
    for f in (f for w in feats for f in w):
        out[f] = out.get(f, 0) + 1
    return feats, out


def plain_mixture(like, allowed, steps):
    pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(len(like[0]))]
    for _ in range(steps):
        new = [0.0] * len(pi)
        for row in like:
            total = sum(p * x for p, x in zip(pi, row)) or 1e-300
            for j, x in enumerate(row):
                new[j] += pi[j] * x / total
        pi = [x / sum(new) for x in new]
    return pi, sum(math.log(max(sum(p * x for p, x in zip(pi, row)), 1e-30)) for row in like)


def test_mixture_inference_matches_plain_em(spark):
    bags = {"de": "das haus und der fluss waren hier mit ihnen nicht ohne zeit".split(),
            "en": "the house and river were here with them not without time".split(),
            "fr": "la maison et le fleuve étaient ici avec eux pas sans temps".split()}
    rows = [(" ".join(R.choice(bags[k]) for _ in range(60)), k) for k in bags for _ in range(6)] + [(None, "en"), ("zzz", None)]
    model = langid.Model.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == sorted(bags)
    logp = []
    for k in model.langs:
        n = {}
        for t, lang in rows:
            if lang == k and t:
                for f, c in plain_counts(t)[1].items():
                    n[f] = n.get(f, 0) + c
        total = sum(n.values()) + 0.5 * langid.FEATURES
        logp.append((n, total))
        assert all(abs(model.logp[len(logp) - 1][f] - math.log((c + 0.5) / total)) < 1e-4 for f, c in n.items())

    def mixed(*ks):
        return " ".join(R.choice(bags[k]) for k in ks for _ in range(12))

    texts = [mixed("de"), mixed("en"), mixed("fr"), mixed("de", "en"), mixed("fr", "en", "de"), "haus", None, "", "12 !?", mixed("fr", "fr", "de")]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (99, mixed(*["en"] * 2000))], "doc_id long, text string")
    got = {}
    for r in langid.identify(docs, model).collect():
        assert got.setdefault(r.doc_id, r) == r
    for i, t in enumerate(texts):
        feats = plain_counts(t or "")[0]
        if not feats:
            assert (got[i].lang_pred, got[i].score, got[i].lang_set) == ("und", 0.0, "")
            continue
        ll = [[sum(math.log((n.get(f, 0) + 0.5) / total) for f in w) for n, total in logp] for w in feats]
        like = [[math.exp(x - max(row)) for x in row] for row in ll]
        full = plain_mixture(like, [0, 1, 2], langid.EM_STEPS)[0]
        order = sorted(range(3), key=lambda j: -full[j])
        chosen = order[:1]
        pi, value = plain_mixture(like, chosen, 1)
        for j in order[1:]:
            p, v = plain_mixture(like, [*chosen, j], langid.EM_STEPS)
            if v - value <= langid.PENALTY * 0.5 * math.log(len(feats) + 1):
                break
            chosen, pi, value = [*chosen, j], p, v
        best = max(range(3), key=lambda j: pi[j])
        assert got[i].lang_pred == model.langs[best] and abs(got[i].score - pi[best]) < 1e-3
        assert set(got[i].lang_set.split(",")) == {model.langs[j] for j in chosen}
    assert got[99].lang_pred == "en" and got[99].score > 0.99
    assert langid.identify(docs.where("false"), model).count() == 0
