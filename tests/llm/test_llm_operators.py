"""Text operators against brute force, exact round trips and their contracts, with nulls, blanks, ties and clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridmf.llm import decontaminate, fingerprint, langid, license, lm, neardup, packing, substring, tokenfile, toxicity, words
from gridmf.llm.tokens import default_path, encoder

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE = prose(120, 1)
NEAR = " ".join(BASE.split()[:-3] + ["x", "y", "z"])
PASSAGE = prose(70, 2)
TEXTS = [BASE, NEAR, BASE, None, "", "  \n ", "one two", "One  TWO", prose(200, 3) + "\n" + PASSAGE + "\n" + prose(50, 4),
         prose(150, 5) + "\n" + PASSAGE + "\n" + prose(90, 6), "Released under the MIT License.", "é ñ ß — x", prose(3000, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 7) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false").drop("node")


def word_list(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_words_match_a_regex():
    for lo, buf, offs in words.slices(pa.array(TEXTS), 300):
        h, _, _, first = words.words(buf, offs)
        for i in range(len(offs) - 1):
            assert h[first[i]:first[i + 1]].tolist() == [words.hash_word(w) for w in word_list(TEXTS[lo + i])]


def test_near_duplicates_match_brute_force(docs, empty):
    sets = {i: shingle_set(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], r.doc_id == root[r.doc_id])
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if root[i] == i)
    assert neardup.near_duplicates(empty).count() == 0


def test_likelihood_keeps_close_pairs_and_drops_far_ones():
    r = np.random.default_rng(3)
    common = r.integers(0, 2**63, 900).astype(np.uint64)
    for keep, want in ((900, True), (300, False)):
        a = np.unique(np.concatenate([common[:keep], r.integers(0, 2**63, 1000 - keep).astype(np.uint64)]))
        b = np.unique(np.concatenate([common[:keep], r.integers(0, 2**63, 1000 - keep).astype(np.uint64)]))
        got = neardup.likely(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([1000.0]), np.array([1000.0]))
        assert bool(got[0]) is want


def test_suffix_tree_base_matches_brute_force(docs, empty):
    from pyspark.sql import functions as F

    rows = lm.score_texts(docs.withColumn("_held", F.col("doc_id") % 4 == 1), "_held").collect()
    count: dict = {}
    for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]:
        if i % 4 != 1:
            for w in [*word_list(t), "\n"]:
                count[w] = count.get(w, 0) + 1
    total, kinds = sum(count.values()), len(count)
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        tokens = [*word_list(TEXTS[r.doc_id]), "\n"]
        base = sum(np.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in count for w in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert lm.score_texts(empty.withColumn("_held", F.lit(False)), "_held").count() == 0


def test_toxic_words_raise_severity(spark):
    rows = [(i, prose(40, 100 + i) + (" vilex vilexa grumx" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == bool(y) for i, _, y in rows)
    assert not got[900].toxic and not got[901].toxic
    assert toxicity.drop_toxic(docs, model).count() == 152
    assert toxicity.fit(docs, labels.where("false")).scores(pa.array(["x", None]))[2].max() < 0.5


def test_repeated_passage_is_cut_from_the_later_document(docs, empty):
    out = {r.doc_id: r.text for r in substring.drop_repeats(docs).collect()}
    words_of = PASSAGE.split()
    middle = " ".join(words_of[25:45])
    assert middle in out[8] and middle not in out[9]
    assert out[3] is None and out[4] == "" and out[12] == TEXTS[12] and out[0] == TEXTS[0]
    assert substring.repeats(empty).count() == 0 and substring.drop_repeats(empty).count() == 0


def test_chunks_tile_texts_and_survive_insertions():
    text = prose(400, 9)
    for t in (text, "aaaa" * 2000, "é" * 3000, "x"):
        buf = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = substring.chunks(buf, np.array([0, len(buf)]))
        assert s[0] == 0 and e[-1] == len(buf) and (s[1:] == e[:-1]).all()
        assert "".join(bytes(buf[a:b]).decode() for a, b in zip(s, e)) == t
    cut = [{bytes(b[x:y]) for x, y in zip(*substring.chunks(b, np.array([0, len(b)]))[:2])}
           for b in (np.frombuffer(x.encode(), np.uint8) for x in (text, "inserted words " + text))]
    assert len(cut[0] - cut[1]) <= 2


def test_decontamination_finds_exact_and_edited_items(spark):
    items = [(i, prose(40, 200 + i)) for i in range(40)]
    edited = [t.replace("a", "A", 3)[:-1] + "q" for _, t in items]
    docs = spark.createDataFrame([(i, prose(60, 300 + i) + " " + e.upper() + "  " + prose(20, 400 + i)) for i, e in enumerate(edited)]
                                 + [(100, None), (101, ""), (102, prose(500, 999))], "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, None), (91, "  ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(found) == {(i, i) for i in range(40)}
    assert all(r.edits <= 2 for r in found.values())
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [100, 101, 102]
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_language_mixture(spark):
    english, other = "the house and the river were here with them", "das haus und der fluss waren hier mit ihnen"
    train = spark.createDataFrame([(english, "en"), (other, "de")] * 3 + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.Model.fit(train)
    docs = spark.createDataFrame([(1, english), (2, other), (3, None), (4, "123 !?"), (5, english + " " + other)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert set(got[5].lang_set.split(",")) == {"en", "de"} and all(0 <= r.score <= 1 for r in got.values())


def test_license_lines(docs):
    got = [(r.doc_id, r.place, r.license) for r in license.scan(docs).collect()]
    assert got == [(10, 0, "MIT")]


def test_fingerprints(docs, empty):
    import hashlib

    rows = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs.where("lang IS NOT NULL")).collect()}
    order = sorted(rows, reverse=True)
    for i, k in enumerate(order):
        text, after = TEXTS[k] or "", TEXTS[order[(i + 1) % len(order)]] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert rows[k].n_chars == len(text) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k].near_edited <= 1 and 0 <= rows[k].near_next <= 1
    assert rows[0].fingerprint == rows[2].fingerprint != rows[1].fingerprint
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_fingerprint_ignores_order_and_updates(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "a b\nc d\ne"), (2, "e\na b\nc d"), (3, "a b\ne"), (4, "c d")], "doc_id long, text string")
    v = fingerprint.document_fingerprints(d)
    f = {r.doc_id: r.fingerprint for r in v.collect()}
    one, other = v.where("doc_id = 3").select(F.col("vec").alias("x"), F.lit(1).alias("k")), v.where("doc_id = 4").select(F.col("vec").alias("y"), F.lit(1).alias("k"))
    both = one.join(other, "k").select(fingerprint.fingerprint(fingerprint.combine(F.col("x"), F.col("y"))).alias("f")).first().f
    assert f[1] == f[2] == both != f[3]
    whole = v.where("doc_id = 1").select(F.col("vec").alias("x"), F.lit(1).alias("k"))
    less = whole.join(other, "k").select(fingerprint.fingerprint(fingerprint.combine(F.col("x"), F.col("y"), remove=True)).alias("f")).first().f
    assert less == f[3]


def test_fingerprints_tell_paragraphs_apart(spark):
    texts = ["A. B.\nC.", "A.\nB. C.", "C.\n\n  A. B. ", "A. B.\nC.\nC.", None, "", " \n "]
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprint.document_fingerprints(d).collect()}
    assert f[0] == f[2] == f[None] and len({f[0], f[1], f[3], f[4]}) == 4 and f[4] == f[5] == f[6]


def test_likeness_follows_the_share_of_common_sentences(spark):
    """Both likenesses against the exact share of common sentences (larger count), within 4.5 standard errors."""
    def share(a, b):
        x, y = ([s.strip() for p in t.split("\n") for s in re.split(r"(?<=[.!?]) ", p) if s.strip()] for t in (a, b))
        return sum(min(x.count(s), y.count(s)) for s in set(x)) / max(len(x), len(y), 1)

    line = [" ".join(prose(6, 700 + i) + "." for i in range(k, k + 3)) for k in range(0, 300, 3)]
    texts = {9: "\n".join(line[:40]), 8: "\n".join(line[:40]), 7: "\n".join(line[20:60]), 6: "\n".join(line[60:])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    order = sorted(texts, reverse=True)
    for r in fingerprint.edited_fingerprints(d).collect():
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        assert r.near_next == pytest.approx(share(text, after), abs=0.5)
        assert r.near_edited == pytest.approx(share(text, text[:len(text) - half] + after[:half]), abs=0.5)
        assert (r.near_next == 1.0) == (r.doc_id == 9)


def expected_ids(text, end):
    return np.array([*encoder(default_path()).plain(text or ""), end], "<u4")


def test_packing_tiles_every_document(docs, empty):
    pieces: dict = {}
    rows = packing.packed_rows(docs.where("lang IS NOT NULL")).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(TEXTS):
        ids, at = expected_ids(t, 1), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.packed_rows(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    from gridmf.session import scratch_path

    path = scratch_path(spark, "tokens-test")
    tokenfile.write_token_files(docs.where("lang IS NOT NULL"), default_path(), path)
    rows = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, t in zip(rows, TEXTS, strict=True):
        ids = expected_ids(t, 2)
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.array_equal(np.frombuffer(r.ids, "<u4"), ids)
        start += len(ids)
    path = scratch_path(spark, "tokens-empty")
    tokenfile.write_token_files(empty, default_path(), path)
    assert tokenfile.read_token_files(spark, path).count() == 0
    path = scratch_path(spark, "tokens-null")
    tokenfile.write_token_files(spark.createDataFrame([(None, "a b"), (-3, "c"), (None, None)], "doc_id long, text string"), default_path(), path)
    rows = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, -3] and [r.n_tokens for r in rows][0] == 1


def test_part_starts_are_prefix_sums(spark):
    r = random.Random(8)
    for groups in (1, 3, 1024):
        rows = [(p, r.randint(1, 2**40)) for p in r.sample(range(200), 60) for _ in range(2)]
        shards = spark.createDataFrame(rows, "part int, n_ids long")
        got = {x.part: x.part_start for x in tokenfile.part_starts(shards, groups).collect()}
        assert got == {p: sum(n for q, n in rows if q < p) for p, _ in rows}
    assert tokenfile.part_starts(shards.where("false")).count() == 0


def test_shard_blocks_with_outliers():
    r = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = r.integers(0, 300, n).astype(np.uint32)
        if n > 10:
            ids[r.integers(0, n, 5)] = 2**32 - 1
        shard = tokenfile.Shard(tokenfile.encode_shard(np.array([5]), np.array([n]), ids))
        assert np.array_equal(tokenfile.read_ids(shard, 0, n), ids)
        assert np.array_equal(tokenfile.read_ids(shard, n // 3, n // 2), ids[n // 3:n // 2])


def test_segmented_ids_equal_the_library():
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\r\n", "a", "B", "é", "12", "'s", "!", "...", "—", " ", " ", "<|endoftext|>", "x'll", "\x1f", "🙂", "İ"]
    texts = ["", None, *("".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(1500))]
    enc = encoder(default_path())
    for lo, ids, at in enc.column(pa.array(texts)):
        for i in range(len(at) - 1):
            assert ids[at[i]:at[i + 1]].tolist() == enc.plain(texts[lo + i] or "")
