"""Cross-tokenizer alignment against a plain reading of the contract: hostile texts, copies, nulls, hot keys, several blocks."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridmf.llm import align
from gridmf.llm.tokens import default_path, _byte_letters
from gridmf.llm.words import slices

PARTS = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "a", "the", "word", "words", "é", "12", "'s", "!", "...", "—", "▁", "<|endoftext|>", "<s>", "<0x0A>",
         "\x00", "🙂", "日本", "ﬁ", "é", "\xa0", "　", "<unk>", "x'll", "Ünïcode", "İ"]


def hostile(seed, count, most=25):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(count)]


TEXTS = [None, "", " ", "\n", "one", "one", "one two", *hostile(1, 150), "the word " * 3000]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the words"), (3, "one"), (3, "one")] + [(1000 + i, "hot text\n here") for i in range(120)]


def plain(rows):
    tok = Tokenizer.from_file(default_path())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=align.piece_path())
    back = {c: b for b, c in enumerate(_byte_letters())}
    per, found = defaultdict(Counter), {}
    for k, (_, t) in enumerate(rows):
        if not t:
            continue
        enc = tok.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in p)) for i, p in zip(enc.ids, enc.tokens)]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
             for i in sp.encode(t)]
        whole = (" " + t).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            continue
        ends = []
        for side in (a, b):
            at, spans = 0, []
            for i, x in side:
                spans.append((at, at + len(x), i))
                at += len(x)
            ends.append(spans)
        links = [(x[2], y[2]) for x in ends[0] for y in ends[1] if x[0] < y[1] and y[0] < x[1]] if len(whole) < 5000 else None
        if links is None:  # long: two pointers
            links, i, j = [], 0, 0
            while i < len(ends[0]) and j < len(ends[1]):
                links.append((ends[0][i][2], ends[1][j][2]))
                x, y = ends[0][i][1], ends[1][j][1]
                i, j = i + (x <= y), j + (y <= x)
        common = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        lo, groups = 0, []
        for e in common:
            groups.append("|".join(",".join(str(i) for s, f, i in side if lo <= s and f <= e) for side in ends))
            lo = e
        found[k] = (len(a), len(b), common, links, ";".join(groups))
        for p in set(links):
            per[p[0]][p] += 1
    out = []
    for k, (doc_id, _) in enumerate(rows):
        if k not in found:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, common, links, groups = found[k]
        best = sum(per[p[0]][p] == max(per[p[0]].values()) for p in links)
        out.append((doc_id, n_a, n_b, len(common), len(links), best, sum(per[p[0]][p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, block int, place string").repartition(3)


@pytest.mark.parametrize("links", [1 << 22, 300])
def test_measures_equal_a_plain_reading(docs, monkeypatch, links):
    monkeypatch.setattr(align, "BLOCK_LINKS", links)
    monkeypatch.setattr(align, "HOT", 5 if links == 300 else 1000)
    got = align.alignment_measures(docs).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(ROWS)))


def test_pieces_of_units_are_the_librarys():
    enc = align.PieceEncoder(align.piece_path())
    assert enc.by_units
    texts = [t for t in [*hostile(7, 3000), *hostile(8, 40, 400)] if t]
    for lo, buf, offs in slices(pa.array(texts), 1 << 14):
        spaced = np.insert(buf, offs[:-1], 32)
        ids, at = enc.slice_ids(spaced, offs + np.arange(len(offs)))
        for i in range(len(offs) - 1):
            assert ids[at[i]:at[i + 1]].tolist() == enc.model.encode(texts[lo + i]), repr(texts[lo + i])
    enc.by_units = False
    whole, _ = enc.slice_ids(spaced, offs + np.arange(len(offs)))
    assert whole.tolist() == ids.tolist()


def test_pair_counts_weigh_copies(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(40)] + [(99, "other words")], "doc_id long, text string")
    rows = align.aligned(docs, default_path(), align.piece_path())
    assert rows.where("key IS NOT NULL").count() == 2
    blocks = rows.selectExpr("block", "posexplode(arrays_zip(pair, rows)) AS (place, x)").selectExpr("block", "place", "x.pair", "x.rows")
    counts = align.pair_counts(blocks)
    assert {r["count"] for r in counts.collect()} == {1, 40, 41}
    assert counts.where("best").select("a").distinct().count() == counts.select("a").distinct().count()


def test_empty_table(docs):
    assert align.alignment_measures(docs.where("false")).count() == 0
    assert [tuple(r) for r in align.alignment_measures(docs.where("text IS NULL")).select(*COLUMNS).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]
