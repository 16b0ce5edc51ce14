"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are lower-cased words and one end per text.  A context is the 1 to ``DEPTH`` tokens before a token, within its
text; a start mark stands before the first word.

Learning.  Occurrences of all grams of 1 to ``DEPTH + 1`` tokens in the training texts are counted, level by level: a gram
only if its context, the gram without its last token, occurs ``MIN_COUNT`` times.  That is an absolute count, so the tree
grows with the corpus.  A context becomes a state if it predicts its own next tokens better than its suffix does: the sum
over its occurrences of ln(P(next | context) / P(next | suffix)) must be at least ``DIVERGENCE``, each occurrence left out of
the context's own counts (without that, n * KL(context || suffix) grows with every token seen once).  For a next token seen
c >= 2 times the left-out estimate is taken as (c - 1) / (n - 1 + T), a lower bound.

Smoothing.  A state with n occurrences and T different next tokens gives (c + T * P(next | suffix)) / (n + T); a context
that is no state gives what its suffix gives.  The symbols are those of the base: the V known tokens and one unknown.  At
the root the unknown has the mass of the tokens seen once and the known share the rest as (c + 1/2).  Every position
is predicted from the longest state that ends before it.

Scale.  Texts are coded block by block (a block is a run of texts of about ``BLOCK_BYTES``): its distinct words' 64-bit hashes,
and the texts as numbers of those words, written once.  For each level a block sends its distinct grams' hashes and counts,
in ranges of the hash, and gets the corpus counts back in the order it sent them; states are settled the same way, by
context.  A gram comes once a block, so a frequent one is no hot key, and the number of ranges follows the input
(``RANGE_TOKENS`` tokens each).  Nothing of the tree is collected or broadcast.

Null or blank texts are the end alone; repeated rows are scored alike; no training text leaves N = V = 0 and a uniform
model; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import folded, stored, table
from gridmf.llm.words import mix, slices, words

DEPTH = 3
MIN_COUNT = 4
DIVERGENCE = 10.0
BLOCK_BYTES = 8 << 20
RANGE_TOKENS = 1 << 21
START, END = np.uint64(0x8D3F1B6A52C7E094), np.uint64(0x3A9C47E1F05B8D26)  # stand for words
NEXT = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)
CODED = "block long, doc_ids array<long>, held array<boolean>, n_words array<long>, codes binary, words binary"
SENT = "kind int, bucket int, block long, keys binary, vals binary"
BACK = "block long, kind int, bucket int, vals binary, n long, kinds long, once long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, all lowest bytes first; 8 bytes of length before."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size, item = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(item, -1).T).view(kind)[:, 0]


def packed_keys(h: np.ndarray) -> bytes:
    """Hashes in runs of ascending ones, as differences."""
    return packed(np.diff(h.astype("<u8"), prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


def code_texts(docs: DataFrame, held: str) -> DataFrame:
    """Blocks of texts: hashes of their distinct words and the texts as numbers of those words."""
    def each(batches):
        part, seq = TaskContext.get().partitionId(), 0
        rows: list = []
        size = 0

        def flush():
            nonlocal rows, size, seq
            ids, out_of, n_words, h = (np.concatenate(x) for x in zip(*rows))
            keys, codes, n = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.empty(len(keys), np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(keys))
            order = np.argsort(np.digitize(rank, [1 << 8, 1 << 16]), kind="stable")  # frequent words have short numbers
            number = np.empty(len(keys), "<u4")
            number[order] = np.arange(len(keys))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([out_of.tolist()], pa.list_(pa.bool_())),
                 pa.array([n_words], pa.list_(pa.int64())), pa.array([packed(number[codes])], pa.binary()),
                 pa.array([packed_keys(keys[order])], pa.binary())],
                names=["block", "doc_ids", "held", "n_words", "codes", "words"])
            seq, rows, size = seq + 1, [], 0
            return batch

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out_of = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, buf, offs in slices(batch.column("text"), 4 << 20):
                h, _, _, first = words(buf, offs)
                hi = lo + len(offs) - 1
                rows.append((ids[lo:hi], out_of[lo:hi], np.diff(first), h))
                size += len(buf)
                if size >= BLOCK_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"), F.col(held).alias("held"),
                       F.col("text").cast("string").alias("text")).mapInArrow(each, CODED)


class Grams:
    """One block's token sequence and, level by level, its distinct grams with what the corpus says of them.

    ``keys[k]``: sorted hashes of the counted grams of k tokens; ``at[k]``: each position's gram that ends there (-1: none);
    ``c[k]``: the grams' training counts, ``first[k]``: whether this block answers for the gram, ``kinds[k]``: T of
    those that are states, else 0.
    """

    def __init__(self, row: dict, back: dict[int, bytes]):
        known = unpacked_keys(row["words"])
        n = np.array(row["n_words"], np.int64) + 2
        end = np.cumsum(n)
        inner = np.ones(end[-1], bool)
        inner[end - n] = inner[end - 1] = False
        seq = np.empty(end[-1], np.int64)
        seq[inner] = unpacked(row["codes"], "<u4")
        seq[end - n], seq[end - 1] = len(known), len(known) + 1
        hashes = np.append(known, [START, END])
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.word, self.begin = hashes[seq], np.zeros(end[-1], bool)
        self.begin[end - n] = True
        self.text = np.repeat(np.arange(len(n)), n)
        self.train = ~np.array(row["held"], bool)[self.text]
        self.keys, self.at, self.c, self.first, self.kinds = {1: hashes[order]}, {1: rank[seq]}, {}, {}, {}
        self.place = {}
        for k in range(1, DEPTH + 2):
            if k > 2 and k - 1 not in self.c:
                break
            if k > 1:
                self._grams(k)
            if 2 * k in back:
                got = unpacked(back[2 * k], "<i8")
                self.c[k], self.first[k] = got >> 1, (got & 1).astype(bool)
        for k in range(1, DEPTH + 1):
            if 2 * k + 1 in back:
                self.kinds[k] = np.zeros(len(self.keys[k]), np.int64)
                self.kinds[k][self.c[k] >= MIN_COUNT] = unpacked(back[2 * k + 1], "<i8")

    def _grams(self, k: int) -> None:
        """Grams of k tokens whose context is counted often enough; all pairs, which are sent with the words."""
        up = self.at[k - 1][:-1]
        often = (up >= 0) & (self.c[k - 1][up] >= MIN_COUNT) if k > 2 else np.ones(len(up), bool)
        pos = np.flatnonzero(often & ~self.begin[1:]) + 1
        h = mix(self.keys[k - 1][self.at[k - 1][pos - 1]] * NEXT + self.word[pos])
        order = np.argsort(h)
        h = h[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        self.keys[k], self.place[k] = h[new], pos[order[new]]
        self.at[k] = np.full(len(self.word), -1, np.int64)
        self.at[k][pos[order]] = np.cumsum(new) - 1

    def counts(self, k: int) -> np.ndarray:
        """Training occurrences of each distinct gram in this block."""
        at = self.at[k][self.train]
        return np.bincount(at[at >= 0], minlength=len(self.keys[k])).astype("<i8")

    def prob(self, root: tuple, pos: np.ndarray, depth: int) -> np.ndarray:
        """P(token at ``pos`` | states of up to ``depth`` tokens)."""
        n, v, once = root
        c = self.c[1][self.at[1][pos]]
        unknown = (once + 0.5) / (n + 1) if v else 1.0
        p = np.where(c > 0, (1 - unknown) * (c + 0.5) / max(n + 0.5 * v, 0.5), unknown)
        for k in range(1, depth + 1):
            context = self.at[k][pos - 1]
            on = np.flatnonzero((context >= 0) & ~self.begin[pos])
            on = on[self.kinds[k][context[on]] > 0]
            t, of = self.kinds[k][context[on]], self.c[k][context[on]]
            p[on] = (self.c[k + 1][self.at[k + 1][pos[on]]] + t * p[on]) / (of + t)
        return p

    def gains(self, root: tuple, k: int) -> np.ndarray:
        """Of each context of k tokens that may be a state: (T, once, sum, n) over the grams this block answers for."""
        own = np.flatnonzero(self.first[k + 1] & (self.c[k + 1] > 0))
        pos, c = self.place[k + 1][own], self.c[k + 1][own]
        context = self.at[k][pos - 1]
        gain = np.where(c > 1, c * np.log(np.maximum(c - 1, 1) / self.prob(root, pos, k - 1)), 0)
        size = len(self.keys[k])
        out = np.stack([np.bincount(context, minlength=size), np.bincount(context, c == 1, size), np.bincount(context, gain, size),
                        self.c[k]], axis=1).astype("<f8")
        return out[self.c[k] >= MIN_COUNT]


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def _sent(step: int, bits: int, row: dict, back: dict[int, bytes], root: tuple | None):
    """A block's rows of one step: counts of grams of ``step + 1`` tokens (even kinds; the first step: words too), gains of contexts
    of ``step - 1`` (odd kinds)."""
    g = Grams(row, back)
    kind, bucket, keys, vals = [], [], [], []

    def add(what, h, x):
        cut = _ranges(h, bits)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            kind.append(what)
            bucket.append(b)
            keys.append(packed_keys(h[cut[b]:cut[b + 1]]))
            vals.append(packed(x[cut[b]:cut[b + 1]]))

    for k in ([1, 2] if step == 1 else [step + 1]):
        if k <= DEPTH + 1:
            add(2 * k, g.keys[k], g.counts(k))
    if step > 1:
        k = step - 1
        x = g.gains(root, k)
        add(2 * k + 1, g.keys[k][g.c[k] >= MIN_COUNT], x.view("V32")[:, 0])
    return pa.table([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array([row["block"]] * len(kind), pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(vals, pa.binary())], names=["kind", "bucket", "block", "keys", "vals"])


def _settle(rows: pa.Table) -> pa.Table:
    """Corpus counts (or states) of one range of hashes, for each block in the order it sent them."""
    rows = rows.sort_by("block")
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    keys = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
    cut = np.append(0, np.cumsum([len(x) for x in keys]))
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    at, which = np.flatnonzero(new), np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    totals = (0, 0, 0)
    if kind % 2 == 0:
        x = np.concatenate([unpacked(v, "<i8") for v in rows.column("vals").to_pylist()])
        c = np.add.reduceat(x[order], at)
        lead = np.zeros(len(keys), np.int64)
        lead[order[at]] = 1
        out = c[which] << 1 | lead
        totals = (int(c.sum()), int((c > 0).sum()), int((c == 1).sum()))
    else:
        x = np.concatenate([unpacked(v, "V32").copy().view("<f8").reshape(-1, 4) for v in rows.column("vals").to_pylist()])[order]
        t, once, gain = np.add.reduceat(x[:, :3], at).T
        n = x[at, 3]
        t1 = np.maximum(t, 1)
        out = np.where(gain + once * np.log(t1) - n * np.log(n - 1 + t1) >= DIVERGENCE, t, 0).astype(np.int64)[which]
    size = rows.num_rows
    return pa.table([rows.column("block"), pa.array([kind] * size, pa.int32()), pa.array([bucket] * size, pa.int32()),
                     pa.array([packed(out[a:b].astype("<i8")) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                     *(pa.array([x] + [0] * (size - 1), pa.int64()) for x in totals)],
                    names=["block", "kind", "bucket", "vals", "n", "kinds", "once"])


def _got(back: pa.Table) -> dict[int, bytes]:
    """What came back to a block, by kind, in order of the ranges."""
    out: dict[int, list] = {}
    for r in sorted(back.select(["kind", "bucket", "vals"]).to_pylist(), key=lambda r: r["bucket"]):
        out.setdefault(r["kind"], []).append(unpacked(r["vals"], "<i8"))
    return {k: packed(np.concatenate(v)) for k, v in out.items()}


def _rows(blocks: pa.Table, back: pa.Table):
    """(block, what came back to it); kinds that found nothing are empty."""
    got = _got(back)
    for row in blocks.to_pylist():
        yield row, got


def score_texts(docs: DataFrame, held: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows with ``held`` true train nothing."""
    blocks = stored(code_texts(docs, held), "coded")
    t = blocks.agg(F.sum(F.expr("aggregate(n_words, 0L, (a, x) -> a + x + 2)")).alias("tokens"),
                   F.sum(F.size(F.filter("held", lambda x: ~x))).alias("texts")).first()
    n_texts = int(t.texts or 0)
    bits = max(3, (int(t.tokens or 0) // RANGE_TOKENS).bit_length())
    root, back = None, None
    for step in range(1, DEPTH + 2):
        if back is None:
            sent = blocks.mapInArrow(_first(bits), SENT)
        else:
            sent = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_later(step, bits, root), SENT)
        got = _settled(sent.groupBy("kind", "bucket").applyInArrow(_settle, BACK), f"grams-{step}")
        if step == 1:
            s = got.where("kind = 2").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "kinds", "once"))).first()
            root = (int(s.n) - n_texts, int(s.kinds) - (n_texts > 0), int(s.once) - (n_texts == 1))  # the start mark is no token
        got = got.select("block", "kind", "bucket", "vals")
        back = got if back is None else back.unionByName(got)
    n_train, distinct, _ = root
    none = _empty(DEPTH + 2)

    def each(left, right):
        out = []
        for row, got in _rows(left, right):
            g = Grams(row, {**none, **got})
            pos = np.flatnonzero(~g.begin)
            text, size = g.text[pos], len(row["n_words"])
            c = g.c[1][g.at[1][pos]]
            base = np.log10(c + 0.5) - np.log10(n_train + 0.5 * (distinct + 1))
            ids = np.array(row["doc_ids"], np.int64)
            out.append(pa.table([
                pa.array(ids, mask=ids == NO_ID), pa.array(row["held"], pa.bool_()), pa.array(np.array(row["n_words"], np.int64) + 1),
                pa.array(np.bincount(text, c > 0, size).astype(np.int64)), pa.array(np.full(size, n_train, np.int64)),
                pa.array(np.bincount(text, base, size)), pa.array(np.bincount(text, np.log10(g.prob(root, pos, DEPTH)), size))], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in (
            pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)

    names = [f.split()[0] for f in SCORES.split(", ")]
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(each, SCORES)


def _settled(df: DataFrame, name: str) -> DataFrame:
    """Stored; the shuffle files of this write go when it ends, not when the driver happens to collect garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def _first(bits: int):
    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(1, bits, row, {}, None).to_batches()

    return each


def _later(step: int, bits: int, root: tuple):
    none = _empty(step)
    nothing = pa.table({f: pa.array([], k) for f, k in (
        ("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary()))})

    def each(left, right):
        return pa.concat_tables([nothing, *(_sent(step, bits, row, {**none, **got}, root) for row, got in _rows(left, right))])

    return each


def _empty(step: int) -> dict[int, bytes]:
    """What is known before ``step`` of a block that holds no gram of some level."""
    nothing = packed(np.zeros(0, "<i8"))
    return {**{2 * k: nothing for k in range(1, min(step, DEPTH + 1) + 1)}, **{2 * k + 1: nothing for k in range(1, step - 1)}}


def op2_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.withColumn("_held", folded("doc_id") % 5 == 1), "_held")
