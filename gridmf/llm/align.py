"""Alignment of two tokenizers' tokens, each distinct text once.

Texts are shuffled by full text and counted, so copies are tokenised and aligned once and weigh by their
number.  A byte-level BPE file (A) encodes a space and the text, a SentencePiece BPE model (B), which puts that space itself,
the text; special tokens' strings inside texts are plain text.  Both then cover the same bytes, and the byte offsets where
tokens end give everything at once: offsets of both cut the text into groups, and each stretch between neighbouring offsets of
either lies in one A and one B token, a link, each overlapping pair once.

An id pair's count is the number of rows whose text holds it linked.  Texts go by blocks of about ``BLOCK_LINKS`` distinct
links: ``aligned`` writes a row per text, its pairs as places in the block's dictionary, and a row per block, the dictionary
with each pair's rows.  Only dictionaries are exploded, counted corpus-wide, compared with the best pair of their A id (at most one
row per B id each) and joined back; a block's texts meet its valued dictionary in one cogroup.  So no link is expanded, what is
joined is pairs per block, and a group is bounded by the block.  Measures go back to rows by the text's SHA-256: texts with more than
a ``HOT``-th of all rows, fewer than ``HOT``, are broadcast, so no key of the shuffled join holds more than that.

Null or empty texts, and texts whose joined token bytes differ from space and text for A or B (B reads U+2581 as a space),
have no tokens: zeros and no groups.  Repeated rows each get a row; null doc_ids are kept; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmf.llm.common import small_batches, stored, table
from gridmf.llm.tokens import MAX_UNITS, Encoder, default_path, _byte_letters
from gridmf.llm.words import find, hash_runs, slices

SLICE = 1 << 20
BLOCK_LINKS = 4 << 20
HOT = 1000
#: Ids of both vocabularies are below 2 ** ID_BITS.
ID_BITS = 20
MASK = (1 << ID_BITS) - 1


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Byte strings of a vocabulary's ids, flat."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ByteEncoder(Encoder):
    """A byte-level BPE file to which special tokens' strings are text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.added = []
        back = {c: b for b, c in enumerate(_byte_letters())}
        vocab = self.tok.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.tokens = Tokens(entries)


class PieceEncoder(Encoder):
    """A SentencePiece model over texts that begin with the space it adds.

    Where no piece has a space behind another character or holds a line feed, and the model changes no
    character, a text's pieces are those of its units, cut before each run of spaces and each run of line feeds; each distinct unit is
    given to the library once.  Other models, and texts that hold U+2581 themselves, get whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            norm = sentencepiece_model_pb2.ModelProto.FromString(f.read()).normalizer_spec
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_units = (norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
                         and not any(re.search("[^▁]▁|\n", p) for p in pieces))
        self.space = self.model.piece_to_id("▁")
        self.tokens = Tokens([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                              for i, p in enumerate(pieces)])
        self._forget()

    def _encode(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of byte strings, each beginning with a space (the model's own) or a line feed (whose added space goes)."""
        lead = [r[:1] == b" " for r in raws]
        ids = self.model.encode([r[1:].decode() if s else r.decode() for r, s in zip(raws, lead)], num_threads=1)
        # the library gives an empty string no ids, but a lone space is a piece
        return [[self.space] if r == b" " else x if s else x[1:] for r, x, s in zip(raws, ids, lead)]

    def _learn(self, keys: np.ndarray, raws: list[bytes]):
        ids = self._encode(raws)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        order = np.argsort(np.concatenate([self.known, keys]), kind="stable")
        self.known = np.concatenate([self.known, keys])[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def plain(self, text: str) -> list[int]:
        return self._encode([text.encode()])[0]

    def slice_ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.full(len(offs) - 1, not self.by_units)
        raw = buf.tobytes()
        if not self.by_units:
            return self._whole(buf, offs, odd, None, None)
        marks = [m.start() for m in re.finditer("▁".encode(), raw)]  # read as spaces
        odd[np.searchsorted(offs, marks, side="right") - 1] = True
        cut = np.zeros(len(buf), bool)
        for mark in (32, 10):
            is_mark = buf == mark
            is_mark[1:] &= buf[:-1] != mark
            cut |= is_mark
        cut[offs[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        h = hash_runs(buf, starts, ends)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(find(self.known, keys) < 0)
        if len(new) and len(self.known) + len(new) > MAX_UNITS:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        where = find(self.known, keys)[back]
        size = self.size[where]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.repeat(self.at[where] - total[:-1], size) + np.arange(total[-1])]
        at = total[np.searchsorted(starts, offs)]
        return self._whole(buf, offs, odd, ids, at) if odd.any() else (ids, at)


@functools.lru_cache(maxsize=2)
def encoders(a: str, b: str) -> tuple[ByteEncoder, PieceEncoder, list[bytes]]:
    """One pair per Python worker, and the decimal ids with what follows them in a written group."""
    enc_a, enc_b = ByteEncoder(a), PieceEncoder(b)
    n, m = len(enc_a.tokens.size), len(enc_b.tokens.size)
    if max(n, m) > MASK:
        raise ValueError("vocabulary too large for packed pairs")
    written = [f"{i}{end}".encode() for ids, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(ids)]
    return enc_a, enc_b, written


def _covering(tokens: Tokens, ids: np.ndarray, at: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts' joined tokens are the texts' bytes."""
    size = np.append(0, np.cumsum(tokens.size[ids]))
    good = size[at[1:]] - size[at[:-1]] == np.diff(offs)
    same = tokens.joined(ids[np.repeat(good, np.diff(at))]) == buf[np.repeat(good, np.diff(offs))]
    wrong = np.flatnonzero(~same)
    if len(wrong):
        ends = np.cumsum(np.where(good, np.diff(offs), 0))
        good[np.searchsorted(ends, wrong, side="right")] = False
    return good


def align_slice(enc_a: Encoder, enc_b: Encoder, written: list[bytes], buf: np.ndarray, offs: np.ndarray):
    """Of texts (not empty) in a slice: (n_a, n_b, n_groups, n_links, groups as text, text of each link, its A and B ids)."""
    n = len(offs) - 1
    buf = np.insert(buf, offs[:-1], 32)
    offs = offs + np.arange(n + 1)
    got = [(e, *e.slice_ids(buf, offs)) for e in (enc_a, enc_b)]
    good = np.logical_and(*[_covering(e.tokens, ids, at, buf, offs) for e, ids, at in got])
    ends, ids, count = [], [], []
    for e, i, at in got:
        use = np.repeat(good, np.diff(at))
        size = e.tokens.size[i]
        # a text's tokens end at its own offsets, whatever those before it cover
        before = np.append(0, np.cumsum(size))
        end = before[1:] + np.repeat(offs[:-1] - before[at[:-1]], np.diff(at))
        ends.append(end[use])
        ids.append(i[use].astype(np.int64))
        count.append(np.where(good, np.diff(at), 0))
    mark = np.zeros((2, len(buf) + 1), bool)
    for side in (0, 1):
        mark[side, ends[side]] = True
    both = mark[0] & mark[1]
    cuts = np.flatnonzero(mark[0] | mark[1])
    text = np.searchsorted(offs, cuts, side="left") - 1
    link_ids = [ids[side][(np.cumsum(mark[side]) - mark[side])[cuts]] for side in (0, 1)]
    done = np.cumsum(both)
    group = [done[e] - both[e] for e in ends]
    n_groups = np.diff(np.append(0, done[offs[1:]]))
    size = [np.bincount(g, minlength=int(done[-1])) for g in group]
    upto = [np.append(0, np.cumsum(s)) for s in size]
    n_a = len(enc_a.tokens.size)
    n_b = len(enc_b.tokens.size)
    codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    codes[np.arange(len(ids[0])) + upto[1][group[0]]] = ids[0] + n_a * both[ends[0]]
    codes[np.arange(len(ids[1])) + upto[0][group[1] + 1]] = 2 * n_a + ids[1] + n_b * both[ends[1]]
    at = np.append(0, np.cumsum(count[0] + count[1])).tolist()
    codes = codes.tolist()
    groups = [b"".join([written[c] for c in codes[lo:hi]])[:-1].decode() for lo, hi in zip(at[:-1], at[1:])]
    n_links = np.bincount(text, minlength=n)
    return count[0], count[1], n_groups, n_links, groups, text, link_ids


class Dictionary:
    """A block's distinct pairs in order of their first slice, and the rows that hold each."""

    def __init__(self):
        self.pairs = np.zeros(0, np.int64)  # sorted
        self.place = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)   # by place
        self.links = 0

    def add(self, pairs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the pairs (distinct within a text; ``rows``: the text's copies)."""
        own, back = np.unique(pairs, return_inverse=True)
        new = own[find(self.pairs, own) < 0]
        order = np.argsort(np.concatenate([self.pairs, new]), kind="stable")
        self.place = np.concatenate([self.place, len(self.rows) + np.arange(len(new))])[order]
        self.pairs = np.concatenate([self.pairs, new])[order]
        self.rows = np.concatenate([self.rows, np.zeros(len(new), np.int64)])
        place = self.place[find(self.pairs, own)][back]
        self.rows += np.bincount(place, weights=rows, minlength=len(self.rows)).astype(np.int64)
        self.links += len(pairs)
        return place

    def by_place(self) -> np.ndarray:
        out = np.empty(len(self.pairs), np.int64)
        out[self.place] = self.pairs
        return out


SCHEMA = ("block long, key string, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, "
          "place array<int>, times array<int>, pair array<long>, rows array<long>")


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of texts (``key``, the text's SHA-256, is not null) and of blocks (``pair`` and its ``rows``, by place).

    ``groups`` has the groups in order, ``a1,a2|b1;a3|b2,b3``: A's ids, B's ids.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").groupBy("text").agg(
        F.count(F.lit(1)).alias("copies")).select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "copies", "text")

    def each(batches):
        from pyspark import TaskContext

        enc_a, enc_b, written = encoders(a, b)
        block, words = TaskContext.get().partitionId() << 32, Dictionary()

        def close():
            blank = [pa.nulls(1, t) for t in (pa.string(), *[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int32())] * 2)]
            size = np.array([len(words.rows)])
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), *blank, _lists(words.by_place(), size, pa.int64()), _lists(words.rows, size, pa.int64())], names=names)

        for batch in batches:
            for lo, buf, offs in slices(batch.column("text"), SLICE):
                n = len(offs) - 1
                part = batch.slice(lo, n)
                *counts, groups, text, (ids_a, ids_b) = align_slice(enc_a, enc_b, written, buf, offs)
                copies = part.column("copies").to_numpy(zero_copy_only=False)
                key, times = np.unique((text << (2 * ID_BITS)) | (ids_a << ID_BITS) | ids_b, return_counts=True)
                of = key >> (2 * ID_BITS)
                place = words.add(key & ((1 << (2 * ID_BITS)) - 1), copies[of])
                per = np.bincount(of, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), part.column("key"), pa.array(copies), *[pa.array(c) for c in counts], pa.array(groups, pa.string()),
                     _lists(place, per, pa.int32()), _lists(times, per, pa.int32()),
                     *[pa.nulls(n, pa.list_(pa.int64()))] * 2], names=names)
                if words.links > BLOCK_LINKS:
                    yield close()
                    block, words = block + 1, Dictionary()
        if len(words.rows):
            yield close()

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return texts.mapInArrow(each, SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best) of (block, pair, rows): ``count`` rows hold the pair linked; best: no pair of its A id has more."""
    counts = blocks.groupBy("pair").agg(F.sum("rows").alias("count")).withColumn("a", F.shiftright("pair", ID_BITS).cast("int")) \
        .withColumn("b", F.col("pair").bitwiseAND(F.lit(MASK)).cast("int"))
    most = F.max("count").over(Window.partitionBy("a"))
    return counts.select("pair", "a", "b", "count", (F.col("count") == most).alias("best"))


def _measured(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's texts with the sums over their links: n_best and count_sum."""
    right = right.sort_by("place")
    count, best = (right.column(c).to_numpy().astype(np.int64) for c in ("count", "best"))
    place = left.column("place").combine_chunks()
    times = left.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    per = pc.list_value_length(place).to_numpy(zero_copy_only=False)
    at = np.append(0, np.cumsum(per))
    place = place.flatten().to_numpy()
    sums = [np.append(0, np.cumsum(times * x[place]))[at] for x in (best, count)]
    keep = left.select(["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    for name, s in zip(("n_best", "count_sum"), sums):
        keep = keep.append_column(name, pa.array(np.diff(s)))
    return keep


def text_measures(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(key, copies, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every distinct text."""
    rows = aligned(docs, a, b).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(
        F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")
    rows = stored(rows, "aligned")
    blocks = rows.where("key IS NULL").select("block", F.posexplode(F.arrays_zip("pair", "rows")).alias("place", "x")) \
        .select("block", "place", "x.pair", "x.rows")
    valued = blocks.select("block", "place", "pair").join(pair_counts(blocks), "pair").select(
        "block", "place", "count", F.col("best").cast("int").alias("best"))
    texts = rows.where("key IS NOT NULL").select(F.col("block").alias("of"), "key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "times")
    out = texts.groupBy("of").cogroup(valued.groupBy("block")).applyInArrow(
        _measured, "key string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return stored(out, "measures")


def alignment_measures(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """The contract's rows: measures of each row's text."""
    found = text_measures(docs, a or default_path(), b or piece_path())
    total = int(found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    often = F.col("copies") > total // HOT
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text != "", F.sha2(text.cast("binary"), 256)).alias("key"))
    hot = found.where(often).select("key", F.struct(*names, "groups_sha256").alias("hot"))  # fewer than HOT rows
    rest = found.where(~often).select(F.col("key").alias("rest_key"), F.struct(*names, "groups_sha256").alias("rest"))
    met = keyed.join(F.broadcast(hot), "key", "left")
    # rows of hot texts, and those without a text, need no partner: their keys are dealt out
    other = F.when(F.col("hot").isNull(), F.col("key"))
    met = met.withColumn("want", F.coalesce(other, F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))))
    met = met.join(rest, F.col("want") == F.col("rest_key"), "left").withColumn("m", F.coalesce("hot", "rest"))
    return met.select("doc_id", *[F.coalesce(F.col(f"m.{c}"), F.lit(0)).cast("long").alias(c) for c in names],
                      F.coalesce("m.groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_measures(table(spark, sf_dir, "documents"))
