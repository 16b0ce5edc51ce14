"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of every whole text (16-bit words, so it sees the last 16 bytes).
A chunk ends where the hash is the largest among its ``REACH`` neighbours on either side: cuts depend on
nearby bytes only, so text inserted elsewhere shifts no chunk; chunks hold about ``2 * REACH + 1``
bytes.  Where a text offers no cut for ``LONGEST`` bytes (a repeated character, say), cuts are set every
``LONGEST`` bytes.  No cut splits a character.

A chunk is known by a 64-bit digest, its length, its number of words and ``CHECK_BITS`` bits of a second hash (about 80
bits together); it comes first in the smallest doc_id that holds it, at its least place there.  Everywhere else it repeats, later in the same document too, and a run of adjoining repeated chunks of
at least ``MIN_WORDS`` words or ``MIN_BYTES`` bytes (scripts without spaces, tables, encoded data) is a
repeated passage.  A passage loses at either end up to the chunk its edge falls in, so passages of over 50
words hold such a run, while short repeated lines and common phrases do not.  ``repeats`` lists the passages,
``drop_repeats`` cuts out all but the first.

Scale: each chunk is one row of four numbers; first documents come from a partially aggregated groupBy,
and the join that brings them back is an equi-join whose hot digests adaptive execution can split.

Null or empty texts have no chunks and stay as they are.  Rows with one doc_id and one text are one
document: each is cut alike and they do not count as repeats of each other; a null doc_id comes before all
others.  Empty tables give empty results; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import small_batches, table, unused
from gridmf.llm.words import SPACE, hash_runs, mix, powers, seeds, slices

REACH = 20
LONGEST = 1024
MIN_WORDS = 20
MIN_BYTES = 120
CHECK_BITS = 10
_SECOND = seeds(256, 37)
GEAR = (seeds(256, 31) >> np.uint64(20)).astype(np.uint16)


def _most(x: np.ndarray, n: int) -> np.ndarray:
    """Largest of x[i : i + n]; beyond the end: 0."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        nxt = out.copy()
        if step < len(out):
            nxt[:-step] = np.maximum(out[:-step], out[step:])
        out, have = nxt, have + step
    return out


def chunks(buf: np.ndarray, offs: np.ndarray, reach: int = REACH, longest: int = LONGEST):
    """Starts and ends of all texts' chunks, and each text's first chunk.

    Rolling state does not cross texts: the first 16 bytes of a text see zeros before them.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    # texts are laid out with 16 + reach zero bytes between them, so neither hash nor neighbourhood crosses
    pad = 16 + reach
    at = np.arange(n) + np.repeat(np.arange(1, len(offs)) * pad, np.diff(offs))
    wide = np.zeros(n + pad * (len(offs) + 1), np.uint8)
    real = np.zeros(len(wide), bool)
    wide[at], real[at] = buf, True
    g = GEAR[wide]
    g[~real] = 0
    k = 1
    while k < 16:
        shifted = np.zeros_like(g)
        shifted[k:] = g[:-k] << np.uint16(k)
        g = g + shifted
        k *= 2
    nxt = np.append(wide[1:], 0)
    # a cut after byte i: not inside a character
    value = np.where(real & ((nxt & 0xC0) != 0x80), g.astype(np.uint32) + 1, 0)
    ahead = _most(value, reach + 1)
    before = np.zeros_like(value)
    before[reach:] = _most(value, reach)[:-reach]
    cut = (value > 0) & (value == ahead) & (value > before)
    ends = np.flatnonzero(cut[at]) + 1
    ends = np.unique(np.concatenate([ends, offs[1:][np.diff(offs) > 0]]))
    starts = np.append(0, ends[:-1])
    long = np.flatnonzero(ends - starts > longest)
    if len(long):
        more = []
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            for c in range(s + longest, e, longest):
                while c < e and buf[c] & 0xC0 == 0x80:
                    c += 1
                more.append(c)
        ends = np.unique(np.concatenate([ends, np.array(more, np.int64)]))
        starts = np.append(0, ends[:-1])
    return starts, ends, np.searchsorted(starts, offs)


def _keyed(docs: DataFrame, ident: str, h: str) -> DataFrame:
    """Adds the document key: ``ident`` (null: smallest) and ``h`` (hash of the text)."""
    return (docs.withColumn(ident, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
            .withColumn(h, F.xxhash64(F.col("text").cast("string"))))


def _word_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n + 1 running counts of word starts; a text's first byte starts a word whatever stands before the text."""
    ws = SPACE[buf]
    word = ~ws
    word[1:] &= ws[:-1]
    at = offs[:-1][np.diff(offs) > 0]
    word[at] = ~ws[at]
    return np.append(0, np.cumsum(word))


def _check(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``CHECK_BITS`` bits of byte ranges, independent of ``hash_runs``."""
    pw, ipw = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_SECOND[buf] * pw[:len(buf)], out=total[1:])
    return (mix((total[ends] - total[starts]) * ipw[starts]) >> np.uint64(64 - CHECK_BITS)).astype(np.int64)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(digest, id, h, place) of every chunk; place packs start (32 bits), length (12), words (10) and check bits (10)."""
    small_batches(docs.sparkSession)

    def each(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            hs = batch.column("h").to_numpy(zero_copy_only=False)
            for lo, buf, offs in slices(batch.column("text")):
                s, e, first = chunks(buf, offs)
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                n_words = _word_counts(buf, offs)
                # at most LONGEST + 3 bytes and half as many words
                place = ((s - offs[doc]) << 32) | ((e - s) << 20) | ((n_words[e] - n_words[s]) << CHECK_BITS) | _check(buf, s, e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hash_runs(buf, s, e).view(np.int64)), pa.array(ids[lo + doc]), pa.array(hs[lo + doc]), pa.array(place)],
                    names=["digest", "id", "h", "place"])

    return _keyed(docs.select("doc_id", "text"), "id", "h").select("id", "h", F.col("text").cast("string").alias("text")) \
        .where("text IS NOT NULL AND text <> ''").mapInArrow(each, "digest long, id long, h long, place long")


def _passages(parts: list, min_words: int):
    """Runs of adjoining chunks [(place, first id)] sorted by place: (start, length, words, first id)."""
    out, run = [], None

    def enough():
        return run and (run[2] >= min_words or run[1] >= MIN_BYTES)

    for place, src in parts:
        start, length, n = place >> 32, (place >> 20) & 0xFFF, (place >> CHECK_BITS) & 0x3FF
        if run and run[0] + run[1] == start:
            run = (run[0], run[1] + length, run[2] + n, run[3])
        else:
            if enough():
                out.append(run)
            run = (start, length, n, src)
    if enough():
        out.append(run)
    return out


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, spans): repeated passages of each document that has any; spans of (start, length, words, first_id) in UTF-8 bytes."""
    rows = chunk_rows(docs)
    key = F.struct("id", "h", "place")
    first = (rows.groupBy("digest").agg(F.min(key).alias("a"), F.max(key).alias("z"))
             .where("a <> z").select("digest", "a"))
    # the low half of place holds length, words and check bits: where they differ, equal digests are a coincidence
    again = (rows.join(first, "digest").where("id <> a.id OR h <> a.h OR place <> a.place")
             .where(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("a.place").bitwiseAND(F.lit(0xFFFFFFFF))))
    per_doc = again.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("place", F.col("a.id").alias("src")))).alias("parts"))
    kind = "array<struct<start:bigint,length:bigint,words:bigint,first_id:bigint>>"

    def each(batches):
        for batch in batches:
            lists = batch.column("parts")
            flat, offs = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            place, src = flat.field("place").to_numpy(zero_copy_only=False).tolist(), flat.field("src").to_numpy(zero_copy_only=False).tolist()
            spans = [[dict(zip(("start", "length", "words", "first_id"), r))
                      for r in _passages(list(zip(place[a:b], src[a:b])), min_words)] for a, b in zip(offs[:-1], offs[1:])]
            kind_ = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "words", "first_id")]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(spans, kind_)], names=["id", "h", "spans"])

    return per_doc.mapInArrow(each, f"id long, h long, spans {kind}").where(F.size("spans") > 0)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every column and row; ``text`` without its repeated passages (and ``n_chars``, if there, recounted)."""
    ident, h, start, length = unused(docs.columns, "id", "h", "start", "length")
    spans = repeats(docs, min_words).select(F.col("id").alias(ident), F.col("h").alias(h),
                                            F.col("spans.start").alias(start), F.col("spans.length").alias(length))
    joined = _keyed(docs, ident, h).join(spans, [ident, h], "left")
    schema = docs.schema
    at = docs.columns.index("text")

    def each(batches):
        for batch in batches:
            hit = np.flatnonzero(batch.column(start).is_valid().to_numpy(zero_copy_only=False))
            out = batch.select(docs_columns)
            if len(hit):
                texts = out.column(at).to_pylist()
                starts, lengths = batch.column(start), batch.column(length)
                for i in hit.tolist():
                    raw, kept, end = texts[i].encode(), [], 0
                    for s, n in zip(starts[i].as_py(), lengths[i].as_py()):
                        kept.append(raw[end:s])
                        end = s + n
                    texts[i] = b"".join([*kept, raw[end:]]).decode()
                out = out.set_column(at, "text", pa.array(texts, out.schema.field(at).type))
            yield out

    docs_columns = docs.columns
    cut = joined.select(*docs_columns, start, length).mapInArrow(each, schema)
    if "n_chars" in docs_columns:
        kind = schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)).select(*docs_columns)
    return cut


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a repeated passage: the document, the passage's place in its UTF-8 bytes and the first document."""
    r = repeats(table(spark, sf_dir, "documents"))
    low = F.lit(-(1 << 63)).cast("long")
    s = r.select(F.nullif("id", low).alias("doc_id"), F.explode("spans").alias("s"))
    return s.select("doc_id", "s.start", "s.length", "s.words", F.nullif("s.first_id", low).alias("first_doc_id"))
