"""Periodic runs of words: maximal repetitions, found by longest-common-extension queries on a harmonic grid.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), at least
``max(MIN_LENGTH, 2 * q)`` long, that no neighbouring word extends with that period.

Harmonic grid: a run of period q and length L >= least(q) has L - q neighbouring places i with word i = word i + q, so one
of them is a multiple of ``least(q) - q`` (q itself from q = MIN_LENGTH / 2 on).  For each q up to half the words only
these places are asked, n/1 + n/2 + ... in all, how far word by word equality of i.. and i+q.. goes to the right and to the left.
Stretches with a multiple of their smallest period cover the same words, so of equal stretches the least period is the run.

Longest common extension: a difference cover D modulo ``V`` (every difference of two places is a difference of members of D)
gives for any two places a shift below V that brings both to sampled places, those with place mod V in D.  Only suffixes at
sampled places are sorted (ranks of V-word blocks, then prefix doubling); a query compares at most V words directly, and then
the least neighbour LCP between the two ranks, a range minimum by a sparse table, is the rest.  The left extension asks the
reversed words.  Ranks are built only for the texts in which some query outlasts ``V`` direct comparisons; in all other texts
these already are the extensions.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``, compared by 64-bit hash (``words.hash_runs``).  Slices of about
``SLICE_BYTES`` are worked on as a whole, each text closed by a word of its own; a longer text is a slice of its own, and
its grid is walked in blocks of ``GRID`` places, so memory follows one text, n log n time its length.  No shuffle.

Null or blank texts have no words and no runs.  Repeated rows, equal and null doc_ids stand each for itself; empty tables give no
rows; extra columns are ignored.  In the contract's rearrangement a null doc_id counts as the empty string.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import small_batches, table
from gridmf.llm.words import SPACE, hash_runs, runs as byte_runs, slices

MIN_LENGTH = 12
#: A perfect difference set: each difference modulo 13 is one of two members.
V = 13
COVER = (0, 1, 3, 9)
SLICE_BYTES = 1 << 20
GRID = 1 << 20


def _shifts() -> np.ndarray:
    """shift[(j - i) mod V, i mod V]: the least s with (i + s) mod V and (j + s) mod V both in COVER."""
    out = np.zeros((V, V), np.int64)
    for d in range(V):
        for i in range(V):
            out[d, i] = next(s for s in range(V) if (i + s) % V in COVER and (i + s + d) % V in COVER)
    return out


SHIFT = _shifts()
SAMPLED = np.isin(np.arange(V), COVER)


class Extensions:
    """Longest common extensions to the right of pairs of places of an integer sequence."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        # closing words, all different from each other and from every other word: no extension passes the end
        self.seq = np.concatenate([seq, -1 - np.arange(2 * V, dtype=seq.dtype)])
        self.rank = None

    def _equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.seq[i] == self.seq[j]

    def ask(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i < j elementwise."""
        shift = SHIFT[(j - i) % V, i % V]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for k in range(V):
            live = live[shift[live] > k]
            if not len(live):
                break
            same = self._equal(i[live] + k, j[live] + k)
            live = live[same]
            out[live] += 1
        rest = np.flatnonzero(out == shift)  # all direct comparisons held: at sampled places now
        if len(rest):
            rest = rest[self._equal(i[rest] + shift[rest], j[rest] + shift[rest])]
        if len(rest):
            if self.rank is None:
                self._sort_samples()
            out[rest] += self._sampled(i[rest] + shift[rest], j[rest] + shift[rest])
        return out

    def _sort_samples(self):
        place = np.flatnonzero(SAMPLED[np.arange(self.n) % V])
        block = self.seq[place[:, None] + np.arange(V)]
        order = np.lexsort(block.T[::-1])
        step = np.any(block[order[1:]] != block[order[:-1]], axis=1)
        name = np.empty(len(place), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(step)])
        at = np.full(self.n + V, -1, np.int64)  # place -> sample; past the end: none
        at[place] = np.arange(len(place))
        levels = [name]
        while True:
            ahead = place + (V << (len(levels) - 1))
            nxt = np.where(ahead < self.n, at[np.minimum(ahead, self.n)], -1)
            second = np.where(nxt >= 0, name[nxt], -1)
            order = np.lexsort((second, name))
            a, b = name[order], second[order]
            step = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new = np.empty(len(place), np.int64)
            new[order] = np.concatenate([[0], np.cumsum(step)])
            if int(new.max(initial=0)) + 1 == len(place) or np.array_equal(new, name):
                name = new
                break
            name = new
            levels.append(name)
        self.at, self.rank = at, name
        by_rank = np.empty(len(place), np.int64)
        by_rank[name] = place
        self.table = [self._neighbours(by_rank[:-1], by_rank[1:], levels, at)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, i: np.ndarray, j: np.ndarray, levels: list, at: np.ndarray) -> np.ndarray:
        """LCP of suffixes that are next to each other, from the ranks of the doubling steps."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = at[np.minimum(i, self.n)], at[np.minimum(j, self.n)]
            same = (x >= 0) & (y >= 0)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            hop = np.where(same, V << k, 0)
            i, j, out = i + hop, j + hop, out + hop
        live = np.arange(len(i))
        for _ in range(V):
            live = live[self._equal(i[live], j[live])]
            if not len(live):
                break
            i[live] += 1
            j[live] += 1
            out[live] += 1
        return out

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Extensions of two sampled places: the least LCP between their ranks."""
        a, b = self.rank[self.at[i]], self.rank[self.at[j]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.log2(hi - lo).astype(np.int64)
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            t = self.table[k]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << k)])
        return out


def grid_blocks(counts: np.ndarray, min_length: int, limit: int = GRID):
    """(place, period) arrays of the harmonic grid of texts of ``counts`` words that follow each other, one closing word each.

    Blocks hold about ``limit`` places; a block's periods are a range of one text's, or those of several whole texts.
    """
    first = np.cumsum(counts + 1) - (counts + 1)
    half = np.where(counts >= min_length, counts // 2, 0)
    text = np.repeat(np.arange(len(counts)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    step = np.maximum(min_length, 2 * period) - period
    size = (counts[text] - period + step - 1) // step
    done = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + limit, side="right")))
        s = size[lo:hi]
        of = np.repeat(np.arange(lo, hi), s)
        k = np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s)
        yield first[text[of]] + k * step[of], period[of]
        lo = hi


def _direct(seq: np.ndarray, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
    """How many words from i on equal those from j on, to the right (way 1) or the left (-1), up to V."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k in range(V):
        live = live[seq[i[live] + way * k] == seq[j[live] + way * k]]
        if not len(live):
            break
        out[live] += 1
    return out


def _stretches(seq: np.ndarray, counts: np.ndarray, min_length: int, right_of, left_of):
    """(rows of start, length and period, per block the asked places and extensions) over the grid."""
    for i, q in grid_blocks(counts, min_length):
        keep = np.flatnonzero(seq[i] == seq[i + q])
        i, q = i[keep], q[keep]
        if not len(i):
            continue
        right, left = right_of(i, i + q), left_of(i - 1, i + q - 1)
        keep = np.flatnonzero(left + right >= np.maximum(min_length, 2 * q) - q)
        rows = np.stack([i[keep] - left[keep], left[keep] + right[keep] + q[keep], q[keep]], axis=1)
        yield i, right, left, np.unique(rows, axis=0) if len(rows) else rows


def find_runs(seq: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``seq`` has the words of all texts as integers >= 0, each text followed by one word that occurs nowhere else.
    """
    first = np.cumsum(counts + 1) - (counts + 1)
    # a closing word before the first text and room behind the last: direct comparison passes no end
    padded = np.concatenate([[-1], seq, -2 - np.arange(V)])
    deep = np.zeros(len(counts), bool)
    found = [np.zeros((0, 3), np.int64)]
    for i, right, left, rows in _stretches(seq, counts, min_length, lambda i, j: _direct(padded, i + 1, j + 1, 1),
                                           lambda i, j: _direct(padded, i + 1, j + 1, -1)):
        deep[np.searchsorted(first, i[(right == V) | (left == V)], side="right") - 1] = True
        found.append(rows)
    rows = np.concatenate(found)
    rows = rows[~deep[np.searchsorted(first, rows[:, 0], side="right") - 1]]
    if deep.any():
        # texts in which a comparison came to no end: asked again, by ranks of the samples of these texts alone
        part = seq[np.repeat(deep, counts + 1)]
        n, size = len(part), counts[deep]
        ahead, back = Extensions(part), Extensions(part[::-1].copy())
        more = [r for *_, r in _stretches(part, size, min_length, ahead.ask, lambda i, j: back.ask(n - 1 - j, n - 1 - i))]
        more = np.concatenate(more)
        at = np.cumsum(size + 1) - (size + 1)
        of = np.searchsorted(at, more[:, 0], side="right") - 1
        more[:, 0] += first[deep][of] - at[of]
        rows = np.concatenate([rows, more])
    rows = np.unique(rows, axis=0)  # by start, length, period
    same = np.zeros(len(rows), bool)
    same[1:] = np.all(rows[1:, :2] == rows[:-1, :2], axis=1)
    start, length, period = rows[~same].T
    text = np.searchsorted(first, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - first[text])[order], length[order], period[order]


def text_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, each text's first word), letters as they are."""
    starts, ends, first = byte_runs(~SPACE[buf], offs)
    return hash_runs(buf, starts, ends), starts, ends, first


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rearrangement of a text's n words (None: as they are)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _slice_runs(doc_ids: list, buf: np.ndarray, offs: np.ndarray, rearranged: bool):
    """(counts, runs of all texts, raw words of a text after the runs' repeated words went)."""
    h, starts, ends, first = text_words(buf, offs)
    counts = np.diff(first)
    if rearranged:
        place = np.arange(len(h))
        for t, doc_id in enumerate(doc_ids):
            order = planted_order(doc_id, int(counts[t]))
            if order is not None:
                place[first[t]:first[t + 1]] = first[t] + order
        h, starts, ends = h[place], starts[place], ends[place]
    ids = np.unique(h, return_inverse=True)[1].astype(np.int64)
    close = np.insert(ids, first[1:], len(ids) + np.arange(len(counts)))
    found = find_runs(close, counts)
    text, start, length, period = found
    # a word goes if a run has it after its first period
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, first[text] + start + period, 1)
    np.add.at(edge, first[text] + start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    raw = buf.tobytes()

    def collapsed(t: int) -> bytes:
        at = np.flatnonzero(kept[first[t]:first[t + 1]]) + first[t]
        return b" ".join([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])

    return counts, found, collapsed


SCHEMA = ("doc_id long, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def periodic_runs(docs: DataFrame, rearranged: bool = False) -> DataFrame:
    """(doc_id, n_words, n_runs, runs, collapsed) of every row: the runs by start and period, and the words that no run repeats.

    ``rearranged``: over the contract's test words instead of the text's own.
    """
    small_batches(docs.sparkSession)

    def each(batches):
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, buf, offs in slices(batch.column("text"), SLICE_BYTES):
                ids = doc_ids.slice(lo, len(offs) - 1)
                counts, (text, start, length, period), collapsed = _slice_runs(ids.to_pylist(), buf, offs, rearranged)
                at = np.searchsorted(text, np.arange(len(counts) + 1))
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
                texts = pa.array([collapsed(t) for t in range(len(counts))], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(np.diff(at)), runs, texts],
                                                 names=["doc_id", "n_words", "n_runs", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The contract's rows from ``periodic_runs``."""
    def sha(x):
        return F.sha2(x.cast("binary"), 256)

    # the longest run, of those the one that starts first, of those the least period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.withColumn("top", F.array_min(order))
    length = -F.col("top.l")
    return d.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
                    F.expr("(-top.l * 1000) div top.period").alias("exponent_milli"),
                    sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), rearranged=True))
