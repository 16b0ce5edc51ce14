"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Texts are compared as UTF-8 bytes after lower-casing A-Z and Latin-1 letters and folding each run of white space to one
space.  An item of L bytes is looked for in windows of L bytes of every whole document, and every window that may hold it
is looked at.  With k allowed edits the item is cut into k // 2 + 1 *groups*, so in any match some group has at
most one edit; then one half of the group is whole, and of its other half the quarter beside it, or the quarter
beyond, moved by at most one byte.  These eight *seeds* a group, of 3/4 of its bytes, are looked up at every byte of
every document; each hit places a window.  Groups stand in *runs* of up to ``RUN`` bytes, runs in pairs of groups: in some run of r groups a match has at most 2 r - 1
edits, in some pair of it at most 3 and in some group of that at most one; windows with more go (edit distance, 64 bits at once).
Nothing else takes windows away before the LSH.  (An edit rate above 1/4 leaves groups of under 4 bytes: their halves are the seeds.)
Windows and
items are CGK-embedded: a random walk reads the string with 3 L steps, copying the current byte and
moving on by a random bit that depends on step and byte, which turns edits into Hamming distance.
``WALKS`` walks with ``SAMPLES`` samples of ``BITS`` positions each are the LSH: a window is a candidate if it
agrees with the item in all positions of some sample.  Positions where the walk already ran off both strings
are not sampled, so exact copies always collide.  Two walks drift apart with the number of edits they have passed, so an
item of ``2 * PIECE`` bytes or more is embedded in pieces of ``PIECE`` to ``2 * PIECE`` bytes, each against the piece's place in the window
that the seed gives; one piece that agrees makes the window a candidate, so recall does not fall with length.
The target is a recall of ``TARGET`` over items of any length edited by up to ``max_edit_rate``; tests/llm/test_recall.py
measures it from 5 to 1000 words.  An item of under ``SHORT`` bytes counts only where no letter or digit goes on beside it.
Candidates are verified exactly: the least edit distance of the whole item to any
stretch of the window widened by the allowed edits must be at most ``max_edit_rate`` * L.

The benchmark is read in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes (a longer item alone); a
block is what is broadcast.  Documents are scanned once a block, without a shuffle.

Null or blank items match nothing; null documents hold nothing; equal items and repeated documents are
reported each; empty tables give no rows; other columns are ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import table
from gridmf.llm.words import LOWER, SPACE, Table, find, mix, seeds, slices

RUN = 64
QUARTER = 4
SHORT = 5
PIECE = 64
WALKS = 2
SAMPLES = 40
BITS = 3
TARGET = 0.95
MAX_EDIT_RATE = 0.15
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 2 << 20
PAIRS = 1 << 16
STRETCH = 1 << 16
SLICE = 4 << 20
SCHEMA = "doc_id long, item_id long, edits int, item_bytes int, start long, stop long"


def normal(buf: np.ndarray, offs: np.ndarray):
    """Normalised bytes, their offsets and each byte's place in the slice."""
    low = LOWER[buf]
    ws = SPACE[buf]
    low = np.where(ws, np.uint8(32), low)
    latin = np.flatnonzero(buf[:-1] == 0xC3) + 1  # capitals of Latin-1
    latin = latin[(buf[latin] >= 0x80) & (buf[latin] <= 0x9E) & (buf[latin] != 0x97)]
    low[latin] += 0x20
    before = np.ones(len(buf), bool)
    if len(buf):
        before[1:] = ws[:-1]
        before[offs[:-1][np.diff(offs) > 0]] = True
    keep = ~(ws & before)
    at = np.append(0, np.cumsum(keep))
    return low[keep], at[offs], np.flatnonzero(keep)


WHOLE, REST = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
NUMBER = 0xBF58476D1CE4E5B9


def seeds_of(kind: tuple[bool, int]) -> list[tuple[int, int, int, int, int]]:
    """A kind's seeds: (bytes of the first part, of the second, where that stands in the item, in the text, its shift).

    A kind is (gapped, c): seeds of groups with quarters of c bytes, or one stretch of c bytes.
    """
    gapped, c = kind
    if not gapped:
        return [(c, 0, 0, 0, 0)]
    return ([(2 * c, c, 2 * c, 2 * c, 0)] + [(2 * c, c, 3 * c, 3 * c + d, 0) for d in (-1, 0, 1)]
            + [(c, 2 * c, 2 * c, 2 * c + d, d) for d in (-1, 0, 1)])


def text_keys(text: np.ndarray, kind: tuple[bool, int], lo: int, hi: int):
    """Each seed's 64-bit keys at the bytes ``lo`` to ``hi`` of a text; zeros beyond its end."""
    n = hi - lo
    raw = text[lo:hi + 32].tobytes() + bytes(32)
    eight = np.ndarray(n + 24, "<u8", raw, strides=(1,))
    longest = max(max(s[:2]) for s in seeds_of(kind))
    parts = {}
    for number, (first, second, _, far, _) in enumerate(seeds_of(kind)):
        for size in {first, second} - {0, *parts}:
            parts[size] = (eight & np.uint64((1 << 8 * size) - 1)) * np.uint64(WHOLE if size == longest else REST)
        key = parts[first][:n] + np.uint64(number * NUMBER % 2**64)
        if second:
            key += parts[second][far:far + n]
        yield key


def item_seeds(text: bytes, kind: tuple[bool, int], at: int, whole: bool):
    """(key, item's byte at the place of a hit) of a group's seeds from ``at`` on; ``whole``: a group without edits."""
    gapped, c = kind
    longest = max(max(s[:2]) for s in seeds_of(kind))

    def part(lo, size):
        return int.from_bytes(text[lo:lo + size], "little") * (WHOLE if size == longest else REST)

    for number, (first, second, near, _, shift) in enumerate(seeds_of(kind)):
        # the stretch without a gap may lie at either end of the group
        for a in [at] if number or whole else [at, at + c]:
            yield (part(a, first) + (part(a + near, second) if second else 0) + number * NUMBER) % 2**64, a - shift


def normal_items(items: list[tuple[int, str]]) -> list[tuple[int, bytes]]:
    out = []
    for item_id, text in items:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        raw = normal(buf, np.array([0, len(buf)]))[0].tobytes().strip(b" ")
        if raw:
            out.append((item_id, raw))
    return out


class Seeds(Table):
    """A table with a second bit filter."""

    def __init__(self, keys: np.ndarray):
        super().__init__(keys)
        self.low = np.uint64(len(self.seen) - 1)
        self.also = np.zeros(len(self.seen), bool)
        self.also[self._second(self.keys)] = True

    def _second(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(20)) & self.low).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.seen[(keys >> self.shift).astype(np.int64)])
        near = near[self.also[self._second(keys[near])]]
        at = find(self.keys, keys[near])
        return near[at >= 0], at[at >= 0]


class Block:
    """Some items, their runs, seeds and LSH keys."""

    def __init__(self, items: list[tuple[int, str]],
                 max_edit_rate: float = MAX_EDIT_RATE, seed: int = 5):
        self.rate = max_edit_rate
        known = normal_items(items)
        self.ids, self.texts = [i for i, _ in known], [t for _, t in known]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.walk_seed = seeds(WALKS, seed)
        self.flips = [self._flips(w) for w in range(WALKS)]
        rng = np.random.default_rng(seed)
        self.draws = rng.random((WALKS, SAMPLES, BITS))
        self.mult = seeds(BITS, seed + 1) | np.uint64(1)
        flat = np.frombuffer(b"".join(self.texts), np.uint8) if self.texts else np.zeros(0, np.uint8)
        first = np.cumsum(self.size) - self.size
        # piece j of an item of k pieces covers its bytes j * size // k to (j + 1) * size // k
        self.pieces = np.maximum(self.size // PIECE, 1)
        self.piece_from = np.append(0, np.cumsum(self.pieces))
        of = np.repeat(np.arange(len(self.size)), self.pieces)
        j = np.arange(len(of)) - self.piece_from[of]
        self.piece_low = j * self.size[of] // self.pieces[of]
        self.piece_size = (j + 1) * self.size[of] // self.pieces[of] - self.piece_low
        self.keys = self.lsh(flat, first[of] + self.piece_low, self.piece_size) if len(of) else np.zeros((0, WALKS * SAMPLES), np.uint32)
        self.symbol = np.zeros(256, np.int64)  # 0: in no item
        used = np.unique(flat)
        self.n_symbols = len(used) + 1
        self.symbol[used] = np.arange(1, len(used) + 1)
        self._plant()

    def _plant(self):
        """The items' runs, as bit masks of the places of each symbol, and their seeds: tables by kind."""
        found: dict[tuple[bool, int], list] = {}
        self.runs: list[list] = []
        for i, t in enumerate(self.texts):
            size, k = len(t), int(self.rate * len(t))
            groups = k // 2 + 1
            starts = [j * size // groups for j in range(groups + 1)]
            width = min(b - a for a, b in zip(starts, starts[1:]))
            if k == 0:
                kind = (False, min(size, 8))
            else:
                kind = (True, min(width // 4, QUARTER)) if width >= 4 else (False, max(1, width // 2))
            widest = max(b - a for a, b in zip(starts, starts[1:]))
            n_runs = -(-groups // max(1, RUN // widest))
            for x in range(n_runs):
                first, last = x * groups // n_runs, (x + 1) * groups // n_runs
                run = self._add_run(t, starts[first], starts[last], min(k, 2 * (last - first) - 1), -1)
                for low in range(first, last, 2):
                    high = min(low + 2, last)
                    part = self._add_run(t, starts[low], starts[high], min(k, 2 * (high - low) - 1), run)
                    for s in starts[low:high]:
                        for key, off in item_seeds(t, kind, s, k == 0):
                            found.setdefault(kind, []).append((key, i, off, part))
        masks = [r.pop() for r in self.runs]
        self.run_low, self.run_size, self.run_allowed, self.run_of = np.array(self.runs, np.int64).reshape(-1, 4).T.copy()
        self.run_masks = np.stack(masks).ravel() if masks else np.zeros(0, np.uint64)
        del self.runs
        self.tables = {}
        for kind, rows in found.items():
            key = np.array([r[0] for r in rows], np.uint64)
            item, off, run = (np.array([r[j] for r in rows], np.int32) for j in (1, 2, 3))
            order = np.lexsort((off, item, key))
            known = Seeds(np.unique(key))
            self.tables[kind] = (known, np.append(np.searchsorted(key[order], known.keys), len(key)), item[order], off[order], run[order])

    def _add_run(self, text: bytes, low: int, high: int, allowed: int, of: int) -> int:
        """Its number; only its first ``RUN`` bytes count."""
        high = min(high, low + RUN)
        mask = np.zeros(self.n_symbols, np.uint64)
        for bit, c in enumerate(text[low:high]):
            mask[self.symbol[c]] |= np.uint64(1 << bit)
        self.runs.append([low, high - low, allowed, of, mask])
        return len(self.runs) - 1

    def _flips(self, w: int) -> np.ndarray:
        """The walk's random bit for (step modulo 1024, byte)."""
        x = mix(np.arange(1024 * 256, dtype=np.uint64) + self.walk_seed[w])
        return ((x >> np.uint64(17)) & np.uint64(1)).astype(np.int32).reshape(1024, 256)

    def lsh(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """LSH keys of windows ``text[first : first + size]`` (beyond the text: zero bytes), windows x samples."""
        out = np.zeros((len(first), WALKS * SAMPLES), np.uint32)
        order = np.argsort(size, kind="stable")
        first, size = first[order].astype(np.int32), size[order].astype(np.int32)
        padded = np.append(text, np.zeros(int(size[-1]) + 1 if len(size) else 1, np.uint8))
        # sample positions: the walk reads a byte in about two steps; the first 3/2 L of the 3 L steps still read text
        for w in range(WALKS):
            want = np.floor(self.draws[w][None] * (size[:, None, None] * 3 // 2)).astype(np.int64)
            steps = want.max(initial=0) + 1
            flat = want.reshape(len(size), -1)
            by_step = np.argsort(flat, axis=None, kind="stable")
            rows_of, ends = by_step // flat.shape[1], np.searchsorted(np.sort(flat, axis=None), np.arange(steps + 1))
            got = np.zeros(flat.size, np.uint8)
            at = np.zeros(len(size), np.int32)
            for j in range(steps):
                live = np.searchsorted(size * 3 // 2, j, side="right")  # shorter windows are done
                a = at[live:]
                inside = a < size[live:]
                c = np.where(inside, padded[first[live:] + a], 0)
                here = by_step[ends[j]:ends[j + 1]]
                if len(here):
                    got[here] = c[rows_of[ends[j]:ends[j + 1]] - live]
                at[live:] = a + np.where(inside, self.flips[w][j & 1023][c], 0)
            vals = got.reshape(len(size), SAMPLES, BITS).astype(np.uint64) + np.uint64(1)
            out[order, w * SAMPLES:(w + 1) * SAMPLES] = mix((vals * self.mult).sum(axis=2, dtype=np.uint64)) >> np.uint64(32)
        return out

    def matches(self, buf: np.ndarray, offs: np.ndarray):
        """(text, item, edits, start, stop) in bytes of the slice's texts: each item's best stretch in each text."""
        text, at, place = normal(buf, offs)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # symbol numbers of the text, with room for runs that reach beyond it
        symbols = np.concatenate([np.zeros(RUN, np.int64), self.symbol[text], np.zeros(7 * RUN, np.int64)])
        for kind, (known, from_, items, offsets, runs) in self.tables.items():
            for lo in range(0, len(text), STRETCH):
                hits = [known.find(key) for key in text_keys(text, kind, lo, min(lo + STRETCH, len(text)))]
                pos, which = (np.concatenate(x) for x in zip(*hits))
                n = from_[which + 1] - from_[which]
                cut = np.append(0, np.cumsum(n))
                near, a = set(), 0
                windows = []
                while a < len(pos):  # in groups, so a very common seed takes no memory
                    b = max(a + 1, int(np.searchsorted(cut, cut[a] + PAIRS, side="right")) - 1)
                    m = n[a:b]
                    place_of = np.repeat(np.arange(a, b), m)
                    entry = np.repeat(from_[which[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    windows.append(self._windows(symbols, at, lo + pos[place_of], items[entry], offsets[entry], runs[entry], near))
                    a = b
                if near:  # all windows of a text and item of which one run came near
                    doc, item, origin, piece = (np.concatenate(x) for x in zip(*windows))
                    some = np.array(sorted(near), np.int64)
                    keep = find(some, doc * len(self.texts) + item) >= 0
                    self._verify(text, at, origin[keep], item[keep], doc[keep], piece[keep], best)
        for (doc, item), (edits, a, b) in sorted(best.items()):
            yield doc, item, edits, int(place[a] - offs[doc]), int(place[b - 1] + 1 - offs[doc])

    def _windows(self, symbols, at, pos, item, off, run, near):
        """(doc, item, origin, piece) of the different windows of some hits; ``near`` gets the (doc, item) whose run is within its edits."""
        doc = np.searchsorted(at, pos, side="right") - 1
        item = item.astype(np.int64)
        origin = pos - off
        near.update(self._near(symbols, doc, item, origin, run))
        # the piece that holds the seed's first byte
        inside = np.clip(off, 0, self.size[item] - 1)
        piece = self.piece_from[item] + ((inside + 1) * self.pieces[item] - 1) // self.size[item]
        order = np.lexsort((piece, origin, item, doc))
        doc, item, origin, piece = doc[order], item[order], origin[order], piece[order]
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (origin[1:] != origin[:-1]) | (piece[1:] != piece[:-1])
        return doc[new], item[new], origin[new], piece[new]

    def _near(self, symbols, doc, item, origin, run) -> list[int]:
        """The (doc, item), as one number, of which some run, and the part of it that holds the seed, are within their edits."""
        for _ in range(2):
            order = np.lexsort((origin, run, doc))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(doc[order]) != 0) | (np.diff(run[order]) != 0) | (np.diff(origin[order]) != 0)
            keep = order[new]
            keep = keep[self._run_within(symbols, origin[keep], run[keep])]
            doc, item, origin, run = doc[keep], item[keep], origin[keep], self.run_of[run[keep]]
        return (doc * len(self.texts) + item).tolist()

    def _run_within(self, symbols, origin, run) -> np.ndarray:
        """Whether a run is found within its edits of its place: the bit-parallel distance of ``infix_distance``, all at once."""
        out = np.zeros(len(run), bool)
        one, ones = np.uint64(1), np.uint64(2**64 - 1)
        for lo in range(0, len(run), 4096):
            r = run[lo:lo + 4096]
            size, allowed = self.run_size[r], self.run_allowed[r]
            at = np.clip(origin[lo:lo + 4096] + self.run_low[r] - allowed + RUN, 0, len(symbols) - 6 * RUN)
            row = r * self.n_symbols
            top = (size - 1).astype(np.uint64)
            pv, mv = np.full(len(r), ones), np.zeros(len(r), np.uint64)
            score = size.astype(np.uint64)
            least = score.copy()
            for j in range(int((size + 2 * allowed).max(initial=0))):
                eq = self.run_masks[row + symbols[at + j]]
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | ~(xh | pv)
                mh = pv & xh
                score += (ph >> top) & one
                score -= (mh >> top) & one
                np.minimum(least, score, out=least)
                ph <<= one
                pv = (mh << one) | ~(xv | ph)
                mv = ph & xv
            out[lo:lo + 4096] = least <= allowed.astype(np.uint64)
        return out

    def _verify(self, text, at, origin, item, doc, piece, best):
        """Each window's piece is embedded; where one agrees in some sample, the whole item is looked for exactly.

        ``origin``: where the item would begin, maybe before the document.  Windows of an item that touch are searched as one.
        """
        keys = self.lsh(text, np.maximum(origin + self.piece_low[piece], at[doc]), self.piece_size[piece])
        hit = np.flatnonzero((keys == self.keys[piece]).any(axis=1))
        if not len(hit):
            return
        raw = text.tobytes()
        hit = hit[np.lexsort((origin[hit], item[hit], doc[hit]))]
        start = np.maximum(origin[hit], at[doc[hit]])
        reach = (self.rate * self.size[item[hit]]).astype(np.int64)
        apart = np.ones(len(hit), bool)
        apart[1:] = ((doc[hit[1:]] != doc[hit[:-1]]) | (item[hit[1:]] != item[hit[:-1]])
                     | (np.diff(start) > np.where(reach[1:] > 0, self.size[item[hit[1:]]], 0)))
        first = np.flatnonzero(apart)
        for x, y in zip(first.tolist(), np.append(first[1:], len(hit)).tolist()):
            d, i, p, last, allowed = int(doc[hit[x]]), int(item[hit[x]]), int(start[x]), int(start[y - 1]), int(reach[x])
            if best.get((d, i), (allowed + 1,))[0] == 0:
                continue
            a, b = max(int(at[d]), p - allowed), min(int(at[d + 1]), last + int(self.size[i]) + allowed)
            edits, stop = infix_distance(self.texts[i], raw[a:b])
            if edits == 0 and len(self.texts[i]) < SHORT and goes_on(raw, int(at[d]), p, p + int(self.size[i]), int(at[d + 1])):
                continue
            if edits <= allowed and edits < best.get((d, i), (allowed + 1,))[0]:
                back = infix_distance(self.texts[i][::-1], raw[a:a + stop][::-1])[1]
                best[d, i] = (edits, a + stop - back, a + stop)


def goes_on(raw: bytes, lo: int, start: int, stop: int, hi: int) -> bool:
    """Whether the word at either edge of a stretch goes on outside it."""
    return (start > lo and raw[start - 1:start + 1].isalnum()) or (stop < hi and raw[stop - 1:stop + 1].isalnum())


def infix_distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of the whole pattern to any stretch of text, end of the first such stretch); bit-parallel."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, stop = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, stop = score, j + 1
    return best, stop


def blocks(benchmark: DataFrame):
    """The benchmark's items in blocks of bounded size, one after the other."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("text IS NOT NULL")
    rows, size = [], 0
    for r in b.orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) >= BLOCK_ITEMS or size + len(r.text) > BLOCK_BYTES):
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += len(r.text)
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit_rate: float = MAX_EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, edits, item_bytes, start, stop): each item's best stretch in each document, bytes of its UTF-8."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Block(items, max_edit_rate))  # bounded by BLOCK_ITEMS and BLOCK_BYTES

        def each(batches, shared=shared):
            for batch in batches:
                block, ids = shared.value, batch.column("doc_id")
                for lo, buf, offs in slices(batch.column("text"), SLICE):
                    rows = [(ids[lo + t].as_py(), block.ids[i], e, len(block.texts[i]), a, b)
                            for t, i, e, a, b in block.matches(buf, offs)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (
                            pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                            names=["doc_id", "item_id", "edits", "item_bytes", "start", "stop"])

        out = out.unionByName(d.mapInArrow(each, SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit_rate: float = MAX_EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    spark = docs.sparkSession
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Block(items, max_edit_rate))

        def each(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, buf, offs in slices(batch.column("text").cast(pa.string()), SLICE):
                    for t, *_ in shared.value.matches(buf, offs):
                        keep[lo + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(each, docs.schema)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
