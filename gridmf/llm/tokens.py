"""Token ids of whole texts by a public byte-level BPE file of the ``tokenizers`` library.

A byte-level BPE splits at white space before it merges, so a text's ids are those of its
segments: a word with the one space before it, or the rest of a run of white space.  Segments are
cut for a whole slice of texts at once (numpy), and each distinct segment is given to the library's
model once per worker; the cache forgets everything beyond ``MAX_UNITS`` segments, which costs time, never
results.  Texts holding an added token's string or white space outside ASCII go through
``Tokenizer.encode`` whole, as does everything if the file is of another kind.

Null texts are empty: no ids.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from gridmf.llm.words import SPACE, find, hash_runs, slices

MAX_UNITS = 1_000_000
SLICE = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(other)) for b in range(256)]


PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        kind = json.loads(self.tok.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_units = (kind["model"]["type"] == "BPE" and not kind.get("normalizer") and pre.get("type") == "ByteLevel"
                         and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        self.pieces = regex.compile(PIECES).findall
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _unit(self, raw: bytes) -> list[int]:
        if max(raw) >= 0xE0:  # beyond two-byte characters, leave classes of characters to the library
            return self.plain(raw.decode())
        tokenize, letters = self.model.tokenize, self.letters
        return [t.id for p in self.pieces(raw.decode()) for t in tokenize(p.encode().decode("latin-1").translate(letters))]

    def _learn(self, keys: np.ndarray, raws: list[bytes]):
        if len(self.known) + len(keys) > MAX_UNITS:
            self._forget()
        ids = [self._unit(r) for r in raws]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        order = np.argsort(np.concatenate([self.known, keys]), kind="stable")
        self.known = np.concatenate([self.known, keys])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def slice_ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's first id)."""
        n_texts = len(offs) - 1
        if not self.by_units:
            return self._whole(buf, offs, np.ones(n_texts, bool), None, None)
        odd = self._odd(buf, offs)
        if len(buf) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        starts = segments(buf, offs)
        ends = np.append(starts[1:], len(buf))
        h = hash_runs(buf, starts, ends)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(find(self.known, keys) < 0)
        if len(new) and len(self.known) + len(new) > MAX_UNITS:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            raw = buf.tobytes()
            s, e = starts[first[new]], ends[first[new]]
            self._learn(keys[new], [raw[i:j] for i, j in zip(s.tolist(), e.tolist())])
        where = find(self.known, keys)[back]
        size, at = self.size[where], self.at[where]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        doc = total[np.searchsorted(starts, offs)]
        return self._whole(buf, offs, odd, ids, doc) if odd.any() else (ids, doc)

    def _odd(self, buf, offs) -> np.ndarray:
        """Texts with control separators, white space beyond ASCII or an added token's string."""
        n = len(buf)
        bad = (buf >= 0x1C) & (buf <= 0x1F)
        a, b = (buf == 0xC2), np.append(buf[1:], 0)
        bad |= a & ((b == 0x85) | (b == 0xA0))
        three = np.flatnonzero((buf >= 0xE1) & (buf <= 0xE3))
        if len(three):
            c = np.append(buf[2:], [0, 0])
            x, y, z = buf[three], b[three], c[three]
            bad[three] |= (((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
                           | ((x == 0xE2) & (y == 0x81) & (z == 0x9F))
                           | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))))
        out = np.zeros(len(offs) - 1, bool)
        hits = np.flatnonzero(bad) if n else np.zeros(0, np.int64)
        if len(hits):
            out[np.searchsorted(offs, hits, side="right") - 1] = True
        raw = buf.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(offs, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        return out

    def _whole(self, buf, offs, odd, ids, doc):
        raw = buf.tobytes()
        parts = [np.array(self.plain(raw[offs[i]:offs[i + 1]].decode()), np.uint32) if odd[i] else ids[doc[i]:doc[i + 1]]
                 for i in range(len(odd))]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), at

    def column(self, texts: pa.Array):
        """(first row, ids, each text's first id) of slices of a column."""
        for lo, buf, offs in slices(texts, SLICE):
            ids, at = self.slice_ids(buf, offs)
            yield lo, ids, at


def segments(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the segments that tile the texts: [space]word, or what else a run of white space holds."""
    ws = SPACE[buf]
    n = len(buf)
    start = np.zeros(n + 1, bool)
    start[offs] = True  # texts' starts (and the end)
    edge = start.copy()
    before = np.ones(n, bool)
    before[1:] = ws[:-1]
    after = np.ones(n, bool)
    after[:-1] = ws[1:]
    after |= edge[1:]
    cut = start[:n]
    cut |= ws & ~before
    cut |= ws & before & ~after
    prev_space = np.zeros(n, bool)
    prev_space[1:] = buf[:-1] == 32
    cut |= ~ws & before & ~prev_space
    return np.flatnonzero(cut)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end``."""
    n = len(at) - 1
    new_at = at + np.arange(n + 1)
    out = np.full(new_at[-1], end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new_at[1:] - 1] = False
    out[keep] = ids
    return out, new_at
