"""The SGD pass over one grid cell (T1), as a streaming grouped-map function.

Input of one group (one task): the W rows of one x-block, the H rows of one
y-block, then the ratings of the cell they meet, already sorted by Spark in
visiting order (``kind``, then ``ord``: the stored conflict level, or the order key).  Only the two factor blocks are held in
memory; ratings stream through in Arrow batches, so a cell of any size - even a
hot one holding a large share of all rows - never has to fit in memory.  The
function works on Arrow record batches directly: a block's vectors arrive as
one flat buffer (``ListArray.flatten``) and leave as one (``ListArray.from_arrays``),
with no Python object per row.

Semantics (per sample, strictly in visiting order)::

    diff = r - w . h
    w   += 2 * eta * diff * h        # W updated first
    h   += 2 * eta * diff * w_new    # H uses the updated w (Gauss-Seidel)

Vectorization is exact: every sample has a *conflict level*, one more than the
highest level of an earlier sample sharing its x or its y.  Samples of one
level touch pairwise different W and H rows, and each row sees its samples in
visiting order, so updating a whole level at once with numpy gives the
sequential result (up to the summation order inside a dot product).  Levels do
not depend on the factors: the grid layout finds them once (``make_level_kernel``)
and stores them, and training reads the cells in level order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KIND_W, KIND_H, KIND_RATING = 0, 1, 2
MATRIX_NAMES = {KIND_W: "W", KIND_H: "H"}
# Union layout fed to the kernel; factor rows leave y_id/rating/ord NULL,
# rating rows leave block NULL, carry an empty vec and x_id in ``id``.
KERNEL_INPUT_COLUMNS = ["pos", "kind", "id", "y_id", "rating", "ord", "block", "vec"]
CHUNK_ROWS = 65536
OUTPUT_ROWS = 8192


PEEL_WIDTH = 64


def _chains(rows: np.ndarray, top: int):
    """Per sample its next sample of the same row (-1: none) and whether it has an earlier one; and the relaxing step.

    ``top``: no level begins above it.  The step raises levels to more than those of all earlier samples of the row: inside a row, levels less their rank
    never fall, so it is a running maximum over the samples sorted by row.
    """
    n = len(rows)
    order = np.argsort(rows, kind="stable")
    srt = rows[order]
    head = np.ones(n, bool)
    head[1:] = srt[1:] != srt[:-1]
    nxt = np.full(n, -1, np.int64)
    nxt[order[:-1]] = np.where(head[1:], -1, order[1:])
    later = np.zeros(n, bool)
    later[order] = ~head
    start = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    rank = np.arange(n) - start[group]
    # rows are kept apart by offsets larger than any level
    apart = group * (top + 2 * n + 2) - rank

    def relax(level: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum.accumulate(level[order] + apart) - apart
        return out

    return nxt, later, relax


def conflict_levels(rows_w: np.ndarray, rows_h: np.ndarray, last_w, last_h) -> np.ndarray:
    """Level of each sample: one more than the highest level of an earlier sample sharing its row of W or of H.

    ``last_w``/``last_h`` (lists or arrays by row) carry the levels across chunks.  No loop over samples: while
    many samples are free of unfinished predecessors they are peeled off at once, level by level; the rest, long chains
    of a few rows, is relaxed row by row with running maxima until nothing rises.
    """
    rows_w, rows_h = np.asarray(rows_w, np.int64), np.asarray(rows_h, np.int64)
    n = len(rows_w)
    if n == 0:
        return np.zeros(0, np.int64)
    lw, lh = np.asarray(last_w, np.int64), np.asarray(last_h, np.int64)
    level = np.maximum(lw[rows_w], lh[rows_h]) + 1
    next_w, after_w, _ = _chains(rows_w, int(level.max()))
    next_h, after_h, _ = _chains(rows_h, int(level.max()))
    waits = after_w.astype(np.int8) + after_h
    done = np.zeros(n, bool)
    front = np.flatnonzero(waits == 0)
    while len(front) >= PEEL_WIDTH:
        done[front] = True
        freed = []
        for nxt in (next_w, next_h):
            to = nxt[front]
            has = to >= 0
            to, of = to[has], front[has]
            level[to] = np.maximum(level[to], level[of] + 1)
            waits[to] -= 1
            freed.append(to[waits[to] == 0])
        # a sample freed by its H row was not free yet when its W row was looked at
        front = np.concatenate(freed)
    rest = np.flatnonzero(~done)
    if len(rest):
        # levels of what was peeled are in those of its successors already
        x = level[rest]
        relaxers = [_chains(r[rest], int(x.max()))[2] for r in (rows_w, rows_h)]
        while True:
            y = relaxers[1](relaxers[0](x))
            if np.array_equal(x, y):
                break
            x = y
        level[rest] = x
    for last, held, rows in ((last_w, lw, rows_w), (last_h, lh, rows_h)):
        np.maximum.at(held, rows, level)
        if held is not last:
            last[:] = held.tolist()
    return level


def apply_levels(W: np.ndarray, H: np.ndarray, rw: np.ndarray, rh: np.ndarray, r: np.ndarray,
                 levels: np.ndarray, eta: float) -> None:
    """Apply samples sorted by level, a level (or the part of one at hand) at once, in place on W and H.

    Samples of a level touch different rows and each row of ``einsum`` is summed alike however many there
    are, so the result does not depend on where the samples are cut into calls, bit for bit.
    """
    if not len(r):
        return
    two_eta = 2.0 * eta
    bounds = np.flatnonzero(np.diff(levels)) + 1
    for s, e in zip([0, *bounds.tolist()], [*bounds.tolist(), len(r)]):
        if e - s == 1:  # a chain: rows are changed where they are
            a, b = int(rw[s]), int(rh[s])
            w, h = W[a:a + 1], H[b:b + 1]
            g = two_eta * (r[s] - np.einsum("ij,ij->i", w, h))
            w += g * h
            h += g * w
            continue
        a, b = rw[s:e], rh[s:e]
        w, h = W[a], H[b]
        g = (two_eta * (r[s:e] - np.einsum("ij,ij->i", w, h)))[:, None]
        w += g * h
        h += g * w
        W[a] = w
        H[b] = h


def sgd_levels(W: np.ndarray, H: np.ndarray, rw: np.ndarray, rh: np.ndarray, r: np.ndarray,
               levels: np.ndarray, eta: float) -> None:
    """Apply one chunk of samples in visiting order, level by level."""
    order = np.argsort(levels, kind="stable")
    apply_levels(W, H, rw[order], rh[order], r[order], levels[order], eta)


def _column(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _runs_of_kind(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(kind, rows) of the runs of one kind in a batch."""
    kinds = _column(batch, "kind", np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e > s:
            yield int(kinds[s]), batch.slice(s, e - s)


def _runs_of_block(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    bounds = [0, *(np.flatnonzero(np.diff(_column(rows, "block", np.int64))) + 1).tolist(), rows.num_rows]
    for s, e in zip(bounds[:-1], bounds[1:]):
        yield rows.slice(s, e - s)


class _CellState:
    """Factor blocks of one group plus the streaming position in its cell.

    ``eta``: the step size, or a function of the group's position.  ``leveled``: ``ord`` holds stored conflict levels;
    otherwise it is the visiting order and levels are found here, chunk by chunk.
    """

    def __init__(self, eta=0.0, leveled: bool = False):
        self.eta = eta
        self.leveled = leveled
        self.parts = {KIND_W: [], KIND_H: []}
        self.mats = {}
        self.ready = False
        self.last_ord = None
        self.pending = []
        self.pending_rows = 0

    def add_factors(self, kind: int, rows: pa.RecordBatch) -> None:
        if self.ready:
            raise RuntimeError("factor row after ratings: group is not in visiting order")
        if callable(self.eta):
            self.eta = self.eta(int(rows.column("pos")[0].as_py()))
        self.parts[kind].append(rows.select(["id", "block", "vec"]))

    def next_h(self) -> None:
        """Another H block comes for the same W block (evaluation of a row of cells)."""
        self._finalize_factors()
        self.parts = {KIND_H: []}
        self.ready = False

    def _finalize_factors(self) -> None:
        if self.ready:
            return
        for kind, parts in self.parts.items():
            if parts:
                table = pa.Table.from_batches(parts).combine_chunks()
                ids = _column(table, "id", np.int64)
                if len(ids) > 1 and np.any(ids[1:] <= ids[:-1]):
                    raise RuntimeError("factor rows of a block must arrive sorted and unique")
                vec = table.column("vec").chunk(0) if table.column("vec").num_chunks else pa.array([], pa.list_(pa.float64()))
                lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
                k = int(lengths[0]) if len(lengths) else 0
                if np.any(lengths != k):
                    raise RuntimeError("factor vectors of one block differ in length")
                mat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), k)
                blocks = _column(table, "block", np.int64)
            else:
                ids = np.empty(0, dtype=np.int64)
                mat = np.empty((0, 0))
                blocks = np.empty(0, dtype=np.int64)
            self.mats[kind] = (ids, blocks, np.array(mat, copy=True))
        self.parts = None
        self.last_w = np.zeros(len(self.mats[KIND_W][0]), np.int64)
        self.last_h = np.zeros(len(self.mats[KIND_H][0]), np.int64)
        self.ready = True

    @staticmethod
    def _present(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) and ids[-1] - ids[0] == len(ids) - 1:  # a block without gaps
            pos = wanted - ids[0]
            return pos, (pos >= 0) & (pos < len(ids))
        pos = np.searchsorted(ids, wanted)
        if not len(ids):
            return pos, np.zeros(len(wanted), dtype=bool)
        return pos, (pos < len(ids)) & (ids[np.minimum(pos, len(ids) - 1)] == wanted)

    @classmethod
    def _rows_of(cls, ids: np.ndarray, wanted: np.ndarray, what: str) -> np.ndarray:
        pos, ok = cls._present(ids, wanted)
        if not np.all(ok):
            raise RuntimeError(f"rating refers to an id without a factor row ({what})")
        return pos

    def known_rows(self, rows: pa.RecordBatch) -> np.ndarray:
        """Which ratings of a batch have both factor rows."""
        self._finalize_factors()
        return (self._present(self.mats[KIND_W][0], _column(rows, "id", np.int64))[1]
                & self._present(self.mats[KIND_H][0], _column(rows, "y_id", np.int64))[1])

    def rating_rows(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block-local row numbers of x and y, and the ratings, of a batch."""
        self._finalize_factors()
        rw = self._rows_of(self.mats[KIND_W][0], _column(rows, "id", np.int64), "x")
        rh = self._rows_of(self.mats[KIND_H][0], _column(rows, "y_id", np.int64), "y")
        return rw, rh, _column(rows, "rating", np.float64)

    def add_ratings(self, rows: pa.RecordBatch) -> None:
        ords = _column(rows, "ord", np.int64)
        if (self.last_ord is not None and ords[0] < self.last_ord) or np.any(ords[1:] < ords[:-1]):
            raise RuntimeError("ratings of a cell are not in visiting order")
        self.last_ord = int(ords[-1])
        rw, rh, r = self.rating_rows(rows)
        if self.leveled:
            apply_levels(self.mats[KIND_W][2], self.mats[KIND_H][2], rw, rh, r, ords, self.eta)
            return
        self.pending.append((rw, rh, r))
        self.pending_rows += rows.num_rows
        if self.pending_rows >= CHUNK_ROWS:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        rw, rh, r = (np.concatenate(c) for c in zip(*self.pending))
        self.pending, self.pending_rows = [], 0
        W, H = self.mats[KIND_W][2], self.mats[KIND_H][2]
        levels = conflict_levels(rw, rh, self.last_w, self.last_h)
        sgd_levels(W, H, rw, rh, r, levels, self.eta)

    def emit(self) -> Iterator[pa.RecordBatch]:
        self._finalize_factors()
        self.flush()
        for kind, (ids, blocks, mat) in self.mats.items():
            k = mat.shape[1] if mat.ndim == 2 else 0
            name = pa.array([MATRIX_NAMES[kind]])
            for s in range(0, len(ids), OUTPUT_ROWS):
                e = min(s + OUTPUT_ROWS, len(ids))
                offsets = pa.array(np.arange(0, (e - s) * k + 1, k, dtype=np.int32) if k else
                                   np.zeros(e - s + 1, dtype=np.int32))
                values = pa.array(np.ascontiguousarray(mat[s:e]).ravel())
                yield pa.RecordBatch.from_arrays(
                    [name.take(pa.array(np.zeros(e - s, dtype=np.int64))),
                     pa.array(ids[s:e].astype(np.int32)),
                     pa.array(blocks[s:e].astype(np.int32)),
                     pa.ListArray.from_arrays(offsets, values)],
                    names=["matrix", "id", "block", "vec"])


def make_sgd_kernel(eta, leveled: bool = False):
    """Grouped-map (Arrow iterator form) function for one step at rate ``eta`` (a number, or a function of the position)."""

    def sgd_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _CellState(eta, leveled)
        for batch in batches:
            for kind, rows in _runs_of_kind(batch):
                state.add_ratings(rows) if kind == KIND_RATING else state.add_factors(kind, rows)
        yield from state.emit()

    return sgd_cell


def _grown(last: np.ndarray, size: int) -> np.ndarray:
    return last if size <= len(last) else np.concatenate([last, np.zeros(max(size, 2 * len(last)) - len(last), np.int64)])


def make_level_kernel(keep: list[str]):
    """Grouped-map function: the rows of one cell, in visiting order, with their conflict ``level``.

    Input has ``x_local``/``y_local``, the places of the ids in their blocks; the last level of each is all that
    is held, so a cell of any size streams.  ``keep`` names the columns passed on.
    """

    def cell_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_w = last_h = np.zeros(0, np.int64)
        last_ord = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ords = _column(batch, "ord", np.int64)
            if (last_ord is not None and ords[0] < last_ord) or np.any(ords[1:] < ords[:-1]):
                raise RuntimeError("ratings of a cell are not in visiting order")
            last_ord = int(ords[-1])
            rw, rh = _column(batch, "x_local", np.int64), _column(batch, "y_local", np.int64)
            last_w, last_h = _grown(last_w, int(rw.max()) + 1), _grown(last_h, int(rh.max()) + 1)
            levels = conflict_levels(rw, rh, last_w, last_h)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(levels, pa.int64())],
                                             names=[*keep, "level"])

    return cell_levels


def make_error_kernel():
    """Grouped-map function: ``(sse, n)`` under one W block of a cell (or cell part), or of a row of
    cells whose H blocks come one after another, each before its ratings."""

    def cell_error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _CellState()
        sse, n, block = 0.0, 0, None
        for batch in batches:
            for kind, rows in _runs_of_kind(batch):
                if kind == KIND_W:
                    state.add_factors(kind, rows)
                    continue
                if kind == KIND_H:
                    for part in _runs_of_block(rows):
                        of = part.column("block")[0].as_py()
                        if block is not None and of != block:
                            state.next_h()
                        block = of
                        state.add_factors(kind, part)
                    continue
                rw, rh, r = state.rating_rows(rows)
                W, H = state.mats[KIND_W][2], state.mats[KIND_H][2]
                diff = r - np.einsum("ij,ij->i", W[rw], H[rh])
                sse += float(np.dot(diff, diff))
                n += len(diff)
        yield pa.RecordBatch.from_arrays([pa.array([sse], pa.float64()), pa.array([n], pa.int64())],
                                         names=["sse", "n"])

    return cell_error


def make_predict_kernel(missing: str = "error"):
    """Grouped-map function: ``(x_id, y_id, rating, prediction)`` per triple of a cell.

    A triple whose id has no factor row fails the job, or, with
    ``missing="null"``, keeps its row with a NULL prediction.
    """

    def cell_predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _CellState()
        for batch in batches:
            for kind, ratings in _runs_of_kind(batch):
                if kind != KIND_RATING:
                    state.add_factors(kind, ratings)
                    continue
                known = state.known_rows(ratings) if missing == "null" else np.ones(ratings.num_rows, bool)
                rw, rh, _ = state.rating_rows(ratings.filter(pa.array(known)))
                W, H = state.mats[KIND_W][2], state.mats[KIND_H][2]
                pred = np.zeros(ratings.num_rows)
                if len(rw):
                    pred[known] = np.einsum("ij,ij->i", W[rw], H[rh])
                yield pa.RecordBatch.from_arrays(
                    [ratings.column("id").cast(pa.int32()), ratings.column("y_id").cast(pa.int32()),
                     ratings.column("rating").cast(pa.float64()), pa.array(pred, mask=~known)],
                    names=["x_id", "y_id", "rating", "prediction"])

    return cell_predict


def _filled(texts: pa.Array, mark: str) -> pa.Array:
    """The parts of texts between ``mark``s that are not blank, one after another."""
    parts = pc.split_pattern(texts, mark).flatten()
    return parts.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(parts)), 0))


def _line_rows(lines: pa.Array) -> np.ndarray:
    """The matrix of factor lines ``v,v,;v,v,;`` that follow each other."""
    rows = _filled(lines, ";")
    values = _filled(rows, ",").cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def _each_line(lines: pa.Array) -> Iterator[pa.Array]:
    """One line after another, so what decoding takes follows a line, not the batch."""
    for i in range(len(lines)):
        yield lines.slice(i, 1)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts one after another; each is freed as soon as it is copied."""
    parts = [p for p in parts if len(p)]
    if not parts:
        return np.empty((0, 0))
    out, at = np.empty((sum(len(p) for p in parts), parts[0].shape[1])), 0
    parts.reverse()
    while parts:
        part = parts.pop()
        out[at:at + len(part)] = part
        at += len(part)
    return out


def make_line_kernel():
    """Grouped-map function: ``(bx, by, sse, n)`` of one cell from its text lines.

    Input rows ``(kind, part, bx, by, x0, y0, line)`` sorted by kind and part: W lines of block ``bx``, H lines of
    block ``by``, then the cell's lines.  Two factor blocks, a batch of lines as text and one line decoded are held; a rating is two row
    numbers, never a vector.
    """

    def cell_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, mats, cell = {KIND_W: [], KIND_H: []}, None, None
        sse, n = 0.0, 0
        for batch in batches:
            for kind, rows in _runs_of_kind(batch):
                cell = [rows.column(c)[0].as_py() for c in ("bx", "by", "x0", "y0")]
                if kind != KIND_RATING:
                    for line in _each_line(rows.column("line")):
                        parts[kind].append(_line_rows(line))
                    continue
                if mats is None:
                    mats = [_joined(parts.pop(k)) for k in (KIND_W, KIND_H)]
                for line in _each_line(rows.column("line")):
                    fields = pc.split_pattern(_filled(line, ";"), ",")
                    if not len(fields):
                        continue
                    x, y, r = (pc.list_element(fields, i).cast(t).to_numpy(zero_copy_only=False)
                               for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))
                    a, b = x - cell[2], y - cell[3]
                    if min(a.min(), b.min()) < 0 or a.max() >= len(mats[0]) or b.max() >= len(mats[1]):
                        raise RuntimeError("rating refers to an id without a factor row (line)")
                    diff = r - np.einsum("ij,ij->i", mats[0][a], mats[1][b])
                    sse += float(np.dot(diff, diff))
                    n += len(diff)
        yield pa.RecordBatch.from_arrays([pa.array([cell[0]], pa.int32()), pa.array([cell[1]], pa.int32()),
                                          pa.array([sse], pa.float64()), pa.array([n], pa.int64())],
                                         names=["bx", "by", "sse", "n"])

    return cell_lines


def _ship_by_value() -> None:
    """Pickle this module's code with the function that Spark sends to workers.

    The kernel then runs on executors that have numpy and pyarrow but not this
    package installed (or a different working directory).
    """
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
        pass


_ship_by_value()
