"""Brute-force sequential replay of training, written from the semantics only.

Used by tests to check the distributed plans: one loop, one sample at a time,
cells visited in schedule order, samples inside a cell by the order key.
"""

from __future__ import annotations

import hashlib

import numpy as np


def uniform(seed, matrix, ident, k) -> float:
    h = hashlib.md5(f"{seed}|{matrix}|{ident}|{k}".encode()).hexdigest()
    return int(h[:12], 16) / 281474976710656.0


def order_key(seed, x, y, r) -> int:
    micro = int(round(r * 1_000_000.0))
    h = hashlib.md5(f"{seed}|{x}|{y}|{micro}".encode()).hexdigest()
    return int(h[:13], 16)


def balanced_block(n, N, i):
    q, c = divmod(n, N)
    cut = (q + 1) * c
    return (i - cut) // max(q, 1) + c if i >= cut else i // (q + 1)


def init(n, K, seed, matrix):
    return np.array([[uniform(seed, matrix, i, k) for k in range(K)] for i in range(n)],
                    dtype=np.float64).reshape(n, K)


def replay(triples, K, N, epochs, step=0.001, decay=0.99, seed=7, schedule="stratified",
           stop_after=None):
    nx = max(t[0] for t in triples) + 1
    ny = max(t[1] for t in triples) + 1
    W, H = init(nx, K, seed, "W"), init(ny, K, seed, "H")
    if schedule == "stratified":
        bx = lambda x: balanced_block(nx, N, x)
        by = lambda y: balanced_block(ny, N, y)
    else:
        dx, dy = max((nx - 1 + N) // N, 1), max((ny - 1 + N) // N, 1)
        bx = lambda x: x // dx
        by = lambda y: y // dy
    cells = {}
    for x, y, r in triples:
        cells.setdefault((bx(x), by(y)), []).append((order_key(seed, x, y, r), x, y, r))
    for v in cells.values():
        v.sort()
    if schedule == "stratified":
        visit = [(i, (i + s) % N) for s in range(N) for i in range(N)]
    else:
        visit = [(i, j) for i in range(N) for j in range(N)]
    log = []
    for e in range(epochs):
        eta = step * decay ** e
        for step_no, cell in enumerate(visit):
            if stop_after is not None and step_no // N >= stop_after:
                break
            for _, x, y, r in cells.get(cell, []):
                diff = r - float(np.dot(W[x], H[y]))
                W[x] += 2 * eta * diff * H[y]
                H[y] += 2 * eta * diff * W[x]
        if stop_after is not None:
            break
        err = sum((r - float(np.dot(W[x], H[y]))) ** 2 for x, y, r in triples)
        log.append((e, eta, err, len(triples), (err / len(triples)) ** 0.5))
    return W, H, log
