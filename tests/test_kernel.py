"""Level-vectorized SGD equals the plain sequential loop."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmf.operators.kernel import conflict_levels, sgd_levels


def sequential(W, H, rw, rh, r, eta):
    for a, b, v in zip(rw, rh, r):
        diff = v - float(np.dot(W[a], H[b]))
        W[a] += 2 * eta * diff * H[b]
        H[b] += 2 * eta * diff * W[a]


@settings(max_examples=40, deadline=None)
@given(nw=st.integers(1, 30), nh=st.integers(1, 30), n=st.integers(0, 400),
       k=st.integers(1, 9), seed=st.integers(0, 10_000))
def test_levels_equal_sequential(nw, nh, n, k, seed):
    rng = np.random.default_rng(seed)
    W, H = rng.random((nw, k)), rng.random((nh, k))
    rw, rh = rng.integers(0, nw, n), rng.integers(0, nh, n)
    r = rng.random(n) * 5
    W1, H1, W2, H2 = W.copy(), H.copy(), W.copy(), H.copy()
    sequential(W1, H1, rw, rh, r, 0.01)
    # in two chunks, carrying the level state across
    lw, lh = [0] * nw, [0] * nh
    cut = n // 3
    for sl in (slice(0, cut), slice(cut, n)):
        lv = conflict_levels(rw[sl], rh[sl], lw, lh)
        sgd_levels(W2, H2, rw[sl], rh[sl], r[sl], lv, 0.01)
    assert np.allclose(W1, W2, rtol=0, atol=1e-12)
    assert np.allclose(H1, H2, rtol=0, atol=1e-12)


def test_levels_respect_conflicts():
    rw = np.array([0, 1, 0, 2, 1])
    rh = np.array([0, 1, 1, 0, 2])
    lv = conflict_levels(rw, rh, [0] * 3, [0] * 3)
    assert list(lv) == [1, 1, 2, 2, 2]


def test_hot_pair_chain():
    # one pair repeated: every sample is its own level, result still sequential
    rng = np.random.default_rng(1)
    W, H = rng.random((2, 4)), rng.random((2, 4))
    rw, rh, r = np.zeros(200, int), np.zeros(200, int), np.full(200, 3.0)
    W1, H1, W2, H2 = W.copy(), H.copy(), W.copy(), H.copy()
    sequential(W1, H1, rw, rh, r, 0.01)
    sgd_levels(W2, H2, rw, rh, r, conflict_levels(rw, rh, [0] * 2, [0] * 2), 0.01)
    assert np.allclose(W1, W2, atol=1e-12) and np.allclose(H1, H2, atol=1e-12)


def levels_by_loop(rw, rh, lw, lh):
    out = []
    for a, b in zip(rw, rh):
        lw[a] = lh[b] = max(lw[a], lh[b]) + 1
        out.append(lw[a])
    return out


@settings(max_examples=60, deadline=None)
@given(nw=st.integers(1, 60), nh=st.integers(1, 60), n=st.integers(0, 1500), skew=st.booleans(), seed=st.integers(0, 10_000))
def test_levels_equal_the_recurrence(nw, nh, n, skew, seed):
    """Peeled and relaxed levels are those of a loop, across chunks, for uniform and for hot rows."""
    rng = np.random.default_rng(seed)
    draw = (lambda k: np.minimum(rng.zipf(1.3, n) - 1, k - 1)) if skew else (lambda k: rng.integers(0, k, n))
    rw, rh = draw(nw), draw(nh)
    want = levels_by_loop(rw, rh, [0] * nw, [0] * nh)
    for cuts in ([0, n], [0, n // 4, n // 2, n]):
        lw, lh = np.zeros(nw, np.int64), [0] * nh
        got = [conflict_levels(rw[s:e], rh[s:e], lw, lh) for s, e in zip(cuts[:-1], cuts[1:])]
        assert np.concatenate(got).tolist() == want


def test_levels_of_a_zigzag():
    """A path that changes the row of W and of H at every sample: one level each."""
    i = np.arange(3000)
    assert conflict_levels((i + 1) // 2, i // 2, np.zeros(1501, np.int64), np.zeros(1501, np.int64)).tolist() == (i + 1).tolist()


def test_pieces_of_levels_give_the_same_bits():
    """However the samples, sorted by level, are cut into calls: 1 by 1, 500, 10,000 or at once."""
    from gridmf.operators.kernel import apply_levels

    rng = np.random.default_rng(3)
    for k in (1, 3, 8, 33, 64, 129):
        n = 4000
        rw, rh = np.minimum(rng.zipf(1.3, n) - 1, 299), rng.integers(0, 200, n)
        r, W, H = rng.random(n), rng.random((300, k)), rng.random((200, k))
        lv = conflict_levels(rw, rh, [0] * 300, [0] * 200)
        order = np.argsort(lv, kind="stable")
        out = []
        for size in (1, 7, 500, 10_000):
            W1, H1 = W.copy(), H.copy()
            for s in range(0, n, size):
                o = order[s:s + size]
                apply_levels(W1, H1, rw[o], rh[o], r[o], lv[o], 0.01)
            out.append((W1, H1))
        assert all(np.array_equal(out[0][0], w) and np.array_equal(out[0][1], h) for w, h in out[1:])


def test_lines_are_decoded_one_at_a_time():
    """What the line kernel takes beyond its batch follows a line, not the batch."""
    import pyarrow as pa

    from gridmf.operators import kernel

    factors = "".join(f"{i / 7},{i / 9},;" for i in range(2000))
    ratings = "".join(f"{i % 2000},{i * 7 % 2000},{i % 5}.5;" for i in range(4000))
    kinds = [kernel.KIND_W, kernel.KIND_H] + [kernel.KIND_RATING] * 60
    lines = pa.array([factors, factors] + [ratings] * 60)
    zeros = pa.array(np.zeros(len(kinds), np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), zeros, zeros, zeros, zeros, zeros, lines],
                                       names=["kind", "part", "bx", "by", "x0", "y0", "line"])
    run, seen, split = kernel.make_line_kernel(), [], kernel._filled

    def watched(texts, mark):
        out = split(texts, mark)
        seen.append(len(out))
        return out

    kernel._filled = watched
    try:
        out = list(run(iter([batch])))
    finally:
        kernel._filled = split
    assert max(seen) <= 4000 and out[0].column("n")[0].as_py() == 60 * 4000
