"""Training plans vs a brute-force sequential replay; edges and invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, triples
from gridmf.functions import blockmath as bm
from gridmf.operators.factors import init_factors
from gridmf.plans import train
from gridmf.sources.ratings import ratings_view
from replay import replay


def as_arrays(factors, nx, ny, k):
    W, H = np.full((nx, k), np.nan), np.full((ny, k), np.nan)
    for r in factors.collect():
        (W if r.matrix == "W" else H)[r.id] = r.vec
    return W, H


@pytest.mark.parametrize("schedule,every", [("stratified", 8), ("stratified", 1), ("sweep", 2)])
def test_fit_equals_sequential_replay(spark, ratings_small, schedule, every):
    res = train.fit(ratings_small, rank=4, num_blocks=3, epochs=2, schedule=schedule,
                    checkpoint_every=every)
    W, H = as_arrays(res.factors, res.num_x_ids, res.num_y_ids, 4)
    rW, rH, rlog = replay(triples(ratings_small), 4, 3, 2, schedule=schedule)
    assert np.allclose(W, rW, atol=1e-12) and np.allclose(H, rH, atol=1e-12)
    log = res.log.orderBy("iteration").collect()
    assert [r.iteration for r in log] == [0, 1]
    for got, exp in zip(log, rlog):
        assert got.step_size == pytest.approx(exp[1])
        assert got.sse == pytest.approx(exp[2], rel=1e-12)
        assert got.n == exp[3]
        assert got.rmse == pytest.approx(exp[4], rel=1e-12)


def test_fit_sf0001_and_error_falls(spark):
    r = ratings_view(spark, SF_SMALL)
    res = train.fit(r, rank=8, num_blocks=4, epochs=3)
    log = res.log.orderBy("iteration").collect()
    sse = [row.sse for row in log]
    assert sse[0] > sse[1] > sse[2]
    assert [row.step_size for row in log] == pytest.approx([0.001, 0.00099, 0.001 * 0.99 ** 2])
    rW, rH, _ = replay(triples(r), 8, 4, 3)
    W, H = as_arrays(res.factors, res.num_x_ids, res.num_y_ids, 8)
    assert np.allclose(W, rW, atol=1e-11) and np.allclose(H, rH, atol=1e-11)


def test_single_subepoch(spark, ratings_small):
    res = train.fit(ratings_small, rank=4, num_blocks=3, epochs=1, sub_epochs=1)
    W, H = as_arrays(res.factors, res.num_x_ids, res.num_y_ids, 4)
    rW, rH, _ = replay(triples(ratings_small), 4, 3, 1, stop_after=1)
    assert np.allclose(W, rW, atol=1e-12) and np.allclose(H, rH, atol=1e-12)


def test_invariant_to_partitions_and_input_order(spark, ratings_small):
    base = train.fit(ratings_small, rank=4, num_blocks=3, epochs=1)
    W0, H0 = as_arrays(base.factors, base.num_x_ids, base.num_y_ids, 4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    old_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts, aqe in (("1", "true"), ("64", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            shuffled = ratings_small.orderBy(F.rand(3)).repartition(5)
            res = train.fit(shuffled, rank=4, num_blocks=3, epochs=1)
            W, H = as_arrays(res.factors, res.num_x_ids, res.num_y_ids, 4)
            assert np.array_equal(W, W0) and np.array_equal(H, H0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", old_aqe)


def test_empty_x_block_keeps_factors(spark, ratings_small):
    from replay import balanced_block

    nx = ratings_small.agg(F.max("x_id")).first()[0] + 1
    ny = ratings_small.agg(F.max("y_id")).first()[0] + 1
    hole = ratings_small.where(bm.block_id(nx, 3, "x_id") != 1)
    init = init_factors(spark, nx, ny, 4, 3, 7)
    res = train.fit(hole, rank=4, num_blocks=3, epochs=2, init=init)
    W, H = as_arrays(res.factors, nx, ny, 4)
    W0, _ = as_arrays(init, nx, ny, 4)
    in_hole = [i for i in range(nx) if balanced_block(nx, 3, i) == 1]
    assert in_hole and np.array_equal(W[in_hole], W0[in_hole])
    assert not np.isnan(W).any() and not np.isnan(H).any()   # every block survives


@pytest.mark.parametrize("n_blocks", [1, 7])
def test_block_count_edges(spark, n_blocks):
    df = spark.createDataFrame([(0, 1, 3.0), (2, 0, 1.5), (2, 1, 4.0), (1, 1, 2.0), (2, 1, 4.0)],
                               "x_id INT, y_id INT, rating DOUBLE")
    for schedule in ("stratified", "sweep"):
        res = train.fit(df, rank=3, num_blocks=n_blocks, epochs=2, step=0.05, schedule=schedule)
        W, H = as_arrays(res.factors, 3, 2, 3)
        rW, rH, rlog = replay(triples(df), 3, n_blocks, 2, step=0.05, schedule=schedule)
        assert np.allclose(W, rW, atol=1e-12) and np.allclose(H, rH, atol=1e-12)
        assert res.log.orderBy("iteration").collect()[-1].sse == pytest.approx(rlog[-1][2])


def test_one_rating(spark):
    df = spark.createDataFrame([(0, 0, 2.0)], "x_id INT, y_id INT, rating DOUBLE")
    res = train.fit(df, rank=2, num_blocks=1, epochs=1, step=0.1)
    W, H = as_arrays(res.factors, 1, 1, 2)
    rW, rH, _ = replay([(0, 0, 2.0)], 2, 1, 1, step=0.1)
    assert np.allclose(W, rW) and np.allclose(H, rH)


def test_unrated_ids_keep_initial_vectors(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (5, 3, 1.0)], "x_id INT, y_id INT, rating DOUBLE")
    res = train.fit(df, rank=2, num_blocks=2, epochs=1, step=0.1)
    init = init_factors(spark, 6, 4, 2, 2, 7)
    W, H = as_arrays(res.factors, 6, 4, 2)
    W0, H0 = as_arrays(init, 6, 4, 2)
    assert np.array_equal(W[1:5], W0[1:5]) and np.array_equal(H[1:3], H0[1:3])
    assert not np.array_equal(W[0], W0[0])


def test_matching_step_agrees_with_kernel(spark):
    """On a matching, one pass of the kernel = the closed-form column step."""
    import __spark_entry__ as entry
    from gridmf.plans.queries import K, SEED, STEP, _ctx

    closed = {(r.matrix, r.id, r.k): r.value
              for r in entry.queries()["sgd_matching_step"](spark, SF_SMALL).collect()}
    r, nx, ny = _ctx(spark, SF_SMALL)
    chosen = spark.createDataFrame(sorted(_matching(triples(r), SEED)),
                                   "x_id INT, y_id INT, rating DOUBLE")
    init = init_factors(spark, nx, ny, K, 1, SEED)
    res = train.fit(chosen, rank=K, num_blocks=1, epochs=1, step=STEP, init=init,
                    evaluate_epochs=False)
    got = {(row.matrix, row.id): row.vec for row in res.factors.collect()}
    assert len(closed) == 2 * len(_matching(triples(r), SEED)) * K
    for (m, i, k), v in closed.items():
        assert got[(m, i)][k] == pytest.approx(v, abs=1e-6)


def _matching(trips, seed):
    from replay import order_key
    best_x = {}
    for x, y, r in trips:
        key = (order_key(seed, x, y, r), y, r)
        if x not in best_x or key < best_x[x][0]:
            best_x[x] = (key, y, r)
    best_y = {}
    for x, (key, y, r) in best_x.items():
        k2 = (key[0], x, r)
        if y not in best_y or k2 < best_y[y][0]:
            best_y[y] = (k2, x, r)
    return [(x, y, r) for y, (_, x, r) in best_y.items()]


def test_blocked_evaluation_equals_join(spark):
    from gridmf.operators import blocks
    from gridmf.operators.domain import domain_sizes
    from gridmf.operators.score import evaluate, evaluate_grid

    r = ratings_view(spark, SF_SMALL)
    nx, ny = domain_sizes(r)
    for n_blocks, split in ((1, "balanced"), (4, "balanced"), (5, "ceil")):
        f = init_factors(spark, nx, ny, 6, n_blocks, 7, split=split)
        cells = blocks.assign_grid(r, nx, ny, n_blocks, split)
        a = evaluate_grid(cells, f, n_blocks).first()
        b = evaluate(r, f).first()
        assert a.n == b.n == 6000
        assert a.sse == pytest.approx(b.sse, rel=1e-12)
        assert a.rmse == pytest.approx(b.rmse, rel=1e-12)


def test_blocked_evaluation_splits_large_cells(spark):
    from gridmf.operators import blocks
    from gridmf.operators.domain import domain_sizes
    from gridmf.operators.score import evaluate, evaluate_grid

    r = ratings_view(spark, SF_SMALL)
    hot = spark.createDataFrame([(0, 0, 4.5)] * 3000, "x_id INT, y_id INT, rating DOUBLE")
    r = r.unionByName(hot)          # one cell now holds a third of the rows
    nx, ny = domain_sizes(r)
    f = init_factors(spark, nx, ny, 6, 3, 7)
    cells = blocks.assign_grid(r, nx, ny, 3)
    a = evaluate_grid(cells, f, 3, rows_per_group=500).first()
    b = evaluate(r, f).first()
    assert a.n == b.n == 9000
    assert a.sse == pytest.approx(b.sse, rel=1e-12)


def test_invalid_ids_fail(spark):
    df = spark.createDataFrame([(0, 1, 3.0), (-1, 0, 1.0)], "x_id INT, y_id INT, rating DOUBLE")
    with pytest.raises(ValueError):
        train.fit(df, rank=2, num_blocks=2, epochs=1)


def test_hot_cell_streams_in_chunks(spark, monkeypatch):
    """A cell far larger than one Arrow batch / kernel chunk gives the replay result."""
    import gridmf.operators.kernel as kernel

    base = [(x % 7, (x * 3) % 5, 1.0 + (x % 4)) for x in range(60)]
    hot = [(1, 2, 4.5)] * 2500 + [(1, 3, 2.0)] * 1500
    df = spark.createDataFrame(base + hot, "x_id INT, y_id INT, rating DOUBLE")
    monkeypatch.setattr(kernel, "CHUNK_ROWS", 700)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        res = train.fit(df, rank=3, num_blocks=2, epochs=2, step=0.0005)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    W, H = as_arrays(res.factors, 7, 5, 3)
    rW, rH, rlog = replay(base + hot, 3, 2, 2, step=0.0005)
    assert np.allclose(W, rW, atol=1e-10) and np.allclose(H, rH, atol=1e-10)
    assert res.log.orderBy("iteration").collect()[-1].sse == pytest.approx(rlog[-1][2], rel=1e-10)


def test_min_num_blocks():
    # 1e9 + 1e8 ids, rank 64, 3 copies: 1.69 TB of factor bytes over 4 GB tasks
    n = train.min_num_blocks(10**9, 10**8, 64, 4 << 30)
    assert n == 394   # ceil(3 * 8 * 64 * 1.1e9 / 4 GiB) = ceil(393.39)
    assert train.min_num_blocks(10, 10, 2, 1 << 30) == 1


def test_predict_grid_equals_join(spark):
    from gridmf.operators.domain import domain_sizes
    from gridmf.operators.score import predict, predict_grid

    r = ratings_view(spark, SF_SMALL)
    nx, ny = domain_sizes(r)
    f = init_factors(spark, nx, ny, 5, 4, 7)    # stored blocks for N = 4; the grid re-blocks
    a = sorted((x.x_id, x.y_id, x.rating, round(x.prediction, 9))
               for x in predict_grid(r, f, nx, ny, 3, rows_per_group=400).collect())
    b = sorted((x.x_id, x.y_id, x.rating, round(x.prediction, 9)) for x in predict(r, f).collect())
    assert a == b and len(a) == 6000


def test_predict_switches_to_grid_over_the_bound(spark):
    from gridmf.operators.domain import domain_sizes
    from gridmf.operators.score import predict

    r = ratings_view(spark, SF_SMALL)
    nx, ny = domain_sizes(r)
    f = init_factors(spark, nx, ny, 5, 4, 7)
    big = predict(r, f, num_x_ids=nx, num_y_ids=ny, rank=5, broadcast_limit=0, grid_blocks=3)
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "aggregate(" not in plan
    small = predict(r, f, num_x_ids=nx, num_y_ids=ny, rank=5)
    a = sorted((x.x_id, x.y_id, round(x.sq_error, 9)) for x in big.collect())
    b = sorted((x.x_id, x.y_id, round(x.sq_error, 9)) for x in small.collect())
    assert a == b


def test_fit_without_catalog_uses_plain_grid(spark, ratings_small, monkeypatch):
    """Where the catalog refuses the bucketed table, training still matches the replay."""
    monkeypatch.setattr(train, "catalog_takes_buckets", lambda spark: False)
    for schedule in ("stratified", "sweep"):
        res = train.fit(ratings_small, rank=4, num_blocks=3, epochs=2, schedule=schedule)
        W, H = as_arrays(res.factors, res.num_x_ids, res.num_y_ids, 4)
        rW, rH, _ = replay(triples(ratings_small), 4, 3, 2, schedule=schedule)
        assert np.allclose(W, rW, atol=1e-12) and np.allclose(H, rH, atol=1e-12)


def test_failing_grid_write_raises_once(spark, ratings_small, monkeypatch):
    """Only the catalog's refusal changes the plan; a write that fails is raised, not tried again."""
    from pyspark.sql.readwriter import DataFrameWriter

    calls = []

    def fail(self, *args, **kwargs):
        calls.append(args)
        raise RuntimeError("disk full")

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", fail)
    with pytest.raises(RuntimeError, match="disk full"):
        train.fit(ratings_small, rank=4, num_blocks=3, epochs=1)
    assert len(calls) == 1


def test_evaluate_steps_reads_buckets_and_equals_the_join(spark, ratings_small):
    """Per schedule: the log's error is the join's, and no exchange lies above the ratings scan."""
    from gridmf.operators.kernel import make_error_kernel
    from gridmf.operators.score import evaluate

    for schedule in ("stratified", "sweep"):
        res = train.fit(ratings_small, rank=4, num_blocks=3, epochs=2, schedule=schedule)
        want = evaluate(ratings_small, res.factors).first()
        got = res.log.orderBy("iteration").collect()[-1]
        assert got.n == want.n and got.sse == pytest.approx(want.sse, rel=1e-10)
    nx, ny, n = train.domain_stats(ratings_small)
    grid = train.write_grid(ratings_small, nx, ny, 3, 7, "stratified")
    try:
        f = train.materialize(init_factors(spark, nx, ny, 4, 3, 7), "f")
        part = train.stratum_step(grid.cells, f, 1, 3, make_error_kernel(), "sse double, n long", grid.keys)
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    finally:
        train.drop_grid(spark, grid)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_missing_factor_rows_go_by_one_rule(spark, limit):
    """Join form and grid form: NULL ids, unknown ids and lost factor rows fail, or keep their row unscored."""
    from gridmf.operators.score import evaluate, predict

    rows = [(0, 0, 1.0), (1, 1, 2.0), (None, 1, 3.0), (1, 99, 4.0), (2, 2, 5.0)]
    r = spark.createDataFrame(rows, "x_id INT, y_id INT, rating DOUBLE")
    f = init_factors(spark, 4, 4, 3, 2, 7).where("NOT (matrix = 'H' AND id = 2)")
    kw = dict(num_x_ids=4, num_y_ids=4, rank=3, broadcast_limit=limit, grid_blocks=2)
    out = predict(r, f, missing="null", **kw).collect()
    assert sorted((x.rating, x.prediction is None) for x in out) == [
        (1.0, False), (2.0, False), (3.0, True), (4.0, True), (5.0, True)]
    assert evaluate(r, f, missing="null", **kw).first().n == 2
    for bad in rows[2:]:
        one = spark.createDataFrame([rows[0], bad], "x_id INT, y_id INT, rating DOUBLE")
        with pytest.raises(Exception, match="without a factor row"):
            predict(one, f, **kw).collect()
    with pytest.raises(ValueError):
        predict(r, f, missing="drop", **kw)


def test_fit_hot_cell_equals_replay(spark):
    base = [(x % 7, (x * 3) % 5, 1.0 + (x % 4)) for x in range(60)]
    hot = [(1, 2, 4.5)] * 400
    df = spark.createDataFrame(base + hot, "x_id INT, y_id INT, rating DOUBLE")
    res = train.fit(df, rank=3, num_blocks=2, epochs=2, step=0.0005)
    W, H = as_arrays(res.factors, 7, 5, 3)
    rW, rH, _ = replay(base + hot, 3, 2, 2, step=0.0005)
    assert np.allclose(W, rW, atol=1e-10) and np.allclose(H, rH, atol=1e-10)


def test_zero_epochs_returns_initial_model(spark, ratings_small):
    res = train.fit(ratings_small, rank=3, num_blocks=2, epochs=0)
    assert res.log.count() == 0
    init = init_factors(spark, res.num_x_ids, res.num_y_ids, 3, 2, 7)
    got = {(r.matrix, r.id): list(r.vec) for r in res.factors.collect()}
    assert got == {(r.matrix, r.id): list(r.vec) for r in init.collect()}


def test_signed_init_range(spark):
    plain = {(r.matrix, r.id): np.array(r.vec) for r in init_factors(spark, 50, 40, 6, 3, 7).collect()}
    signed = {(r.matrix, r.id): np.array(r.vec)
              for r in init_factors(spark, 50, 40, 6, 3, 7, signed=True).collect()}
    allv = np.concatenate(list(signed.values()))
    assert allv.min() >= -1.0 and allv.max() < 1.0 and allv.min() < -0.5
    assert all(np.allclose(signed[k], 2 * plain[k] - 1) for k in plain)


def test_fit_accepts_bigint_ids_and_float_ratings(spark):
    rows = [(x % 7, (x * 3) % 5, float(1 + (x % 4))) for x in range(80)]
    a = spark.createDataFrame(rows, "x_id INT, y_id INT, rating DOUBLE")
    b = spark.createDataFrame(rows, "x_id BIGINT, y_id BIGINT, rating FLOAT")
    ra = train.fit(a, rank=3, num_blocks=2, epochs=1, step=0.01)
    rb = train.fit(b, rank=3, num_blocks=2, epochs=1, step=0.01)
    Wa, Ha = as_arrays(ra.factors, 7, 5, 3)
    Wb, Hb = as_arrays(rb.factors, 7, 5, 3)
    assert np.array_equal(Wa, Wb) and np.array_equal(Ha, Hb)   # small integers: exact in float


def test_verbose_prints_one_line_per_epoch(spark, ratings_small, capsys):
    train.fit(ratings_small, rank=2, num_blocks=2, epochs=2, verbose=True)
    lines = capsys.readouterr().out.strip().splitlines()
    assert [ln.split()[0] for ln in lines] == ["iteration=0", "iteration=1"]
    assert all("n=105" in ln.split() for ln in lines)


def test_training_cuts_batches_by_rows_alone_and_leaves_the_setting(spark, ratings_small, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, write = spark.conf.get(key), [], train.write_grid
    monkeypatch.setattr(train, "write_grid", lambda *a, **k: seen.append(spark.conf.get(key)) or write(*a, **k))
    train.fit(ratings_small, rank=2, num_blocks=2, epochs=1)
    assert seen == [str(2**31 - 1)] and spark.conf.get(key) == before


def test_cells_are_stored_in_the_order_of_a_step(spark, ratings_small):
    import glob

    import pyarrow.parquet as pq

    nx, ny, _ = train.domain_stats(ratings_small)
    grid = train.write_grid(ratings_small, nx, ny, 2, 7, "stratified")
    try:
        files = glob.glob(grid.path.removeprefix("file:") + "/step=*/*.parquet")
        parts = [pq.ParquetFile(f).read(columns=["level", "x_id", "y_id", "rating"]).to_pylist() for f in files]
        parts = [[tuple(r.values()) for r in p] for p in parts]
        assert sum(map(len, parts)) == ratings_small.count() and all(p == sorted(p) for p in parts)
        assert any(p[0][0] < p[-1][0] for p in parts)
    finally:
        train.drop_grid(spark, grid)


def test_a_prediction_task_is_bounded_at_any_size():
    from gridmf.operators import score

    for scale in (1, 6, 36, 360):
        nx, ny, n = 900_000 * scale, 1_200_000 * scale, 36_000_000 * scale
        blocks_ = -(-(score.factor_side_bytes(nx, 8) + score.factor_side_bytes(ny, 8)) // score.GRID_TASK_BYTES)
        rows = min(score.group_rows(nx, ny, blocks_), n // blocks_**2)
        factor_rows = (nx + ny) // blocks_
        assert factor_rows * 112 <= score.GRID_TASK_BYTES and rows <= 1 << 23
