"""Restart from manifests, resident W, waves across epochs, evaluation in one job, and results that no setting changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, triples
from gridmf.operators.domain import domain_sizes
from gridmf.operators.factors import init_factors
from gridmf.plans import train
from gridmf.sources.ratings import ratings_view
from replay import replay
from test_train import as_arrays


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def model(res):
    return {(r.matrix, r.id): tuple(r.vec) for r in res.factors.collect()}


@pytest.fixture(scope="module", params=["stratified", "sweep"])
def whole(request, spark, ratings_small):
    res = train.fit(ratings_small, rank=4, num_blocks=3, epochs=3, schedule=request.param)
    return request.param, model(res), [tuple(r) for r in res.log.orderBy("iteration").collect()], len(res.seconds)


def stop_in_step(monkeypatch, at):
    """Steps before ``at`` run; then the fit is killed once."""
    kill = {"left": at}
    run_cells = train.run_cells

    def counted(*args, **kw):
        if kill["left"] == 0:
            kill["left"] = -1
            raise KeyboardInterrupt("killed")
        kill["left"] -= 1
        return run_cells(*args, **kw)

    monkeypatch.setattr(train, "run_cells", counted)


@pytest.mark.parametrize("at", [0, 4, 7])
def test_a_killed_fit_goes_on_to_the_same_bits(spark, ratings_small, whole, tmp_path, monkeypatch, at):
    schedule, want, log, epochs = whole
    kw = dict(rank=4, num_blocks=3, epochs=3, schedule=schedule, checkpoint_every=2, resident=at == 4, resume=str(tmp_path))
    stop_in_step(monkeypatch, at)
    with pytest.raises(KeyboardInterrupt):
        train.fit(ratings_small, **kw)
    number, state = train.last_cut(spark, str(tmp_path))
    assert state["step"] <= at and state["grid"]
    for table in [t.name for t in spark.catalog.listTables() if t.name.startswith("gridmf_")]:
        spark.sql(f"DROP TABLE {table}")   # as in a session of its own
    with pytest.raises(ValueError, match="other parameters"):
        train.fit(ratings_small, **{**kw, "seed": 8})
    laid = []
    monkeypatch.setattr(train, "write_grid", lambda *a, **k: laid.append(a))
    res = train.fit(ratings_small, **kw)
    assert not laid   # the grid written before the kill is used
    assert model(res) == want
    got = [tuple(r) for r in res.log.orderBy("iteration").collect()]
    assert len(res.seconds) == epochs and [r[0] for r in got] == [0, 1, 2]
    assert np.allclose(np.array(got, float), np.array(log, float), rtol=1e-12)
    again = train.fit(ratings_small, **kw)   # nothing left to do
    assert model(again) == want and again.log.count() == 3


def test_a_finished_fit_takes_more_epochs(spark, ratings_small, tmp_path):
    kw = dict(rank=4, num_blocks=3, resume=str(tmp_path))
    train.fit(ratings_small, epochs=1, **kw)
    res = train.fit(ratings_small, epochs=3, **kw)
    assert model(res) == model(train.fit(ratings_small, rank=4, num_blocks=3, epochs=3))
    assert [r.iteration for r in res.log.orderBy("iteration").collect()] == [0, 1, 2]


def test_resident_w_gives_the_same_bits(spark, ratings_small, whole):
    schedule, want, log, _ = whole
    res = train.fit(ratings_small, rank=4, num_blocks=3, epochs=3, schedule=schedule, resident=True)
    assert model(res) == want
    assert np.allclose(np.array([tuple(r) for r in res.log.orderBy("iteration").collect()], float), np.array(log, float), rtol=1e-12)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("gridmf_")]


def test_resident_step_exchanges_h_only(spark):
    r = ratings_view(spark, SF_SMALL)
    nx, ny = domain_sizes(r)
    grid = train.write_grid(r, nx, ny, 4, 7, train.STRATIFIED)
    state = train.write_resident(init_factors(spark, nx, ny, 4, 4, 7), 4, grid.keys, "resident")
    try:
        for step in (train.dsgd_subepoch(grid.cells, state, 2, 4, 0.001, grid.keys),
                     train.sweep_step(grid.cells, state, 5, 4, [0.1, 0.2], grid.keys)):
            p = plan(step)
            assert p.count("Exchange") == 1 and p.count("Bucketed: true") == 2   # cells and W where they lie
            below = p.split("Exchange", 1)[1].split("FileScan", 1)[1].split("FileScan", 1)[0]
            assert "matrix" in below and "= H" in below
        write = train.write_resident(train.dsgd_subepoch(grid.cells, state, 2, 4, 0.001, grid.keys), 4, grid.keys, "next")
        assert write.factors.count() == nx + ny
        p = plan(train.evaluate_steps(grid.cells, state, 4, grid.keys))
        kernel = p.split("FlatMapGroupsInArrow", 1)[1]
        assert kernel.count("Exchange") == 1 and kernel.count("Bucketed: true") == 2
        train._drop_factors(spark, write.path)
    finally:
        train._drop_factors(spark, state.path)
        train.drop_grid(spark, grid)


def test_sweep_takes_n_steps_an_epoch(spark, ratings_small, monkeypatch):
    for n, epochs in ((3, 3), (4, 2), (1, 2)):
        assert train.num_steps("sweep", n, epochs) == n * epochs + n - 1
        assert train.num_steps("stratified", n, epochs) == n * epochs
    ran = []
    run_cells = train.run_cells
    monkeypatch.setattr(train, "run_cells", lambda *a, **k: ran.append(1) or run_cells(*a, **k))
    res = train.fit(ratings_small, rank=4, num_blocks=4, epochs=3, schedule="sweep", evaluate_epochs=False)
    assert len(ran) == 4 * 3 + 3   # 2N - 1 an epoch would be 21
    W, H = as_arrays(res.factors, res.num_x_ids, res.num_y_ids, 4)
    rW, rH, _ = replay(triples(ratings_small), 4, 4, 3, schedule="sweep")
    assert np.allclose(W, rW, atol=1e-12) and np.allclose(H, rH, atol=1e-12)


def test_steps_of_a_sweep_visit_every_cell_once_in_order():
    for n, epochs in ((1, 3), (2, 3), (5, 4)):
        seen = {}
        for t in range(train.num_steps("sweep", n, epochs)):
            busy_h = set()
            for i in range(n):
                j = (t - i) % n
                e = t // n if i <= t % n else t // n - 1
                if 0 <= e < epochs:
                    assert j not in busy_h and (e, i, j) not in seen and t == e * n + i + j
                    busy_h.add(j)
                    seen[e, i, j] = t
        assert len(seen) == epochs * n * n
        for (e, i, j), t in seen.items():
            before = [(e, i, j - 1), (e, i - 1, j)] if i and j else [(e, i, j - 1)] if j else [(e, i - 1, j)] if i else []
            assert all(seen[c] < t for c in before)
            assert e == 0 or (seen[e - 1, i, n - 1] < t and seen[e - 1, n - 1, j] < t)
        ends = [train.epoch_ended("sweep", t, n) for t in range(train.num_steps("sweep", n, epochs))]
        assert {e: t for t, e in enumerate(ends) if e is not None} == {e: seen[e, n - 1, n - 1] for e in range(epochs)}


def test_arrow_batches_do_not_change_a_bit(spark):
    """Stored levels: 500 or 10,000 rows a batch, uniform and Zipf ids."""
    rng = np.random.default_rng(2)
    for name, draw in (("uniform", lambda k, n: rng.integers(0, k, n)), ("zipf", lambda k, n: np.minimum(rng.zipf(1.4, n) - 1, k - 1))):
        rows = [(int(x), int(y), float(v)) for x, y, v in zip(draw(300, 6000), draw(200, 6000), rng.random(6000))]
        df = spark.createDataFrame([*rows, (299, 199, 1.0)], "x_id INT, y_id INT, rating DOUBLE")
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        old, out = spark.conf.get(key), []
        try:
            for size in ("500", "10000"):
                spark.conf.set(key, size)
                out.append(model(train.fit(df, rank=5, num_blocks=2, epochs=2, step=0.01, evaluate_epochs=False)))
        finally:
            spark.conf.set(key, old)
        assert out[0] == out[1], name
        rW, rH, _ = replay([*rows, (299, 199, 1.0)], 5, 2, 2, step=0.01)
        assert all(np.allclose(out[0]["W", i], rW[i], atol=1e-9) for i in range(300))


def test_grid_keeps_levels(spark, ratings_small):
    nx, ny = domain_sizes(ratings_small)
    grid = train.write_grid(ratings_small, nx, ny, 3, 7, train.STRATIFIED)
    try:
        clash = grid.cells.groupBy("bx", "by", "level", "x_id").count().where("count > 1")
        assert clash.count() == 0
        assert grid.cells.groupBy("bx", "by", "level", "y_id").count().where("count > 1").count() == 0
        assert grid.cells.groupBy("bx", "by").agg(F.min("level").alias("m")).where("m <> 1").count() == 0
    finally:
        train.drop_grid(spark, grid)


def test_evaluation_is_one_job_over_empty_cells_too(spark):
    rows = [(0, 9, 1.0), (9, 0, 2.0), (5, 5, 3.0)]
    df = spark.createDataFrame(rows, "x_id INT, y_id INT, rating DOUBLE")
    grid = train.write_grid(df, 10, 10, 4, 7, train.STRATIFIED)
    f = init_factors(spark, 10, 10, 3, 4, 7)
    try:
        sc = spark.sparkContext
        spark.conf.set("spark.sql.adaptive.enabled", "false")   # it would run each exchange as a job
        sc.setJobGroup("evaluation", "evaluation")
        got = train.evaluate_steps(grid.cells, f, 4, grid.keys).first()
        jobs = sc.statusTracker().getJobIdsForGroup("evaluation")
        vec = {(r.matrix, r.id): np.array(r.vec) for r in f.collect()}
        want = sum((v - vec["W", x] @ vec["H", y]) ** 2 for x, y, v in rows)
        assert got.n == 3 and got.sse == pytest.approx(want, rel=1e-12)
        assert len(jobs) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        sc.setLocalProperty("spark.jobGroup.id", None)
        train.drop_grid(spark, grid)
