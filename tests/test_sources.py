"""Scans, sinks and text formats: roundtrips, chunking, failure on bad input."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, triples
from gridmf.operators import blocks
from gridmf.operators.domain import domain_sizes
from gridmf.operators.factors import init_factors
from gridmf.sources import celltext, factortext, files
from gridmf.sources.ratings import ratings_view, read_ratings_csv, write_ratings_csv


def scratch():
    return tempfile.mkdtemp(prefix="gridmf-src-")


def write_lines(lines):
    d = scratch()
    with open(os.path.join(d, "part.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return d


def test_csv_roundtrip(spark):
    r = ratings_view(spark, SF_SMALL)
    path = os.path.join(scratch(), "r")
    write_ratings_csv(r, path)
    back = read_ratings_csv(spark, path)
    assert sorted(triples(back)) == sorted(triples(r))
    assert back.schema.simpleString() == "struct<x_id:int,y_id:int,rating:double>"


def test_csv_extra_fields_ignored_unless_strict(spark):
    d = write_lines(["1,2,3.5,999", "0,0,1"])
    assert sorted(triples(read_ratings_csv(spark, d))) == [(0, 0, 1.0), (1, 2, 3.5)]
    with pytest.raises(Exception):
        read_ratings_csv(spark, d, strict=True).collect()


@pytest.mark.parametrize("bad", [["x_id,y_id,rating", "1,2,3"], ["1,2"], ["1,a,3.0"]])
def test_csv_bad_lines_raise(spark, bad):
    with pytest.raises(Exception):
        read_ratings_csv(spark, write_lines(bad)).collect()


def _cells(spark, n_blocks=3):
    r = ratings_view(spark, SF_SMALL)
    nx, ny = domain_sizes(r)
    return blocks.with_order(blocks.assign_grid(r, nx, ny, n_blocks), 7), r


def test_cell_lines_row_major_chunked_and_decodable(spark):
    cells, r = _cells(spark)
    one = celltext.cell_lines(spark, cells, 3).orderBy("bx", "by", "part").collect()
    assert [(x.bx, x.by) for x in one] == [(i, j) for i in range(3) for j in range(3)]
    small = celltext.cell_lines(spark, cells, 3, max_triples=37).orderBy("bx", "by", "part").collect()
    # same text per cell once the chunks are concatenated; every chunk bounded
    joined = {}
    for x in small:
        assert x.line.count(";") <= 37
        joined[(x.bx, x.by)] = joined.get((x.bx, x.by), "") + x.line
    assert joined == {(x.bx, x.by): x.line for x in one}
    back = celltext.decode_cell_lines(spark.createDataFrame([(x.line,) for x in small], "line string"))
    assert sorted(triples(back)) == sorted(triples(r))


def test_cell_lines_order_and_duplicates(spark):
    df = spark.createDataFrame([(0, 0, 1.0)] * 5 + [(0, 1, 2.0), (1, 0, 3.0)],
                               "x_id INT, y_id INT, rating DOUBLE")
    cells = blocks.with_order(blocks.assign_grid(df, 2, 2, 1), 7)
    lines = celltext.cell_lines(spark, cells, 1, max_triples=2).orderBy("part").collect()
    assert [x.line.count(";") for x in lines] == [2, 2, 2, 1]
    assert "".join(x.line for x in lines).count("0,0,1.0;") == 5


def test_cell_lines_empty_cells(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (3, 3, 2.0)], "x_id INT, y_id INT, rating DOUBLE")
    cells = blocks.with_order(blocks.assign_grid(df, 4, 4, 2), 7)
    lines = {(x.bx, x.by): x.line for x in celltext.cell_lines(spark, cells, 2).collect()}
    assert lines == {(0, 0): "0,0,1.0;", (0, 1): "", (1, 0): "", (1, 1): "3,3,2.0;"}
    path = os.path.join(scratch(), "cells")
    celltext.write_cell_lines(celltext.cell_lines(spark, cells, 2), path)
    assert sorted(triples(celltext.read_cell_lines(spark, path))) == [(0, 0, 1.0), (3, 3, 2.0)]
    path = os.path.join(os.path.dirname(path), "parts")
    rows = spark.createDataFrame([(i % 4, 3 - i % 4, float(i)) for i in range(40)], "x_id INT, y_id INT, rating DOUBLE")
    cells = blocks.with_order(blocks.assign_grid(rows, 4, 4, 2), 7)
    celltext.write_cell_lines(celltext.cell_lines(spark, cells, 2, max_triples=3), path)
    back = celltext.read_cell_lines(spark, path)
    want = sorted((x.bx, x.by, x.x_id, x.y_id, x.rating) for x in cells.collect())
    assert sorted((x.bx, x.by, x.x_id, x.y_id, x.rating) for x in back.collect()) == want
    assert back.agg({"part": "max"}).first()[0] > 2


def test_factor_lines_lossless_roundtrip(spark):
    f = init_factors(spark, 23, 17, 5, 3, 7, signed=True)
    lines = factortext.factor_lines(f, max_rows=4)
    assert all(x.line.count(";") <= 4 for x in lines.collect())
    path = os.path.join(scratch(), "fl")
    factortext.write_factor_lines(lines, path)
    back = factortext.decode_factor_lines(factortext.read_factor_lines(spark, path), 23, 17, 3, max_rows=4)
    exp = {(r.matrix, r.id): (r.block, list(r.vec)) for r in f.collect()}
    got = {(r.matrix, r.id): (r.block, list(r.vec)) for r in back.collect()}
    assert got == exp   # bit-exact doubles


def test_cell_files_partition_pruning(spark):
    cells, r = _cells(spark)
    path = os.path.join(scratch(), "cells")
    files.write_cells(cells, path)
    assert sorted(triples(files.read_cells(spark, path))) == sorted(triples(r))
    one = files.read_cells(spark, path, bx=1, by=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bx" in plan
    assert {(x.bx, x.by) for x in one.collect()} == {(1, 2)}


def test_model_roundtrip(spark):
    f = init_factors(spark, 10, 12, 3, 2, 7)
    path = os.path.join(scratch(), "model")
    files.write_model(f, path)
    got = {(r.matrix, r.id): list(r.vec) for r in files.read_model(spark, path).collect()}
    assert got == {(r.matrix, r.id): list(r.vec) for r in f.collect()}
    assert F is not None


def test_cell_lines_bucketed_ranks_equal_unbucketed(spark, monkeypatch):
    """The order-preserving buckets used for large cells give the same lines."""
    cells, _ = _cells(spark)
    dup = cells.unionByName(cells.limit(300))     # identical triples across buckets
    plain = {(x.bx, x.by, x.part): x.line
             for x in celltext.cell_lines(spark, dup, 3, max_triples=50).collect()}
    monkeypatch.setattr(celltext, "TRIPLES_PER_BUCKET", 16)
    bucketed = {(x.bx, x.by, x.part): x.line
                for x in celltext.cell_lines(spark, dup, 3, max_triples=50).collect()}
    assert bucketed == plain
    assert max(k[2] for k in plain) > 5


def test_csv_bad_field_raises_without_ansi(spark):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception):
            read_ratings_csv(spark, write_lines(["1,a,3.0"])).collect()
        assert triples(read_ratings_csv(spark, write_lines(["1,2,3.0"]))) == [(1, 2, 3.0)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_strict_csv_checks_the_line_by_every_column(spark):
    path = write_lines(["1,2,3.5", "1,2,3.5,9"])
    for column in ("x_id", "y_id", "rating"):
        with pytest.raises(Exception, match="malformed"):
            read_ratings_csv(spark, path, strict=True).select(column).collect()
        assert read_ratings_csv(spark, path).select(column).count() == 2
    short = write_lines(["1,2,3.5", "1,2"])
    with pytest.raises(Exception, match="malformed"):
        read_ratings_csv(spark, short).select("x_id").collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_cell_files_are_routed_and_read_back(spark, fmt):
    import glob
    import math

    hot = [(0, y % 40, float(y)) for y in range(4000)]
    rows = [(x % 30, (x * 7) % 40, x / 7) for x in range(1000)] + hot
    df = spark.createDataFrame(rows, "x_id INT, y_id INT, rating DOUBLE").repartition(16)
    cells = blocks.assign_grid(df, 30, 40, 3)
    path = os.path.join(scratch(), "cells")
    files.write_cells(cells, path, fmt=fmt, rows_per_file=500)
    for c in blocks.cell_counts(cells).collect():
        written = glob.glob(f"{path}/bx={c.bx}/by={c.by}/part-*")
        assert 1 <= len(written) <= math.ceil(c.n / 500)
    back = files.read_cells(spark, path, fmt=fmt)
    assert dict(back.dtypes) == {"x_id": "int", "y_id": "int", "rating": "double", "bx": "int", "by": "int"}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.select("x_id", "y_id", "rating", "bx", "by").collect()))
    one = files.read_cells(spark, path, bx=1, by=2, fmt=fmt)
    assert "PartitionFilters: [isnotnull(bx" in one._jdf.queryExecution().executedPlan().toString()
    assert {(r.bx, r.by) for r in one.collect()} == {(1, 2)}


def test_malformed_cell_csv_fails(spark):
    path = os.path.join(scratch(), "cells")
    os.makedirs(f"{path}/bx=0/by=0")
    with open(f"{path}/bx=0/by=0/part-0.csv", "w") as f:
        f.write("1,2,3.5\n1,x,2.0\n")
    with pytest.raises(Exception):
        files.read_cells(spark, path, fmt="csv").collect()


@pytest.mark.parametrize("split", [blocks.BALANCED, blocks.CEIL])
def test_factor_lines_of_both_splits_and_parts(spark, split):
    f = init_factors(spark, 40, 23, 3, 7, 5, split=split)
    lines = factortext.factor_lines(f, max_rows=4)
    back = factortext.decode_factor_lines(lines, 40, 23, 7, max_rows=4, split=split)
    want = {(r.matrix, r.id): (r.block, tuple(r.vec)) for r in f.collect()}
    assert {(r.matrix, r.id): (r.block, tuple(r.vec)) for r in back.collect()} == want


def test_factor_lines_skip_blanks_and_padding(spark):
    raw = [("W", 0, 0, " 1.0, ,2.0,; ;3.0,4.0,;;\t;"), ("W", 1, 0, "5.0,6.0,;9.0,9.0,;"), ("H", 0, 0, ""), ("H", 1, 0, "7.5,8.5,; ")]
    lines = spark.createDataFrame(raw, "matrix string, block int, part int, line string")
    got = factortext.decode_factor_lines(lines, 3, 2, 2, split=blocks.CEIL)
    assert sorted((r.matrix, r.id, r.block, list(r.vec)) for r in got.collect()) == [
        ("H", 1, 1, [7.5, 8.5]), ("W", 0, 0, [1.0, 2.0]), ("W", 1, 0, [3.0, 4.0]), ("W", 2, 1, [5.0, 6.0])]


def test_fixed_decimals(spark):
    f = spark.createDataFrame([("W", 0, 0, [0.5, -0.0000004, -1.25, 12345.678901, 0.9999999])], "matrix string, id int, block int, vec array<double>")
    assert factortext.factor_lines(f, digits=6).first().line == "0.500000,0.000000,-1.250000,12345.678901,1.000000,;"
    assert factortext.factor_lines(f, digits=1).first().line == "0.5,0.0,-1.3,12345.7,1.0,;"


def test_lines_joined_by_block_equal_the_join(spark):
    from gridmf.operators.score import evaluate_lines, predict

    rows = [(x % 30, (x * 7) % 23, x / 90) for x in range(900)] + [(29, 22, 1.0)]
    df = spark.createDataFrame(rows, "x_id INT, y_id INT, rating DOUBLE")
    for split in (blocks.BALANCED, blocks.CEIL):
        f = init_factors(spark, 30, 23, 3, 7, 5, split=split)
        cells = blocks.with_order(blocks.assign_grid(df, 30, 23, 7, split), 7)
        got = evaluate_lines(celltext.cell_lines(spark, cells, 7, max_triples=10), factortext.factor_lines(f, max_rows=2), 30, 23, 7, split)
        scored = blocks.assign_grid(predict(df, f), 30, 23, 7, split)
        want = {(r.bx, r.by): (r.s, r.n) for r in scored.groupBy("bx", "by").agg(F.sum("sq_error").alias("s"), F.count("*").alias("n")).collect()}
        got = {(r.bx, r.by): (r.sse, r.n) for r in got.collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], rel=1e-10) for k in want)
    lost = factortext.factor_lines(f.where("NOT (matrix = 'H' AND id = 22)"))
    with pytest.raises(Exception, match="without a factor row"):
        evaluate_lines(celltext.cell_lines(spark, cells, 7), lost, 30, 23, 7, blocks.CEIL).collect()


def test_block_ratings_hold_empty_blocks(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (4, 1, 1.0)], "x_id INT, y_id INT, rating DOUBLE")
    got = blocks.block_ratings(blocks.assign_grid(df, 5, 2, 3), 5, 2, 3).collect()
    assert sorted(map(tuple, got)) == [("x", 0, 0, 2, 2), ("x", 1, 2, 2, 0), ("x", 2, 4, 1, 1), ("y", 0, 0, 1, 1), ("y", 1, 1, 1, 2), ("y", 2, 2, 0, 0)]
