"""Id permutation: bijection, equal to a global ordering, skew reduction."""

import hashlib

from conftest import SF_SMALL, triples
from gridmf.operators import blocks
from gridmf.operators.domain import domain_sizes
from gridmf.operators.relabel import permute_ids, relabel
from gridmf.sources.ratings import ratings_view


def expected(n, axis, seed):
    keys = sorted((hashlib.md5(f"{seed}|{axis}|{i}".encode()).hexdigest(), i) for i in range(n))
    return {i: rank for rank, (_, i) in enumerate(keys)}


def test_permutation_is_global_md5_rank(spark):
    for n, per_bucket in ((1, 4), (300, 1 << 20), (300, 7), (5000, 16)):
        got = {r.old_id: r.new_id for r in permute_ids(spark, n, "x", 7, ids_per_bucket=per_bucket).collect()}
        assert got == expected(n, "x", 7)
        assert sorted(got.values()) == list(range(n))


def test_relabel_keeps_ratings_and_evens_cells(spark):
    r = ratings_view(spark, SF_SMALL)
    nx, ny = domain_sizes(r)
    out = relabel(r, permute_ids(spark, nx, "x", 7), permute_ids(spark, ny, "y", 7), nx, ny)
    assert out.count() == r.count()
    assert sorted(t[2] for t in triples(out)) == sorted(t[2] for t in triples(r))
    px = expected(nx, "x", 7)
    py = expected(ny, "y", 7)
    assert sorted(triples(out)) == sorted((px[x], py[y], v) for x, y, v in triples(r))
    counts = [c.n for c in blocks.cell_counts(blocks.assign_grid(out, nx, ny, 4)).collect()]
    assert sum(counts) == r.count()


def test_shuffle_ids_roundtrip(spark):
    from pyspark.sql import functions as F

    from gridmf import shuffle_ids

    r = ratings_view(spark, SF_SMALL)
    out, px, py = shuffle_ids(r, 11)
    back = (out.join(px.select(F.col("new_id").alias("x_id"), F.col("old_id").alias("ox")), "x_id")
               .join(py.select(F.col("new_id").alias("y_id"), F.col("old_id").alias("oy")), "y_id")
               .select(F.col("ox").alias("x_id"), F.col("oy").alias("y_id"), "rating"))
    assert sorted(triples(back)) == sorted(triples(r))
