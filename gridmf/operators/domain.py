"""Id domain (A1, A2): ``max(id) + 1`` per axis in ONE scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_domain(ratings: DataFrame) -> DataFrame:
    """One-row ``(num_x_ids BIGINT, num_y_ids BIGINT)``; 0 for an empty table."""
    return ratings.agg(
        F.coalesce(F.max("x_id").cast("bigint") + 1, F.lit(0).cast("bigint")).alias("num_x_ids"),
        F.coalesce(F.max("y_id").cast("bigint") + 1, F.lit(0).cast("bigint")).alias("num_y_ids"),
    )


def domain_sizes(ratings: DataFrame) -> tuple[int, int]:
    """The two scalars the block arithmetic needs on the driver."""
    row = id_domain(ratings).first()
    return int(row["num_x_ids"]), int(row["num_y_ids"])


def domain_stats(ratings: DataFrame) -> tuple[int, int, int]:
    """``(num_x_ids, num_y_ids, num_ratings)`` from one scan, which also validates.

    Rows with a NULL field or a negative id would silently fall outside every
    block, so they fail the job instead.
    """
    row = ratings.agg(
        F.coalesce(F.max("x_id").cast("bigint") + 1, F.lit(0).cast("bigint")).alias("nx"),
        F.coalesce(F.max("y_id").cast("bigint") + 1, F.lit(0).cast("bigint")).alias("ny"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x_id").isNull() | F.col("y_id").isNull() | F.col("rating").isNull()
                   | (F.col("x_id") < 0) | (F.col("y_id") < 0)).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} ratings have a NULL field or a negative id; "
                         "ids must be zero-based integers")
    return int(row["nx"]), int(row["ny"]), int(row["n"])
