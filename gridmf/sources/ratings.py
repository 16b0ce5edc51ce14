"""Ratings sources (S1, S2, S9) and the fixture view over the driver's tables.

A rating table is ``(x_id INT, y_id INT, rating DOUBLE)`` with zero-based ids.
Duplicated ``(x_id, y_id)`` pairs are legal: each occurrence is its own sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS_SCHEMA = "x_id INT, y_id INT, rating DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem ⋈ orders`` as rating triples: customer x part, quantity / 10.

    Only the five needed columns reach the parquet scans (column pruning), and
    the join is a plain equi-join left to Catalyst/AQE.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .select(F.col("o_custkey").cast("int").alias("x_id"),
                      F.col("l_partkey").cast("int").alias("y_id"),
                      (F.col("l_quantity").cast("double") / F.lit(10.0)).alias("rating")))


def read_ratings_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Typed scan of headerless ``x,y,rating`` lines.

    Fields after the third are ignored unless ``strict`` (then a line must hold
    exactly three).  A header, a short line, an empty line or a non-numeric
    field fails the job (ANSI casts and ``raise_error``), as the original
    parsers do.  Scan parallelism (the original's partition-count hint) is set
    by the session: ``spark.sql.files.maxPartitionBytes`` and
    ``spark.sql.files.minPartitionNum``.
    """
    lines = spark.read.text(path)
    parts = F.split(F.col("value"), ",")
    n_fields = F.size(parts)
    bad = (n_fields != 3) if strict else (n_fields < 3)
    malformed = F.raise_error(F.concat(F.lit("malformed ratings line: "), F.col("value")))

    def field(i: int, kind: str):
        # the line is checked by every column, so by whichever of them a query keeps; ANSI casts
        # already fail on bad text, the guard makes it fail without ANSI too
        text = F.when(bad, malformed.cast("string")).otherwise(parts.getItem(i))
        return F.coalesce(text.cast(kind), malformed.cast(kind))

    return lines.select(field(0, "int").alias("x_id"), field(1, "int").alias("y_id"),
                        field(2, "double").alias("rating"))


def write_ratings_csv(ratings: DataFrame, path: str, mode: str = "error") -> None:
    """Headerless ``x,y,rating`` CSV (the relabeled-ratings sink, S9)."""
    (ratings.select("x_id", "y_id", "rating")
            .write.mode(mode).option("header", "false").csv(path))
