"""gridmf - low-rank factorization of rating tables on Spark DataFrames."""

from gridmf.operators.domain import domain_sizes, domain_stats, id_domain
from gridmf.operators.factors import factors_long, init_factors
from gridmf.operators.relabel import permute_ids, relabel, shuffle_ids
from gridmf.operators.score import evaluate, evaluate_grid, predict
from gridmf.plans.train import FitResult, fit, min_num_blocks
from gridmf.sources.ratings import ratings_view, read_ratings_csv, write_ratings_csv

__all__ = [
    "FitResult", "domain_sizes", "domain_stats", "evaluate", "evaluate_grid", "factors_long", "fit",
    "id_domain", "init_factors", "min_num_blocks", "permute_ids", "predict", "ratings_view",
    "read_ratings_csv", "relabel", "shuffle_ids", "write_ratings_csv",
]
