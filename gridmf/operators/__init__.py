"""DataFrame operators of the factorization engine."""
