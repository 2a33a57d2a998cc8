"""Queries over the given tables, one per operator."""

from tabprep.queries import (  # noqa: F401  (importing registers the queries)
    collinear, distribution, encoding, features, missing, modelling, outliers, profiling, sampling,
    scaling, schema, sources)
from tabprep.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
