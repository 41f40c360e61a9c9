"""One query for each operator, over the test tables, with its equivalent in SQL."""

from lattiq.catalogue import aggregates, lods, model, scalars, similarity, sources, streams, tablecalcs, views  # noqa: F401
from lattiq.catalogue.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
