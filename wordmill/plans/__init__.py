"""Registered plans: every operator of the library applied to the driver's tables."""

from wordmill.plans import activity, corpus, providers, review, streams  # noqa: F401  (they register their queries)
from wordmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
