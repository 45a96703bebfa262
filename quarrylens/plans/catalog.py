"""All registered queries with their SQL."""

from quarrylens.plans import canonical, entry, graphs, programs, relational, searches, stores, texts  # noqa: F401  they register themselves
from quarrylens.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
