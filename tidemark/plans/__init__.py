"""All queries of the analytics and the SQL that each must equal."""

from tidemark.plans import folds, kept, panels
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "folds", "kept", "panels"]
