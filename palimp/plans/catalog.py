"""All queries of the comparison engine, and their SQL."""

from palimp.plans import finer, scripts  # noqa: F401  (they register their queries)
from palimp.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
