"""All registered queries of the engine, with their SQL."""

from sievelight.plans import line_queries as _  # noqa: F401 - registers its queries
from sievelight.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
