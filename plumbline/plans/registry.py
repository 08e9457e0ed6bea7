"""All registered queries and their SQL."""

from plumbline.plans import inference, record_queries  # noqa: F401  (they register)
from plumbline.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
