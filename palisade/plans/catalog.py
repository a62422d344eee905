"""All registered queries."""

from palisade.plans import audit_queries, data_queries, document_queries, translation_queries  # noqa: F401
from palisade.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
