"""All registered queries of the subpackage."""

from palisade.llm import corpus_queries, text_queries  # noqa: F401
from palisade.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
