"""All queries on document texts and their SQL."""

from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
