"""Importing this module registers every query of the subpackage."""

from tidegate.llm import clustering, decontamination, jaccard, lm, neardup, packing, pii, prefixtrie, quality, secrets, substrings, tokenfile, toolcalls  # noqa: F401
from tidegate.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
