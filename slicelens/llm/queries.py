"""Importing this module registers every query of the subpackage."""

from __future__ import annotations

from slicelens.llm import (  # noqa: F401
    chat,
    fill_middle,
    line_dedup,
    mixing,
    near_vectors,
    neighbours,
    ngram_join,
    quality,
    sentencepiece,
    shards,
    toxicity,
    url_filter,
    vector_codes,
)
from slicelens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
