"""Queries of this folder by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return keep


def load_all() -> None:
    from quern.llm import (  # noqa: F401
        best_fit, bpe, content_sort, edit_lines, entropy_scan, factor_toxicity, hard_negatives, merkle, projections, quadratic_quality,
        shuffle_shards, trie_join, word_bpe,
    )
