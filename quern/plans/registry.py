"""Named queries over the driver tables, each next to its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query; ``check`` is the same result in DuckDB SQL."""
    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return fn

    return keep


def load_all() -> None:
    from quern.plans import analytics, catalogue, checking, configuration, generation, listing, pacing, streams  # noqa: F401
