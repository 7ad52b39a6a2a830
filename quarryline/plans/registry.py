"""Named queries of the library: callables on (spark, sf_dir) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def load() -> None:
    """Imports the modules that register queries."""
    from quarryline.plans import details, folders, library, search, upkeep  # noqa: F401
