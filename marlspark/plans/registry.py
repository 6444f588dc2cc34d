"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlspark.plans import base, catalog, details, files, images, indexed, metadata, reconcile, requests, retrieval, safety, shown, streams, structures, text  # noqa: F401  the modules register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
