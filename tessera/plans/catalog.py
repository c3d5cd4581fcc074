"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import fields, geometry, physics, spatial, surfaces


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return geometry.QUERIES | physics.QUERIES | surfaces.QUERIES | spatial.QUERIES | fields.QUERIES


def oracle_sql() -> dict[str, str]:
    return geometry.SQL | physics.SQL | surfaces.SQL | spatial.SQL | fields.SQL
