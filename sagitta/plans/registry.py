"""Every query by its name, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES
from .queries import QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event quivers, found in the generated catalogue with their classes."""
    return QUERIES["join_events_catalogue"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
