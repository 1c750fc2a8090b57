"""Queries for the analytic models, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans.model_sql import oracle
from touchline.plans.models import Warehouse

#: The instant that stands for "now" on the test tables.
AS_OF = datetime(2025, 3, 1)
#: Query name by model: all models that need no parameter.
NAMES = {name: f"m_{name}" for name in Warehouse.names()}


def ratings(w: Warehouse) -> DataFrame:
    """Ratings made from the keys, as the test tables have none."""
    rating = F.lit(1500.0) + F.pmod(F.col("team_id") * 37 + F.col("fixture_id") * 11, F.lit(400))
    return w.ref("fact_team_fixtures").select(
        "team_id", "league_season_id", "fixture_id", rating.alias("pre_elo_rating"), F.lit("match").alias("snapshot_type")
    )


def warehouse(spark: SparkSession, root: str) -> Warehouse:
    """The models over test tables."""
    return Warehouse(spark, root, AS_OF, elo_rating=ratings)


def _query(name: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        return warehouse(spark, root).ref(name)

    return run


QUERIES = {query: _query(name) for name, query in NAMES.items()}
ORACLES = {query: oracle(name) for name, query in NAMES.items()}
