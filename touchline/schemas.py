"""Schemas of the tables and documents an installation provides, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: DDL of each table; NOT NULL marks required values.
TABLES: dict[str, str] = {
    "raw_fixtures": """fixture_id bigint not null, api_fixture_id bigint not null, api_league_id int not null, season int not null,
        kickoff_utc timestamp not null, fixture_status string not null, home_team_id int, home_team_name string,
        away_team_id int, away_team_name string, home_team_halftime_goal int, away_team_halftime_goal int,
        home_team_fulltime_goal int, away_team_fulltime_goal int, home_fulltime_result string, away_fulltime_result string,
        home_halftime_result string, away_halftime_result string, created_at timestamp not null, updated_at timestamp not null""",
    "raw_league_standings": """league_season_id int not null, api_league_id int not null, season int not null, api_team_id int not null,
        team_name string, form string, rank int, points int, games_played int, wins int, draws int, losses int,
        goals_for int, goals_against int, goal_diff int, created_at timestamp not null, updated_at timestamp not null""",
    "elo_rating": """team_id int not null, league_season_id int not null, fixture_id bigint not null, pre_elo_rating double,
        post_elo_rating double, elo_change double, tier int, snapshot_type string not null, created_at timestamp not null""",
    "team_form": """league_season_id int not null, league_name string, event_name string not null, context string not null,
        team_id int not null, team_name string not null, next_opponent_id int, next_opponent_name string,
        next_kickoff_utc timestamp, score double, n int, k int, misses int, p_bayes double, streak_length int,
        updated_at timestamp not null""",
    "dim_countries": "country_id bigint not null, country_name string not null, logo_file_id string, created_at timestamp not null, updated_at timestamp not null",
    "dim_leagues": """league_id bigint not null, country_id bigint not null, league_name string not null, api_league_id int not null,
        tier int, logo_file_id string, created_at timestamp not null, updated_at timestamp not null""",
    "dim_league_seasons": """league_season_id bigint not null, league_id bigint not null, season int not null, season_label string not null,
        start_date date, end_date date, fixtures_bootstrap_done boolean not null, fixtures_bootstrap_at timestamp,
        created_at timestamp not null, updated_at timestamp not null""",
    "dim_venue": """venue_id bigint not null, api_venue_id int, venue_name string, venue_capacity int, venue_city string,
        logo_file_id string, country_id bigint, created_at timestamp not null, updated_at timestamp not null""",
    "dim_teams": """team_id bigint not null, api_team_id int not null, team_name string not null, team_code string, country_id bigint not null,
        logo_file_id string, venue_id bigint, created_at timestamp not null, updated_at timestamp not null""",
}

#: Keys that must be unique in a table.
UNIQUE: dict[str, list[list[str]]] = {
    "raw_fixtures": [["fixture_id"], ["api_fixture_id"]],
    "raw_league_standings": [["league_season_id", "api_team_id"]],
    "elo_rating": [["team_id", "league_season_id", "fixture_id", "snapshot_type"]],
    "dim_countries": [["country_id"], ["country_name"]],
    "dim_leagues": [["league_id"], ["api_league_id"]],
    "dim_league_seasons": [["league_season_id"], ["league_id", "season"]],
    "dim_venue": [["venue_id"], ["api_venue_id"]],
    "dim_teams": [["team_id"], ["api_team_id"]],
}

#: One element of the fixtures document.
FIXTURE_PAYLOAD = """fixture struct<id: bigint, date: string, status: struct<short: string>>,
    league struct<id: int, season: int>,
    teams struct<home: struct<id: int, name: string>, away: struct<id: int, name: string>>,
    score struct<halftime: struct<home: int, away: int>, fulltime: struct<home: int, away: int>>"""

STANDINGS_PAYLOAD = """league_season_id int, league struct<standings: array<array<struct<
    team: struct<id: int, name: string>, rank: int, points: int, goalsDiff: int, form: string,
    all: struct<played: int, win: int, draw: int, lose: int, goals: struct<`for`: int, against: int>>>>>>"""

LEAGUE_PAYLOAD = "league struct<id: int, name: string>, seasons array<struct<year: string, start: string, end: string>>"
TEAM_PAYLOAD = "team struct<id: int, name: string, code: string>"
CONFIG_TREE = "country string, leagues array<struct<name: string>>"
DLQ_ENTRY = "api_league_id int, season_year int, league_name string, ds string, error string, traceback string, timestamp string"

FAILURE = "pipeline string, request string, error string, body string, timestamp string"

#: The flat fixture record that is landed between extraction and load.
LANDED_FIXTURE = ", ".join(
    " ".join(part.split()[:2])
    for part in TABLES["raw_fixtures"].split(",")
    if part.split()[0] not in ("fixture_id", "created_at", "updated_at")
)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """``df`` unchanged, or an error naming the columns of ``table`` that it lacks or has in another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema(table) if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{table}: missing or of another type: {', '.join(wrong)}")
    return df


def key_violations(df: DataFrame, table: str) -> DataFrame:
    """One row per rule of ``table``: columns string, rule (required or unique), violations long (null rows, or values that repeat).

    One pass counts the nulls of all required columns, and one for each key the values that repeat.
    """
    required = [f.name for f in schema(table) if not f.nullable]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    rows = F.array(*[F.struct(F.lit(c).alias("columns"), F.lit("required").alias("rule"), F.col(c).alias("violations")) for c in required])
    found = counted.select(F.inline(rows))
    for key in UNIQUE.get(table, []):
        known = df.filter(" and ".join(f"`{k}` is not null" for k in key))
        repeated = known.groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
        found = found.unionByName(repeated.select(F.lit(", ".join(key)).alias("columns"), F.lit("unique").alias("rule"), "violations"))
    return found


def require_keys(df: DataFrame, table: str) -> DataFrame:
    """``df`` unchanged, or an error naming the keys of ``table`` that are null or repeated in it."""
    wrong = key_violations(df, table).filter("violations > 0").collect()
    if wrong:
        said = [f"({r['columns']}) " + (f"repeats for {r['violations']} values" if r["rule"] == "unique" else f"is null in {r['violations']} rows") for r in wrong]
        raise ValueError(f"{table}: {'; '.join(said)}")
    return df


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the database and all tables that don't exist yet, as Parquet tables."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")
