"""Data tests: each gives the rows that violate it, and a list of them one summary."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number; null repeats freely."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is not in the list; null is accepted."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(values))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose value the parent lacks; null refers to nothing."""
    keys = parent.select(F.col(parent_column).alias("__tl_k")).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__tl_k"), "left_anti")


def expression(df: DataFrame, violated: Column) -> DataFrame:
    """Rows for which ``violated`` is true."""
    return df.filter(violated)


def freshness(df: DataFrame, at: str, as_of: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """One row: newest instant, age in whole hours and state pass, warn or error; an empty table is an error."""
    newest = df.agg(F.max(at).alias("newest"))
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))
    hours = F.floor(seconds / F.lit(3_600_000_000))
    state = F.when(seconds.isNull() | (seconds > error_hours * 3_600_000_000), "error").when(seconds > warn_hours * 3_600_000_000, "warn").otherwise("pass")
    return newest.select("newest", hours.cast("long").alias("age_hours"), state.alias("state"))


@dataclass
class Check:
    """One declared test of a column."""

    table: str
    column: str
    kind: str
    values: list = field(default_factory=list)
    parent: str | None = None
    parent_column: str | None = None


def run_checks(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """One row per check: table_name, column_name, kind, violations long (rows, or repeated values).

    Checks of one table that count rows share one scan; those of keys group or join by themselves.
    """
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == table]
        simple = [c for c in own if c.kind in ("not_null", "accepted_values")]
        if simple:
            bad = lambda c: F.col(c.column).isNull() if c.kind == "not_null" else (F.col(c.column).isNotNull() & ~F.col(c.column).isin(c.values))
            counted = tables[table].agg(*[F.count_if(bad(c)).alias(f"c{i}") for i, c in enumerate(simple)])
            rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(c.column).alias("column_name"), F.lit(c.kind).alias("kind"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(simple)])
            parts.append(counted.select(F.inline(rows)))
        for c in own:
            if c.kind == "unique":
                found = unique(tables[table], c.column)
            elif c.kind == "relationships":
                found = relationships(tables[table], c.column, tables[c.parent], c.parent_column)
            else:
                continue
            parts.append(found.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(c.column).alias("column_name"), F.lit(c.kind).alias("kind"), "violations"))
    return reduce(DataFrame.unionByName, parts)


_RESULTS = ["win", "draw", "loss"]
#: The tests declared for the tables and the staging models.
CHECKS = (
    [Check("raw_fixtures", c, "not_null") for c in ("fixture_id", "api_fixture_id", "api_league_id", "season", "kickoff_utc", "fixture_status")]
    + [Check("raw_fixtures", c, "not_null") for c in ("home_team_id", "home_team_name", "away_team_id", "away_team_name", "created_at", "updated_at")]
    + [Check("raw_fixtures", c, "unique") for c in ("fixture_id", "api_fixture_id")]
    + [Check("raw_fixtures", f"{s}_{h}_result", "accepted_values", _RESULTS) for s in ("home", "away") for h in ("fulltime", "halftime")]
    + [Check("raw_league_standings", c, "not_null") for c in ("league_season_id", "api_league_id", "season", "api_team_id", "rank", "games_played", "wins", "draws", "losses")]
    + [Check("dim_countries", c, k) for c in ("country_id", "country_name") for k in ("not_null", "unique")]
    + [Check("dim_leagues", c, k) for c in ("league_id", "api_league_id") for k in ("not_null", "unique")]
    + [Check("dim_leagues", c, "not_null") for c in ("league_name", "country_id")]
    + [Check("dim_leagues", "country_id", "relationships", parent="dim_countries", parent_column="country_id")]
    + [Check("dim_league_seasons", c, "not_null") for c in ("league_season_id", "league_id", "season", "start_date", "end_date")]
    + [Check("dim_league_seasons", "league_season_id", "unique")]
    + [Check("dim_league_seasons", "league_id", "relationships", parent="dim_leagues", parent_column="league_id")]
    + [Check("dim_teams", c, k) for c in ("team_id", "api_team_id") for k in ("not_null", "unique")]
    + [Check("dim_teams", "team_name", "not_null")]
    + [Check("raw_fixtures", "home_team_id", "relationships", parent="dim_teams", parent_column="api_team_id")]
    + [Check("raw_fixtures", "away_team_id", "relationships", parent="dim_teams", parent_column="api_team_id")]
    + [Check("raw_fixtures", "api_league_id", "relationships", parent="dim_leagues", parent_column="api_league_id")]
)

#: The tests declared for the models: columns that are never null, and those that are unique too.
_DECLARED = {
    "stg_raw_fixtures": ("api_league_id season kickoff_utc fixture_status home_team_id away_team_id is_played updated_at", "fixture_id api_fixture_id"),
    "stg_dim_teams": ("team_name", "team_id api_team_id"),
    "stg_dim_leagues": ("league_name country_id", "league_id api_league_id"),
    "stg_dim_league_seasons": ("league_id season start_date end_date is_current", "league_season_id"),
    "stg_dim_countries": ("country_name", "country_id"),
    "stg_raw_league_standings": ("league_season_id api_team_id rank games_played wins draws losses", ""),
    "dim_team": ("team_name", "team_id api_team_id"),
    "int_fixtures": ("league_season_id league_name season kickoff_utc home_team_id away_team_id is_played updated_at is_current", "fixture_id"),
    "fact_team_info": ("team_name team_slug league_season_id", "team_id"),
    "mart_top_team_streaks": ("team_id league_name team_name next_opponent_name event_name current_streak_length", ""),
    "mart_teams_fixture_streaks": ("team_id team_name opponent_id team_event_name team_streak_length", ""),
    "mart_team_stats": ("team_id league_season_id games_played wins draws losses", ""),
    "mart_teams_fixture_stats": ("team_id team_name next_fixture_id next_opponent_id", ""),
    "mart_nav_leagues": ("league_name country_name", "league_season_id"),
    "mart_league_info": ("league_name league_slug season_label country_name", "league_season_id"),
    "mart_league_teams": ("league_season_id team_slug team_rank", "team_id"),
    "mart_team_info": ("team_id team_name league_season_id", ""),
    "mart_team_fixture": ("team_id team_name", ""),
    "mart_fixture_info": ("fixture_id fixture_slug", ""),
    "mart_fixture_streaks": ("fixture_id team_id opponent_id event_name streak_type", ""),
    "mart_head_to_head_streaks": ("team_pair_key", ""),
    "mart_head_to_head_matches": ("team_pair_key current_fixture_id", ""),
    "mart_head_to_head_info": ("team_pair_key current_fixture_id", ""),
}
_STREAK_KINDS = ["goal_streaks", "result_streaks", "special_streaks"]
#: The tests declared for the models, but for those of the two pages, which need a parameter.
MODEL_CHECKS = [
    Check(table, column, kind)
    for table, (filled, keys) in _DECLARED.items()
    for columns, kinds in ((keys.split(), ("not_null", "unique")), (filled.split(), ("not_null",)))
    for column in columns
    for kind in kinds
] + [
    Check("mart_top_team_streaks", "streak_type", "accepted_values", _STREAK_KINDS),
    Check("mart_teams_fixture_streaks", "team_streak_type", "accepted_values", _STREAK_KINDS),
    Check("stg_dim_league_seasons", "league_id", "relationships", parent="stg_dim_leagues", parent_column="league_id"),
    Check("int_fixtures", "league_season_id", "relationships", parent="int_league_context", parent_column="league_season_id"),
    Check("int_fixtures", "home_team_id", "relationships", parent="dim_team", parent_column="api_team_id"),
    Check("int_fixtures", "away_team_id", "relationships", parent="dim_team", parent_column="api_team_id"),
    Check("fact_team_info", "league_season_id", "relationships", parent="int_league_context", parent_column="league_season_id"),
]
