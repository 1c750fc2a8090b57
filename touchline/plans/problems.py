"""Queries of the general data problems 1 to 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.exactly_once import exactly_once, seen_ranges
from touchline.operators.history import entity_history
from touchline.operators.references import Parent, Reference, dangling_references, reference_report
from touchline.session import read_table


def _references(spark: SparkSession, root: str) -> tuple[list[Reference], list[Parent]]:
    fixtures, standings = read_table(spark, root, "raw_fixtures"), read_table(spark, root, "raw_league_standings")
    references = [
        Reference(fixtures, "raw_fixtures", "home_team_id", "dim_teams", "kickoff_utc"),
        Reference(fixtures, "raw_fixtures", "away_team_id", "dim_teams", "kickoff_utc"),
        Reference(fixtures, "raw_fixtures", "api_league_id", "dim_leagues", "kickoff_utc"),
        Reference(standings, "raw_league_standings", "api_team_id", "dim_teams", "updated_at"),
    ]
    parents = [
        Parent(read_table(spark, root, "dim_teams"), "dim_teams", "api_team_id"),
        Parent(read_table(spark, root, "dim_leagues"), "dim_leagues", "api_league_id"),
    ]
    return references, parents


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return dangling_references(*_references(spark, root))


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return reference_report(*_references(spark, root))


def _versions(spark: SparkSession, root: str) -> DataFrame:
    standings = read_table(spark, root, "raw_league_standings").withColumn("form", F.regexp_replace(F.upper("form"), "[^WDL]", ""))
    return entity_history(standings, ["league_season_id", "api_team_id"], "updated_at", "created_at", ["rank", "form"])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _versions(spark, root).select("league_season_id", "api_team_id", F.unix_seconds("valid_from").alias("valid_from_s"))


def p2_history(spark: SparkSession, root: str) -> DataFrame:
    return _versions(spark, root).select(
        "league_season_id",
        "api_team_id",
        "rank",
        "form",
        F.unix_seconds("valid_from").alias("valid_from_s"),
        F.unix_seconds("valid_to").alias("valid_to_s"),
        "is_current",
    )


def kept_fixtures(spark: SparkSession, root: str, carry: list[str]) -> DataFrame:
    """The newest delivery of each fixture, with the columns ``carry``."""
    marked = exactly_once(read_table(spark, root, "raw_fixtures"), "api_fixture_id", ["updated_at", "fixture_id"], carry)
    return marked.filter("is_kept").drop("is_kept")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    fixtures = read_table(spark, root, "raw_fixtures")
    marked = exactly_once(fixtures, "api_fixture_id", ["updated_at", "fixture_id"], ["api_fixture_id", "fixture_id"])
    return marked.filter(~F.col("is_kept")).drop("is_kept")


def p3_ranges(spark: SparkSession, root: str) -> DataFrame:
    return seen_ranges(read_table(spark, root, "raw_fixtures"), "api_fixture_id").select("lo", "hi", "n_numbers")


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_history": p2_history,
    "p3_found": p3_found,
    "p3_ranges": p3_ranges,
}

_REFS = """
refs AS (
  SELECT 'raw_fixtures' AS src_table, 'home_team_id' AS src_column, CAST(home_team_id AS BIGINT) AS ref_key, strftime(kickoff_utc AT TIME ZONE 'UTC', '%Y-%m') AS period, r.created_at AS written, 'dim_teams' AS parent FROM raw_fixtures r
  UNION ALL SELECT 'raw_fixtures', 'away_team_id', CAST(away_team_id AS BIGINT), strftime(kickoff_utc AT TIME ZONE 'UTC', '%Y-%m'), created_at, 'dim_teams' FROM raw_fixtures
  UNION ALL SELECT 'raw_fixtures', 'api_league_id', CAST(api_league_id AS BIGINT), strftime(kickoff_utc AT TIME ZONE 'UTC', '%Y-%m'), created_at, 'dim_leagues' FROM raw_fixtures
  UNION ALL SELECT 'raw_league_standings', 'api_team_id', CAST(api_team_id AS BIGINT), strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m'), created_at, 'dim_teams' FROM raw_league_standings
), born AS (
  SELECT 'dim_teams' AS parent, CAST(api_team_id AS BIGINT) AS k, min(created_at) AS born FROM dim_teams GROUP BY 2
  UNION ALL SELECT 'dim_leagues', CAST(api_league_id AS BIGINT), min(created_at) FROM dim_leagues GROUP BY 2
), judged AS (
  SELECT refs.*, CASE WHEN k IS NULL THEN 'missing' WHEN written < born THEN 'late' END AS kind
  FROM refs LEFT JOIN born ON refs.parent = born.parent AND ref_key = k WHERE ref_key IS NOT NULL
)"""

_STATES = """
counted AS (
  SELECT *, row_number() OVER (PARTITION BY league_season_id, api_team_id, updated_at ORDER BY created_at DESC) AS rn,
         regexp_replace(upper(form), '[^WDL]', '', 'g') AS f
  FROM raw_league_standings
), states AS (
  SELECT *, row_number() OVER w AS pos, lag(rank) OVER w AS pr, lag(f) OVER w AS pf FROM counted WHERE rn = 1
  WINDOW w AS (PARTITION BY league_season_id, api_team_id ORDER BY updated_at)
), versions AS (
  SELECT league_season_id, api_team_id, rank, f AS form, CAST(floor(epoch(updated_at)) AS BIGINT) AS valid_from_s
  FROM states WHERE pos = 1 OR rank IS DISTINCT FROM pr OR f IS DISTINCT FROM pf
)"""

_KEPT = """
kept AS (
  SELECT *, row_number() OVER (PARTITION BY api_fixture_id ORDER BY updated_at DESC, fixture_id DESC) AS rn FROM raw_fixtures
)"""

ORACLES = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT src_table, src_column, ref_key, period, kind FROM judged WHERE kind IS NOT NULL",
    "p1_report": f"""WITH {_REFS} SELECT src_table, src_column, period, kind, count(DISTINCT ref_key) AS n_keys, count(*) AS n_rows
FROM judged WHERE kind IS NOT NULL GROUP BY ALL""",
    "p2_found": f"WITH {_STATES} SELECT league_season_id, api_team_id, valid_from_s FROM versions",
    "p2_history": f"""WITH {_STATES}, spans AS (
  SELECT *, lead(valid_from_s) OVER (PARTITION BY league_season_id, api_team_id ORDER BY valid_from_s) AS valid_to_s FROM versions
) SELECT league_season_id, api_team_id, rank, form, valid_from_s, valid_to_s, valid_to_s IS NULL AS is_current FROM spans""",
    "p3_found": f"WITH {_KEPT} SELECT api_fixture_id, fixture_id FROM kept WHERE rn > 1",
    "p3_ranges": """WITH numbers AS (SELECT DISTINCT api_fixture_id AS seq FROM raw_fixtures WHERE api_fixture_id >= 0),
islands AS (SELECT seq, seq - row_number() OVER (ORDER BY seq) AS island FROM numbers)
SELECT min(seq) AS lo, max(seq) AS hi, max(seq) - min(seq) + 1 AS n_numbers FROM islands GROUP BY island""",
}
