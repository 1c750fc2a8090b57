"""Queries that run loads, landing zone and streams over the test tables, each with its SQL.

The service is played by recorded answers made from the tables; warehouse, landing zone and answers
lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import files
from touchline.operators import upsert
from touchline.operators.sequences import latest_per
from touchline.plans import pipelines
from touchline.plans.model_queries import AS_OF, ratings, warehouse
from touchline.plans.model_sql import chain
from touchline.plans.models import SEEDS, Warehouse
from touchline.plans.operator_queries import _CUT_SQL, _NEWEST, _NOW_SQL, _deliveries, _now, _result, nested_fixture
from touchline.plans.pipelines import Config
from touchline.schemas import TABLES, UNIQUE, create_tables, key_violations, schema
from touchline.session import new_shared_path, read_table, shuffle_parts
from touchline.sources import api, landing
from touchline.streaming import incremental

_DS = f"{AS_OF:%Y-%m-%d}"
_DIMS = ["dim_countries", "dim_leagues", "dim_league_seasons", "dim_teams"]
_SHOWN = ["fixture_id", "api_fixture_id", "api_league_id", "season", "kickoff_utc", "fixture_status", "home_team_id", "away_team_id"]
_SHOWN += ["home_team_fulltime_goal", "away_team_fulltime_goal", "home_fulltime_result", "updated_at"]


def _install(spark: SparkSession, root: str, tables: list[str] = _DIMS) -> Config:
    """An installation whose warehouse holds some of the tables."""
    home = new_shared_path(spark, "installation")
    config = Config(f"{home}/land", f"{home}/warehouse", folder=f"{home}/answers", lanes=shuffle_parts(spark))
    for name in tables:
        landing.publish(upsert.normalise(read_table(spark, root, name), spark.createDataFrame([], schema(name))), config.warehouse, name)
    return config


def _name(by: dict[str, Column]) -> Column:
    """The name of the answer to a request with these parameters."""
    return F.concat_ws("_", *[F.concat(F.lit(f"{k}-"), by[k].cast("string")) for k in sorted(by)])


def _record(items: DataFrame, endpoint: str, by: dict[str, Column], config: Config) -> None:
    """Record answers: ``items`` with the column ``item``, grouped by the parameters of their request.

    With a column ``same_as``, the name of another answer, an answer is that one, which is kept once.
    """
    listed = F.collect_list("item")
    # of the leagues of one name the first counts, so that it must be the same one in every run
    parts = [(F.sort_array(listed) if endpoint == "leagues" else listed).alias("response")]
    if "same_as" in items.columns:
        parts.append(F.any_value("same_as").alias("same_as"))
    grouped = items.groupBy(_name(by).alias("name")).agg(F.to_json(F.struct(*parts)).alias("body"))
    packs = api.planned_packs(items.sparkSession, config.folder, endpoint)
    if packs:
        api.pack_answers(grouped, config.folder, endpoint, packs)
    else:
        api.record_answers(grouped.withColumn("endpoint", F.lit(endpoint)), config.folder)


def _record_fixtures(spark: SparkSession, root: str, config: Config) -> None:
    rows = warehouse(spark, root).ref("stg_raw_fixtures").withColumn("item", nested_fixture())
    _record(rows, "fixtures", {"league": F.col("api_league_id"), "season": F.col("season")}, config)


def _fixtures(spark: SparkSession, config: Config) -> DataFrame:
    return landing.current(spark, config.warehouse, "raw_fixtures").select(*_SHOWN)


def o_full_load(spark, root):
    config = _install(spark, root)
    _record_fixtures(spark, root, config)
    pipelines.full_load(spark, config, _DS, AS_OF)
    return _fixtures(spark, config)


def o_run_counters(spark, root):
    config = _install(spark, root)
    _record_fixtures(spark, root, config)
    counts = pipelines.full_load(spark, config, _DS, AS_OF)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} bigint" for k in counts))


def o_dead_letters(spark, root):
    """What a full load leaves in the queue: units that the service doesn't know."""
    config = _install(spark, root)
    _record_fixtures(spark, root, config)
    pipelines.full_load(spark, config, _DS, AS_OF)
    return landing.residual(spark, config.root).select("api_league_id", "season_year", "league_name", "error", "n_failures")


def o_marked_done(spark, root):
    config = _install(spark, root)
    _record_fixtures(spark, root, config)
    pipelines.full_load(spark, config, _DS, AS_OF)
    return landing.current(spark, config.warehouse, "dim_league_seasons").select("league_season_id", "fixtures_bootstrap_done", "fixtures_bootstrap_at")


def o_replay(spark, root):
    """A full load while the service answers nothing, then the replay of its dead letters."""
    config = _install(spark, root)
    pipelines.full_load(spark, config, _DS, AS_OF)
    _record_fixtures(spark, root, config)
    pipelines.replay_dead_letters(spark, config, _DS, AS_OF)
    return _fixtures(spark, config)


def _install_deliveries(spark: SparkSession, root: str) -> tuple[Config, DataFrame]:
    """(installation that holds the deliveries before the cut, newest deliveries of all)."""
    config = _install(spark, root)
    rows = read_table(spark, root, "raw_fixtures")
    old, _ = _deliveries(spark, root)
    held = rows.join(old.select("fixture_id"), "fixture_id", "left_semi")
    landing.publish(upsert.normalise(held, spark.createDataFrame([], schema("raw_fixtures"))), config.warehouse, "raw_fixtures")
    return config, warehouse(spark, root).ref("stg_raw_fixtures")


def _incremental(spark: SparkSession, root: str, mode: str) -> DataFrame:
    config, newest = _install_deliveries(spark, root)
    fixtures, leagues, seasons = (landing.current(spark, config.warehouse, n) for n in ("raw_fixtures", "dim_leagues", "dim_league_seasons"))
    stale = pipelines.stale_fixtures(fixtures, leagues, pipelines._current(seasons, AS_OF), _now())
    items = newest.withColumn("item", nested_fixture())
    if mode == "ids":
        ids = [r[0] for r in stale.select("api_fixture_id").distinct().orderBy("api_fixture_id").toLocalIterator()]
        asked = [(int(i), p["ids"]) for p in api.batches_of_ids(ids) for i in p["ids"].split("-")]
        batches = spark.createDataFrame(asked, "api_fixture_id bigint, ids string")
        _record(items.join(batches, "api_fixture_id"), "fixtures", {"ids": F.col("ids")}, config)
    else:
        spans = pipelines.earliest_missing(stale).select("api_league_id", "season", "from_date")
        due = items.join(spans, ["api_league_id", "season"]).filter(F.col("kickoff_utc").cast("date") >= F.col("from_date"))
        _record(due, "fixtures", {"league": F.col("api_league_id"), "season": F.col("season"), "from": F.col("from_date"), "to": F.lit(_DS)}, config)
    pipelines.incremental_load(spark, config, _DS, AS_OF, mode)
    return _fixtures(spark, config)


def o_incremental_ids(spark, root):
    return _incremental(spark, root, "ids")


def o_incremental_dates(spark, root):
    return _incremental(spark, root, "batch")


def o_kickoff_corrections(spark, root):
    """Kickoffs after the last and next eleven matches of each current season were compared with the service."""
    config, newest = _install_deliveries(spark, root)
    rows = newest.withColumn("item", nested_fixture()).withColumn("ahead", F.col("kickoff_utc") >= _now())
    for side, ahead, order in (("last", False, ["kickoff_utc", "api_fixture_id"]), ("next", True, ["gone", "api_fixture_id"])):
        mine = rows.filter(F.col("ahead") == F.lit(ahead)).withColumn("gone", -F.unix_micros("kickoff_utc"))
        first = latest_per(mine, ["api_league_id", "season"], order, config.look)
        _record(first, "fixtures", {"league": F.col("api_league_id"), "season": F.col("season"), side: F.lit(config.look)}, config)
    pipelines.correct_kickoffs(spark, config, AS_OF)
    return landing.current(spark, config.warehouse, "raw_fixtures").select("api_fixture_id", "kickoff_utc", "updated_at")


def o_standings_load(spark, root):
    config = _install(spark, root)
    rows = warehouse(spark, root).ref("stg_raw_league_standings")
    goals = F.struct(F.col("goals_for").alias("for"), F.col("goals_against").alias("against")).alias("goals")
    record = F.struct(F.col("games_played").alias("played"), F.col("wins").alias("win"), F.col("draws").alias("draw"), F.col("losses").alias("lose"), goals)
    team = F.struct(F.col("api_team_id").alias("id"), F.col("team_name").alias("name")).alias("team")
    line = F.struct(team, "rank", "points", F.col("goal_diff").alias("goalsDiff"), "form", record.alias("all"))
    tables = rows.groupBy("league_season_id").agg(F.struct(F.struct(F.array(F.collect_list(line)).alias("standings")).alias("league")).alias("item"))
    seasons, leagues = read_table(spark, root, "dim_league_seasons"), read_table(spark, root, "dim_leagues")
    known = seasons.select("league_season_id", "league_id", "season").join(leagues.select("league_id", "api_league_id"), "league_id")
    _record(tables.join(known, "league_season_id"), "standings", {"league": F.col("api_league_id"), "season": F.col("season")}, config)
    pipelines.refresh_standings(spark, config, AS_OF)
    columns = ["league_season_id", "api_league_id", "season", "api_team_id", "team_name", "rank", "points", "wins", "goal_diff", "form", "updated_at"]
    return landing.current(spark, config.warehouse, "raw_league_standings").select(*columns)


def _squads(leagues: DataFrame, seasons: DataFrame, teams: DataFrame, once: bool) -> DataFrame:
    """All clubs (api_team_id, team_name, team_code) by api_league_id and season; a league season without clubs has one row of nulls.

    In each season that its country plays, a club is in one league there, drawn by a hash, so that
    answers grow as the clubs and not as clubs times leagues. Leagues of one name, which a request
    can't tell apart, have the same clubs; with ``once`` only the first of them (``first_id``) lists them.
    """
    played = seasons.select("league_id", "season").join(leagues.select("league_id", "api_league_id", "country_id", "league_name"), "league_id")
    named = played.groupBy("country_id", "season", "league_name").agg(F.sort_array(F.collect_set("api_league_id")).alias("ids"))
    listed = F.sort_array(F.collect_list(F.struct("league_name", (F.slice("ids", 1, 1) if once else F.col("ids")).alias("ids"))))
    choice = named.groupBy("country_id", "season").agg(F.transform(listed, lambda x: x["ids"]).alias("choice"))
    drawn = F.get("choice", F.pmod(F.xxhash64("api_team_id", "season"), F.size("choice")).cast("int"))
    clubs = teams.join(choice, "country_id").select("season", F.explode(drawn).alias("api_league_id"), "api_team_id", "team_name", "team_code")
    asked = named.select("season", F.explode("ids").alias("api_league_id"), F.get("ids", F.lit(0)).alias("first_id"))
    return asked.join(clubs, ["api_league_id", "season"], "left")


def _metadata(spark: SparkSession, root: str) -> Config:
    """An empty warehouse after the refresh of metadata, with the config and the answers made from the dim tables."""
    config = _install(spark, root, [])
    countries, leagues, seasons, teams = (read_table(spark, root, n) for n in _DIMS)
    named = leagues.join(countries.select("country_id", "country_name"), "country_id")
    pairs = named.select("country_name", "league_name").distinct()
    listed = F.sort_array(F.collect_list(F.struct(F.col("league_name").alias("name"))))
    tree = countries.select("country_name").distinct().join(pairs, "country_name", "left").groupBy("country_name")
    tree = tree.agg(F.filter(listed, lambda x: x["name"].isNotNull()).alias("leagues")).withColumnRenamed("country_name", "country")
    api.plan_packs(spark, config.folder, "leagues", pairs.count())
    api.plan_packs(spark, config.folder, "teams", seasons.select("league_id", "season").distinct().count())
    year = F.struct(F.col("season").cast("string").alias("year"), F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"))
    of = seasons.groupBy("league_id").agg(F.sort_array(F.collect_list(year)).alias("seasons"))
    card = F.struct(F.struct(F.col("api_league_id").alias("id"), F.col("league_name").alias("name")).alias("league"), "seasons")
    _record(named.join(of, "league_id").withColumn("item", card), "leagues", {"country": F.col("country_name"), "name": F.col("league_name")}, config)
    club = F.struct(F.struct(F.col("api_team_id").alias("id"), F.col("team_name").alias("name"), F.col("team_code").alias("code")).alias("team"))
    request = {"league": F.col("api_league_id"), "season": F.col("season")}
    once = api.planned_packs(spark, config.folder, "teams") > 0
    squads = _squads(leagues, seasons, teams, once).withColumn("item", F.when(F.col("api_team_id").isNotNull(), club))
    if once:
        squads = squads.withColumn("same_as", F.when(F.col("api_league_id") != F.col("first_id"), _name(request | {"league": F.col("first_id")})))
    _record(squads, "teams", request, config)
    pipelines.refresh_metadata(spark, config, tree, AS_OF)
    return config


def o_metadata_seasons(spark, root):
    config = _metadata(spark, root)
    countries, leagues, seasons = (landing.current(spark, config.warehouse, n) for n in _DIMS[:3])
    joined = seasons.join(leagues.select("league_id", "country_id", "league_name", "api_league_id"), "league_id").join(countries.select("country_id", "country_name"), "country_id")
    return joined.select("country_name", "league_name", "api_league_id", "season", "season_label", "start_date", "end_date", "fixtures_bootstrap_done")


def o_metadata_teams(spark, root):
    config = _metadata(spark, root)
    countries, teams = landing.current(spark, config.warehouse, "dim_countries"), landing.current(spark, config.warehouse, "dim_teams")
    return teams.join(countries.select("country_id", "country_name"), "country_id").select("team_id", "api_team_id", "team_name", "team_code", "country_name")


def o_config_tree(spark, root):
    """Countries and leagues of a YAML file made from the dim tables."""
    leagues = read_table(spark, root, "dim_leagues").join(read_table(spark, root, "dim_countries").select("country_id", "country_name"), "country_id")
    lines = leagues.groupBy("country_name").agg(F.sort_array(F.collect_list("league_name")).alias("names")).orderBy("country_name").toLocalIterator()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    text = "countries:\n" + "".join(f"- country: {quote(r[0])}\n  leagues:\n" + "".join(f"  - name: {quote(n)}\n" for n in r[1]) for r in lines)
    path = f"{new_shared_path(spark, 'config')}/leagues.yaml"
    files.write_text(spark, path, text)
    return landing.read_config(spark, path).select("country", F.explode("leagues").alias("l")).select("country", F.col("l.name").alias("league"))


def o_landed_fixtures(spark, root):
    """Fixtures landed as JSON by league and season, read again with the parts of their paths."""
    rows = warehouse(spark, root).ref("stg_raw_fixtures").drop("fixture_id", "is_played", "created_at", "updated_at")
    path = landing.land_fixtures(rows, new_shared_path(spark, "land"), _DS)
    landed = landing.path_parts(landing.read_landed(spark, path), {"day": 2})
    columns = ["api_fixture_id", "api_league_id", "season", "kickoff_utc", "fixture_status", "home_team_name", "home_team_fulltime_goal", "home_fulltime_result"]
    return landed.select(*columns, F.col("league").cast("int").alias("league"), F.col("season_year").cast("int").alias("season_year"), F.col("ds").cast("string").alias("ds"), "day")


def o_json_documents(spark, root):
    """One JSON array for each league, as the service's answers are stored, a row per element."""
    home = new_shared_path(spark, "arrays")
    rows = read_table(spark, root, "dim_league_seasons").select("league_id", "season", "season_label")
    body = F.to_json(F.collect_list(F.struct("season", "season_label")))
    grouped = rows.groupBy("league_id").agg(body.alias("body")).select(F.lit("seasons").alias("endpoint"), F.col("league_id").cast("string").alias("name"), "body")
    api.record_answers(grouped, home)
    read = landing.path_parts(landing.read_json_array(spark, f"{home}/seasons", "season int, season_label string"), {"file": 1})
    return read.select(F.regexp_replace("file", "[.]json$", "").cast("long").alias("league_id"), "season", "season_label")


def o_bulk_csv(spark, root):
    """Teams written as delimited text with empty nulls, and read again."""
    path, columns = new_shared_path(spark, "csv"), ["team_id", "api_team_id", "team_name", "team_code", "venue_id"]
    rows = read_table(spark, root, "dim_teams").select(*columns)
    landing.bulk_csv(rows, path)
    return spark.read.schema(rows.schema).option("nullValue", "").option("emptyValue", "").csv(path)


def o_relevance_from_seeds(spark, root):
    """Relevance with weights from CSV seeds instead of the fixed values."""
    home, given = new_shared_path(spark, "seeds"), {}
    for name, values in SEEDS.items():
        kind = "int" if name == "threshold_multipliers" else "string"
        ddl = f"key {kind}, value double, version string"
        spark.createDataFrame([(k, v, "v1") for k, v in values.items()], ddl).write.option("header", True).csv(f"{home}/{name}")
        given[name] = landing.read_seed(spark, f"{home}/{name}", ddl)
    return Warehouse(spark, root, AS_OF, elo_rating=ratings, **given).ref("fact_team_streak_relevance_score")


def o_published(spark, root):
    """The third version of a table, of which the two newest are kept."""
    home, rows = new_shared_path(spark, "published"), read_table(spark, root, "dim_leagues").select("league_id", "league_name")
    for part in (rows.limit(0), rows.select("league_id", F.upper("league_name").alias("league_name")), rows):
        landing.publish(part, home, "dim_leagues")
    kept = sum(n.startswith("v") for n in files.children(spark, f"{home}/dim_leagues"))
    return landing.published(spark, home, "dim_leagues").withColumn("n_versions", F.lit(kept))


def o_change_sensor(spark, root):
    """Whether a file is new to a marker: at first, after the marker was set, and after the file was written again."""
    import time

    home = new_shared_path(spark, "sensor")
    files.write_text(spark, f"{home}/file", "one")
    first, at = landing.changed_since(spark, f"{home}/file", f"{home}/marker")
    landing.commit_marker(spark, f"{home}/marker", at)
    second, _ = landing.changed_since(spark, f"{home}/file", f"{home}/marker")
    time.sleep(1.1)
    files.write_text(spark, f"{home}/file", "two")
    third, _ = landing.changed_since(spark, f"{home}/file", f"{home}/marker")
    return spark.createDataFrame([(first, second, third)], "first boolean, second boolean, third boolean")


_LISTED = [n for n in TABLES if n != "elo_rating"]


def o_catalogue(spark, root):
    """Tables and columns of the catalogue after the tables were created twice."""
    database = "touchline_catalogue"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{new_shared_path(spark, 'catalogue')}'")
    for _ in range(2):
        create_tables(spark, database)
    listed = [(t, c.name) for t in _LISTED for c in spark.catalog.listColumns(f"{database}.{t}")]
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame(listed, "table_name string, column_name string")


def o_key_contract(spark, root):
    parts = [key_violations(read_table(spark, root, t), t).withColumn("table_name", F.lit(t)) for t in _LISTED]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _files_of(spark: SparkSession, root: str) -> tuple[str, str]:
    """(folder, schema) of the deliveries as several files, for a stream."""
    rows, path = read_table(spark, root, "raw_fixtures"), new_shared_path(spark, "stream-in")
    rows.repartition(4, "fixture_id").write.parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def o_stream_upsert(spark, root):
    """Deliveries read as a stream of files, kept by key as they arrive."""
    path, ddl = _files_of(spark, root)
    home = new_shared_path(spark, "stream-state")
    incremental.upsert_stream(incremental.file_stream(spark, path, ddl, files_per_batch=2), home, ddl, ["api_fixture_id"], ["updated_at", "fixture_id"]).awaitTermination()
    return incremental.KeyedState(spark, home, ddl, ["api_fixture_id"]).read().select(*_SHOWN)


def o_stream_exactly_once(spark, root):
    """The identifiers that a stream of deliveries gives out, each once."""
    path, ddl = _files_of(spark, root)
    home = new_shared_path(spark, "stream-once")
    incremental.exactly_once_stream(incremental.file_stream(spark, path, ddl, files_per_batch=2), home, "api_fixture_id", ["updated_at", "fixture_id"]).awaitTermination()
    return spark.read.schema(ddl).parquet(f"{home}/out").select("api_fixture_id")


_RUNS = [
    o_full_load,
    o_run_counters,
    o_dead_letters,
    o_marked_done,
    o_replay,
    o_incremental_ids,
    o_incremental_dates,
    o_kickoff_corrections,
    o_standings_load,
    o_metadata_seasons,
    o_metadata_teams,
    o_config_tree,
    o_landed_fixtures,
    o_json_documents,
    o_bulk_csv,
    o_relevance_from_seeds,
    o_published,
    o_change_sensor,
    o_catalogue,
    o_key_contract,
    o_stream_upsert,
    o_stream_exactly_once,
]
QUERIES = {f.__name__: f for f in _RUNS}

_FRESH = f"fresh AS (SELECT * FROM (SELECT *, {_NEWEST} AS rn FROM raw_fixtures) WHERE rn = 1)"
_GOALS = "home_team_fulltime_goal", "away_team_fulltime_goal"
_PENDING = """pending AS (SELECT l.api_league_id, CAST(year(s.start_date) AS INTEGER) AS season_year, l.league_name, s.league_season_id
FROM dim_league_seasons s JOIN dim_leagues l ON l.league_id = s.league_id JOIN dim_countries c ON c.country_id = l.country_id WHERE NOT s.fixtures_bootstrap_done)"""
_LOADED = f"""WITH {_FRESH}, {_PENDING}
SELECT row_number() OVER (ORDER BY api_fixture_id) AS fixture_id, api_fixture_id, api_league_id, season, kickoff_utc, fixture_status, home_team_id, away_team_id,
home_team_fulltime_goal, away_team_fulltime_goal, {_result(*_GOALS)} AS home_fulltime_result, {_NOW_SQL} AS updated_at
FROM fresh f WHERE EXISTS (SELECT 1 FROM pending p WHERE p.api_league_id = f.api_league_id AND p.season_year = f.season)"""
_HITS = "SELECT 1 FROM fresh f WHERE f.api_league_id = p.api_league_id AND f.season = p.season_year"
_OLD = f"old AS (SELECT * FROM (SELECT *, {_NEWEST} AS rn FROM raw_fixtures WHERE created_at < {_CUT_SQL}) WHERE rn = 1)"
_CURRENT = f"""units AS (SELECT s.league_season_id, l.api_league_id, s.season FROM dim_league_seasons s JOIN dim_leagues l ON l.league_id = s.league_id
WHERE CAST({_NOW_SQL} AT TIME ZONE 'UTC' AS DATE) BETWEEN s.start_date AND s.end_date)"""
_STALE = f"""stale AS (SELECT o.* FROM old o JOIN units u ON u.api_league_id = o.api_league_id AND u.season = o.season
WHERE o.kickoff_utc < {_NOW_SQL} - INTERVAL 2 HOUR AND (o.home_team_fulltime_goal IS NULL OR o.away_team_fulltime_goal IS NULL))"""
_MERGED = f"""SELECT CAST(coalesce(o.fixture_id, (SELECT max(fixture_id) FROM old) + sum(CASE WHEN o.fixture_id IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY coalesce(o.api_fixture_id, n.api_fixture_id))) AS BIGINT) AS fixture_id,
coalesce(o.api_fixture_id, n.api_fixture_id) AS api_fixture_id, coalesce(n.api_league_id, o.api_league_id) AS api_league_id, coalesce(n.season, o.season) AS season,
{', '.join(f'coalesce(n.{c}, o.{c}) AS {c}' for c in ('kickoff_utc', 'fixture_status', 'home_team_id', 'away_team_id', *_GOALS))},
coalesce({_result('n.home_team_fulltime_goal', 'n.away_team_fulltime_goal')}, o.home_fulltime_result) AS home_fulltime_result,
CASE WHEN n.api_fixture_id IS NULL THEN o.updated_at ELSE {_NOW_SQL} END AS updated_at FROM old o FULL JOIN answered n ON n.api_fixture_id = o.api_fixture_id"""
_SHOWN_SQL = ", ".join(_SHOWN)



def _required(table: str) -> list[str]:
    return [part.split()[0] for part in TABLES[table].split(",") if part.rstrip().endswith("not null")]


ORACLES = {
    "o_full_load": _LOADED,
    "o_replay": _LOADED,
    "o_run_counters": f"""WITH {_FRESH}, {_PENDING}, judged AS (SELECT *, EXISTS ({_HITS}) AS hit FROM pending p),
n AS (SELECT count(*) AS n FROM fresh f WHERE EXISTS (SELECT 1 FROM pending p WHERE p.api_league_id = f.api_league_id AND p.season_year = f.season))
SELECT count(*) AS pending, count(*) FILTER (hit) AS loaded, count(*) FILTER (NOT hit) AS failed, CAST(0 AS BIGINT) AS skipped,
(SELECT n FROM n) AS extracted, (SELECT n FROM n) AS fixtures FROM judged""",
    "o_dead_letters": f"""WITH {_FRESH}, {_PENDING} SELECT api_league_id, season_year, max(league_name) AS league_name, 'Failed: refused with status 404' AS error, count(*) AS n_failures
FROM pending p WHERE NOT EXISTS ({_HITS}) GROUP BY api_league_id, season_year""",
    "o_marked_done": f"""WITH {_FRESH}, {_PENDING}, hit AS (SELECT league_season_id FROM pending p WHERE EXISTS ({_HITS}))
SELECT league_season_id, fixtures_bootstrap_done OR league_season_id IN (SELECT league_season_id FROM hit) AS fixtures_bootstrap_done,
CASE WHEN league_season_id IN (SELECT league_season_id FROM hit) THEN {_NOW_SQL} ELSE fixtures_bootstrap_at END AS fixtures_bootstrap_at FROM dim_league_seasons""",
    "o_incremental_ids": f"""WITH {_FRESH}, {_OLD}, {_CURRENT}, {_STALE}, answered AS (SELECT * FROM fresh WHERE api_fixture_id IN (SELECT api_fixture_id FROM stale)) {_MERGED}""",
    "o_incremental_dates": f"""WITH {_FRESH}, {_OLD}, {_CURRENT}, {_STALE},
spans AS (SELECT api_league_id, season, CAST(min(kickoff_utc) AT TIME ZONE 'UTC' AS DATE) AS from_date FROM stale GROUP BY 1, 2),
answered AS (SELECT f.* FROM fresh f JOIN spans s ON s.api_league_id = f.api_league_id AND s.season = f.season WHERE CAST(f.kickoff_utc AT TIME ZONE 'UTC' AS DATE) >= s.from_date) {_MERGED}""",
    "o_kickoff_corrections": f"""WITH {_FRESH}, {_OLD}, {_CURRENT},
placed AS (SELECT f.*, row_number() OVER (PARTITION BY f.api_league_id, f.season, f.kickoff_utc >= {_NOW_SQL} ORDER BY abs(epoch_us(f.kickoff_utc) - epoch_us({_NOW_SQL})), f.api_fixture_id DESC) AS place
  FROM fresh f JOIN units u ON u.api_league_id = f.api_league_id AND u.season = f.season),
moved AS (SELECT p.api_fixture_id, p.kickoff_utc FROM placed p JOIN old o ON o.api_fixture_id = p.api_fixture_id WHERE place <= 11 AND o.kickoff_utc <> p.kickoff_utc AND o.fixture_status <> 'FT')
SELECT o.api_fixture_id, coalesce(m.kickoff_utc, o.kickoff_utc) AS kickoff_utc, CASE WHEN m.api_fixture_id IS NULL THEN o.updated_at ELSE {_NOW_SQL} END AS updated_at
FROM old o LEFT JOIN moved m ON m.api_fixture_id = o.api_fixture_id""",
    "o_standings_load": chain(f"""SELECT CAST(u.league_season_id AS INTEGER) AS league_season_id, u.api_league_id, u.season, s.api_team_id, s.team_name, s.rank, s.points, s.wins, s.goal_diff, s.form, {_NOW_SQL} AS updated_at
FROM stg_raw_league_standings s JOIN (WITH {_CURRENT} SELECT * FROM units) u ON u.league_season_id = s.league_season_id"""),
    "o_metadata_seasons": """SELECT c.country_name, l.league_name, l.api_league_id, s.season, s.season || '/' || lpad(CAST((s.season + 1) % 100 AS VARCHAR), 2, '0') AS season_label, s.start_date, s.end_date, false AS fixtures_bootstrap_done
FROM dim_league_seasons s JOIN dim_leagues l ON l.league_id = s.league_id JOIN dim_countries c ON c.country_id = l.country_id WHERE s.season >= 2020""",
    "o_metadata_teams": """SELECT row_number() OVER (ORDER BY t.api_team_id) AS team_id, t.api_team_id, t.team_name, t.team_code, c.country_name FROM dim_teams t JOIN dim_countries c ON c.country_id = t.country_id
WHERE EXISTS (SELECT 1 FROM dim_leagues l JOIN dim_league_seasons s ON s.league_id = l.league_id WHERE l.country_id = t.country_id AND s.season >= 2020)""",
    "o_config_tree": "SELECT c.country_name AS country, l.league_name AS league FROM dim_leagues l JOIN dim_countries c ON c.country_id = l.country_id",
    "o_landed_fixtures": f"""WITH {_FRESH} SELECT api_fixture_id, api_league_id, season, kickoff_utc, fixture_status, home_team_name, home_team_fulltime_goal, home_fulltime_result,
api_league_id AS league, season AS season_year, '{_DS}' AS ds, 'ds={_DS}' AS day FROM fresh""",
    "o_json_documents": "SELECT league_id, season, season_label FROM dim_league_seasons",
    "o_bulk_csv": "SELECT team_id, api_team_id, team_name, team_code, venue_id FROM dim_teams",
    "o_relevance_from_seeds": chain("SELECT * FROM fact_team_streak_relevance_score"),
    "o_published": "SELECT league_id, league_name, CAST(2 AS INTEGER) AS n_versions FROM dim_leagues",
    "o_change_sensor": "SELECT true AS first, false AS second, true AS third",
    "o_catalogue": f"SELECT DISTINCT table_name, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in _LISTED)})",
    "o_key_contract": "\nUNION ALL ".join(
        [f"SELECT '{t}' AS table_name, '{c}' AS columns, 'required' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {t}" for t in _LISTED for c in _required(t)]
        + [f"SELECT '{t}', '{', '.join(k)}', 'unique', count(*) FROM (SELECT 1 FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in ((t, k) for t in _LISTED for k in UNIQUE.get(t, []))]
    ),
    "o_stream_upsert": f"WITH {_FRESH} SELECT {_SHOWN_SQL} FROM fresh",
    "o_stream_exactly_once": "SELECT DISTINCT api_fixture_id FROM raw_fixtures",
}
