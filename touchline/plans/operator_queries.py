"""Queries for single operators: keyed changes, tests, nested data, sequences, functions, pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import array_text, letter_of, pair_key, result_of, safe_int, season_label, slugify, title_words, utc_instant
from touchline.operators import quality, upsert
from touchline.operators.search import trigrams
from touchline.operators.sequences import islands
from touchline.operators.shapes import flatten_fixtures, flatten_standings
from touchline.plans.model_sql import chain
from touchline.plans.model_queries import AS_OF, warehouse
from touchline.plans.models import Warehouse, mart_fixture_page_context, mart_team_page_context
from touchline.plans.pipelines import earliest_missing, pending_seasons, stale_fixtures
from touchline.schemas import FIXTURE_PAYLOAD
from touchline.session import new_shared_path, read_table

#: Deliveries written before this are the warehouse, later ones the batch that arrives.
CUT = datetime(2024, 11, 1)
_CUT_SQL = f"TIMESTAMPTZ '{CUT:%Y-%m-%d %H:%M:%S}+00'"
_NOW_SQL = f"TIMESTAMPTZ '{AS_OF:%Y-%m-%d %H:%M:%S}+00'"
_DATA = ["kickoff_utc", "fixture_status", "home_team_id", "away_team_id", "home_team_fulltime_goal", "away_team_fulltime_goal", "home_fulltime_result", "away_fulltime_result"]
_FIXTURE = ["fixture_id", "api_fixture_id", "api_league_id", "season", *_DATA, "created_at", "updated_at"]


def _now():
    return F.lit(AS_OF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _cut():
    return F.lit(CUT.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _deliveries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(warehouse, batch): the newest delivery of each fixture so far, and all that arrive after."""
    rows = read_table(spark, root, "raw_fixtures").select(*_FIXTURE)
    old = upsert.dedupe_last_wins(rows.filter(F.col("created_at") < _cut()), ["api_fixture_id"], ["updated_at", "fixture_id"])
    return old, rows.filter(F.col("created_at") >= _cut())


def _newest(batch: DataFrame) -> DataFrame:
    return upsert.dedupe_last_wins(batch, ["api_fixture_id"], ["updated_at", "fixture_id"])


def o_dedupe_last_wins(spark, root):
    return _newest(read_table(spark, root, "raw_fixtures").select(*_FIXTURE))


def o_dedupe_last_non_null(spark, root):
    rows = read_table(spark, root, "raw_fixtures").select("api_fixture_id", "fixture_id", "updated_at", *_DATA)
    return upsert.dedupe_last_non_null(rows, ["api_fixture_id"], ["updated_at", "fixture_id"])


def o_duplicate_keys(spark, root):
    return upsert.duplicate_keys(read_table(spark, root, "raw_fixtures"), ["api_fixture_id"])


def o_upsert_coalesce(spark, root):
    old, batch = _deliveries(spark, root)
    merged = upsert.dedupe_last_non_null(batch, ["api_fixture_id"], ["updated_at", "fixture_id"])
    return upsert.coalesce_upsert(old, merged, ["api_fixture_id"], _DATA, _now())


def o_update_if_changed(spark, root):
    teams = read_table(spark, root, "dim_teams").select("team_id", "api_team_id", "team_name", "updated_at")
    seen = read_table(spark, root, "raw_league_standings").filter(F.col("team_name").isNotNull())
    names = upsert.dedupe_last_wins(seen.select("api_team_id", "team_name", "updated_at", "created_at"), ["api_team_id"], ["updated_at", "created_at", "team_name"])
    return upsert.update_if_changed(teams, names.select("api_team_id", "team_name"), ["api_team_id"], ["team_name"], _now())


def o_insert_absent(spark, root):
    fixtures = read_table(spark, root, "raw_fixtures")
    sides = [fixtures.select(F.col(f"{s}_team_id").alias("api_team_id"), F.col(f"{s}_team_name").alias("team_name")) for s in ("home", "away")]
    seen = sides[0].unionByName(sides[1]).groupBy("api_team_id").agg(F.max("team_name").alias("team_name"))
    return upsert.insert_absent(read_table(spark, root, "dim_teams").select("team_id", "api_team_id", "team_name"), seen, ["api_team_id"], "team_id")


def o_partition_replace(spark, root):
    old, batch = _deliveries(spark, root)
    return upsert.replace_keys(old, _newest(batch), ["api_league_id", "season"]).select("fixture_id", "api_fixture_id", "api_league_id", "season", "updated_at")


def o_upsert_last_wins(spark, root):
    old, batch = _deliveries(spark, root)
    return upsert.replace_keys(old, _newest(batch), ["api_fixture_id"])


def o_incremental_watermark(spark, root):
    rows = read_table(spark, root, "raw_fixtures").select("fixture_id", "api_fixture_id", "created_at", "updated_at")
    return upsert.newer_than(rows, rows.filter(F.col("created_at") < _cut()), "updated_at")


def o_build_incremental(spark, root):
    """A further run of the staged fixtures: held are the deliveries before the cut, new those after the largest update held."""
    rows = read_table(spark, root, "raw_fixtures")
    held = Warehouse(spark, root, AS_OF, raw_fixtures=rows.filter(F.col("created_at") < _cut())).ref("stg_raw_fixtures")
    return warehouse(spark, root).next_run("stg_raw_fixtures", held)


def o_kickoff_correction(spark, root):
    old, batch = _deliveries(spark, root)
    return upsert.moved_kickoffs(_newest(batch), old, "api_fixture_id", "kickoff_utc", "fixture_status")


def o_point_update(spark, root):
    old, batch = _deliveries(spark, root)
    moved = upsert.moved_kickoffs(_newest(batch), old, "api_fixture_id", "kickoff_utc", "fixture_status")
    changes = moved.select("api_fixture_id", F.col("new_kickoff_utc").alias("kickoff_utc"))
    return upsert.point_update(old, changes, ["api_fixture_id"], "kickoff_utc", _now()).select("api_fixture_id", "kickoff_utc", "updated_at")


def o_attach_keys(spark, root):
    old, batch = _deliveries(spark, root)
    bare = batch.select("api_fixture_id").distinct().withColumn("fixture_id", F.lit(None).cast("bigint"))
    return upsert.attach_keys(bare, old, "api_fixture_id", "fixture_id")


def _stale(spark, root):
    w = warehouse(spark, root)
    return stale_fixtures(w.ref("stg_raw_fixtures"), w.ref("stg_dim_leagues"), w.ref("stg_dim_league_seasons"), _now())


def o_stale_fixtures(spark, root):
    return _stale(spark, root).select("fixture_id", "api_fixture_id").distinct()


def o_earliest_missing(spark, root):
    return earliest_missing(_stale(spark, root))


def o_pending_work(spark, root):
    return pending_seasons(*(read_table(spark, root, t) for t in ("dim_league_seasons", "dim_leagues", "dim_countries")))


def o_mark_done(spark, root):
    seasons = read_table(spark, root, "dim_league_seasons")
    loaded = read_table(spark, root, "raw_fixtures").select("api_league_id", "season").distinct()
    leagues = read_table(spark, root, "dim_leagues").select("league_id", "api_league_id")
    done = seasons.select("league_season_id", "league_id", "season").join(leagues, "league_id").join(loaded, ["api_league_id", "season"], "left_semi")
    marked = upsert.mark_done(seasons, done, ["league_season_id"], "fixtures_bootstrap_done", "fixtures_bootstrap_at", _now())
    return marked.select("league_season_id", "fixtures_bootstrap_done", "fixtures_bootstrap_at")


def q_checks(spark, root):
    names = {c.table for c in quality.CHECKS}
    return quality.run_checks({n: read_table(spark, root, n) for n in names}, quality.CHECKS)


def q_model_checks(spark, root):
    """The tests declared for the models, over models that are built first, as after a run."""
    w = warehouse(spark, root)
    names = {n for c in quality.MODEL_CHECKS for n in (c.table, c.parent) if n}
    built = ["int_league_context", "dim_team_standings", "fact_team_fixtures", "fact_team_streak_suppression", *names]
    w.build(new_shared_path(spark, "models"), [n for n in w.names() if n in built])
    return quality.run_checks({n: w.ref(n) for n in names}, quality.MODEL_CHECKS)


def q_not_null(spark, root):
    return quality.not_null(read_table(spark, root, "raw_fixtures"), "home_team_id").select("fixture_id", "api_fixture_id")


def q_unique(spark, root):
    return quality.unique(read_table(spark, root, "raw_fixtures"), "api_fixture_id")


def q_accepted_values(spark, root):
    return quality.accepted_values(read_table(spark, root, "raw_fixtures"), "home_fulltime_result", ["win", "draw", "loss"]).select("fixture_id", "home_fulltime_result")


def q_relationships(spark, root):
    fixtures, teams = read_table(spark, root, "raw_fixtures"), read_table(spark, root, "dim_teams")
    return quality.relationships(fixtures, "home_team_id", teams, "api_team_id").select("fixture_id", "home_team_id")


def q_future_finished(spark, root):
    rows = warehouse(spark, root).ref("stg_raw_fixtures")
    return quality.expression(rows, F.col("is_played") & (F.col("kickoff_utc") > _cut())).select("fixture_id", "api_fixture_id", "kickoff_utc", "fixture_status")


def q_freshness(spark, root):
    tables = ["raw_fixtures", "raw_league_standings", "dim_teams", "dim_leagues"]
    parts = [quality.freshness(read_table(spark, root, t), "updated_at", _now()).withColumn("table_name", F.lit(t)) for t in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def nested_fixture(with_parts=None):
    """A fixture's row as the service nests it; ``with_parts`` gives conditions by part, which is null where they fail."""
    parts = with_parts or {}

    def pair(a: str, b: str, names=("home", "away")):
        return F.struct(F.col(a).alias(names[0]), F.col(b).alias(names[1]))

    def team(side: str):
        return F.struct(F.col(f"{side}_team_id").alias("id"), F.col(f"{side}_team_name").alias("name"))

    def part(name: str, value):
        return (F.when(parts[name], value) if name in parts else value).alias(name)

    when = F.date_format("kickoff_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.struct(
        part("fixture", F.struct(F.col("api_fixture_id").alias("id"), when.alias("date"), F.struct(F.col("fixture_status").alias("short")).alias("status"))),
        part("league", F.struct(F.col("api_league_id").alias("id"), "season")),
        part("teams", F.struct(team("home").alias("home"), team("away").alias("away"))),
        part("score", F.struct(pair("home_team_halftime_goal", "away_team_halftime_goal").alias("halftime"), pair("home_team_fulltime_goal", "away_team_fulltime_goal").alias("fulltime"))),
    )


def parsed(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.from_json("body", FIXTURE_PAYLOAD).alias("p")).select("p.*")


def o_flatten_fixtures(spark, root):
    """Fixtures as the service nests them, written to JSON, parsed and made flat again."""
    rows = warehouse(spark, root).ref("stg_raw_fixtures")
    return flatten_fixtures(parsed(rows.select(F.to_json(nested_fixture()).alias("body"))))[0]


def o_rejected_payloads(spark, root):
    """Payloads without teams where a team is unknown, and without score where there are no goals: why each is rejected."""
    rows = warehouse(spark, root).ref("stg_raw_fixtures")
    known = {"teams": F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull(), "score": F.col("home_team_fulltime_goal").isNotNull()}
    rejected = flatten_fixtures(parsed(rows.select(F.to_json(nested_fixture(known)).alias("body"))))[1]
    return rejected.select(F.col("fixture.id").alias("api_fixture_id"), "reason")


def o_flatten_standings(spark, root):
    """Standings nested by league season, two lists deep, and made flat again."""
    rows = warehouse(spark, root).ref("stg_raw_league_standings")
    goals = F.struct(F.col("goals_for").alias("for"), F.col("goals_against").alias("against")).alias("goals")
    record = F.struct(F.col("games_played").alias("played"), F.col("wins").alias("win"), F.col("draws").alias("draw"), F.col("losses").alias("lose"), goals)
    line = F.struct(
        F.struct(F.col("api_team_id").alias("id"), F.col("team_name").alias("name")).alias("team"),
        "rank",
        "points",
        F.col("goal_diff").alias("goalsDiff"),
        "form",
        record.alias("all"),
    )
    nested = rows.groupBy("league_season_id").agg(F.struct(F.array(F.collect_list(line)).alias("standings")).alias("league"))
    return flatten_standings(nested)


def o_props_parse(spark, root):
    events = read_table(spark, root, "events")
    parsed = events.select("event_type", F.from_json("props", "k int").k.alias("k"))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


def o_event_islands(spark, root):
    events = read_table(spark, root, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").cast("int").alias("flag"))
    return islands(events, ["user_id"], ["ts", "event_id"], "flag").select("event_id", "user_id", "rn", "island", "streak_length")


def o_trigrams(spark, root):
    return trigrams(read_table(spark, root, "dim_teams"), ["team_id"], "team_name")


def o_search_trigrams(spark, root):
    """The trigrams of the search table: teams and leagues by ``name_lc``."""
    return trigrams(warehouse(spark, root).ref("mart_dim_search"), ["entity_type", "entity_id"], "name_lc")


def o_numbered(spark, root):
    return upsert.numbered(read_table(spark, root, "dim_venue").select("venue_name", "venue_id"), ["venue_name", "venue_id"], "n")


def o_team_functions(spark, root):
    teams = read_table(spark, root, "dim_teams")
    return teams.select(
        "team_id",
        title_words("team_name").alias("title"),
        slugify("team_name", "team_id").alias("slug"),
        pair_key("team_id", "api_team_id").alias("pair"),
        safe_int("team_code").alias("code_number"),
        F.md5(F.concat_ws("::", F.col("team_id").cast("string"), "team_name")).alias("digest"),
        array_text(F.array("team_code", F.lit(None).cast("string"))).alias("codes"),
    )


def o_season_labels(spark, root):
    return read_table(spark, root, "dim_league_seasons").select("league_season_id", season_label("season").alias("label"), F.year("start_date").alias("start_year"))


def o_results(spark, root):
    rows = warehouse(spark, root).ref("stg_raw_fixtures")
    home, away = "home_team_fulltime_goal", "away_team_fulltime_goal"
    text = F.date_format("kickoff_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        "api_fixture_id",
        result_of(home, away).alias("home_result"),
        result_of(away, home).alias("away_result"),
        letter_of(result_of(home, away)).alias("letter"),
        utc_instant(text).alias("kickoff"),
        utc_instant("fixture_status").alias("unreadable"),
    )


def m_mart_fixture_page_context(spark, root):
    w = warehouse(spark, root)
    first = w.ref("mart_fixture_info").agg(F.min("fixture_id").alias("f")).first()["f"]
    return mart_fixture_page_context(w, first if first is not None else -1)


def m_mart_team_page_context(spark, root):
    w = warehouse(spark, root)
    first = w.ref("mart_team_streaks").agg(F.min("team_id").alias("t")).first()["t"]
    return mart_team_page_context(w, first if first is not None else -1)


_RUNS = [
    o_dedupe_last_wins,
    o_dedupe_last_non_null,
    o_duplicate_keys,
    o_upsert_coalesce,
    o_update_if_changed,
    o_insert_absent,
    o_partition_replace,
    o_upsert_last_wins,
    o_incremental_watermark,
    o_build_incremental,
    o_kickoff_correction,
    o_point_update,
    o_attach_keys,
    o_stale_fixtures,
    o_earliest_missing,
    o_pending_work,
    o_mark_done,
    q_checks,
    q_model_checks,
    q_not_null,
    q_unique,
    q_accepted_values,
    q_relationships,
    q_future_finished,
    q_freshness,
    o_flatten_fixtures,
    o_rejected_payloads,
    o_flatten_standings,
    o_props_parse,
    o_event_islands,
    o_trigrams,
    o_search_trigrams,
    o_numbered,
    o_team_functions,
    o_season_labels,
    o_results,
    m_mart_fixture_page_context,
    m_mart_team_page_context,
]
QUERIES = {f.__name__: f for f in _RUNS}

_COLS = ", ".join(_FIXTURE)
_NEWEST = "row_number() OVER (PARTITION BY api_fixture_id ORDER BY updated_at DESC, fixture_id DESC)"
_SPLIT = f"""old AS (SELECT {_COLS} FROM (SELECT *, {_NEWEST} AS rn FROM raw_fixtures WHERE created_at < {_CUT_SQL}) WHERE rn = 1),
batch AS (SELECT {_COLS} FROM raw_fixtures WHERE created_at >= {_CUT_SQL}),
fresh AS (SELECT {_COLS} FROM (SELECT *, {_NEWEST} AS rn FROM batch) WHERE rn = 1)"""
_LAST_VALUE = "last({0} ORDER BY updated_at, fixture_id) FILTER (WHERE {0} IS NOT NULL) AS {0}"
_MOVED = """moved AS (SELECT f.api_fixture_id, o.kickoff_utc AS old_kickoff_utc, f.kickoff_utc AS new_kickoff_utc FROM fresh f JOIN old o ON o.api_fixture_id = f.api_fixture_id
WHERE f.kickoff_utc IS DISTINCT FROM o.kickoff_utc AND o.fixture_status <> 'FT')"""
_STALE = f"""SELECT DISTINCT r.fixture_id, r.api_fixture_id, r.kickoff_utc, s.league_season_id, l.api_league_id, s.season FROM stg_raw_fixtures r
JOIN stg_dim_leagues l ON l.api_league_id = r.api_league_id JOIN stg_dim_league_seasons s ON s.league_id = l.league_id AND s.season = r.season
WHERE s.is_current AND r.kickoff_utc < {_NOW_SQL} - INTERVAL 2 HOUR AND (r.home_team_fulltime_goal IS NULL OR r.away_team_fulltime_goal IS NULL)"""


def _result(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 'win' WHEN {a} = {b} THEN 'draw' WHEN {a} < {b} THEN 'loss' END"


def _check_sql(c: quality.Check) -> str:
    head = f"SELECT '{c.table}' AS table_name, '{c.column}' AS column_name, '{c.kind}' AS kind, "
    if c.kind == "not_null":
        return head + f"count(*) FILTER (WHERE {c.column} IS NULL) AS violations FROM {c.table}"
    if c.kind == "accepted_values":
        return head + f"count(*) FILTER (WHERE {c.column} NOT IN ({', '.join(repr(v) for v in c.values)})) AS violations FROM {c.table}"
    if c.kind == "unique":
        return head + f"count(*) AS violations FROM (SELECT 1 FROM {c.table} WHERE {c.column} IS NOT NULL GROUP BY {c.column} HAVING count(*) > 1)"
    return head + f"count(*) AS violations FROM {c.table} x WHERE x.{c.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {c.parent} p WHERE p.{c.parent_column} = x.{c.column})"


def _fresh_sql(table: str) -> str:
    return f"""SELECT '{table}' AS table_name, newest, CAST(floor((epoch_us({_NOW_SQL}) - epoch_us(newest)) / 3600000000.0) AS BIGINT) AS age_hours,
CASE WHEN newest IS NULL OR {_NOW_SQL} - newest > INTERVAL 48 HOUR THEN 'error' WHEN {_NOW_SQL} - newest > INTERVAL 24 HOUR THEN 'warn' ELSE 'pass' END AS state
FROM (SELECT max(updated_at) AS newest FROM {table})"""


_PAGE_LIST = "coalesce(max(fixtures_json) FILTER (team_id = {0}_team_id AND context_scope = '{1}'), 'null')"
_PAGE_SIDE = "max(team_id) FILTER (team_id = {0}_team_id) AS {0}_id, max(team_name) FILTER (team_id = {0}_team_id) AS {0}_name, {1} AS {0}_all, {2} AS {0}_own"
_PAGE_JSON = "'\"{0}\":' || replace(CAST(json_object('team_id', {0}_id, 'team_name', {0}_name) AS VARCHAR), '}}', '') || ',\"overall\":' || {0}_all || ',\"{0}\":' || {0}_own || '}}'"
_CARD = "json_object('event_name', event_name, 'count', streak_length, 'total', NULL, 'scope', CASE scope WHEN 'all' THEN 'overall' ELSE scope END, 'polarity', polarity)"

ORACLES = {
    "o_dedupe_last_wins": f"SELECT {_COLS} FROM (SELECT *, {_NEWEST} AS rn FROM raw_fixtures) WHERE rn = 1",
    "o_dedupe_last_non_null": f"SELECT api_fixture_id, {', '.join(_LAST_VALUE.format(c) for c in ['fixture_id', 'updated_at', *_DATA])} FROM raw_fixtures GROUP BY api_fixture_id",
    "o_duplicate_keys": "SELECT api_fixture_id, count(*) AS n_rows FROM raw_fixtures GROUP BY 1 HAVING count(*) > 1",
    "o_upsert_coalesce": f"""WITH {_SPLIT}, b AS (SELECT api_fixture_id, {', '.join(_LAST_VALUE.format(c) for c in _FIXTURE if c != 'api_fixture_id')} FROM batch GROUP BY 1)
SELECT coalesce(o.api_fixture_id, b.api_fixture_id) AS api_fixture_id, {', '.join(f'CASE WHEN o.api_fixture_id IS NULL THEN b.{c} ELSE o.{c} END AS {c}' for c in ('fixture_id', 'api_league_id', 'season', 'created_at'))},
{', '.join(f'coalesce(b.{c}, o.{c}) AS {c}' for c in _DATA)},
CASE WHEN o.api_fixture_id IS NOT NULL AND b.api_fixture_id IS NOT NULL THEN {_NOW_SQL} ELSE coalesce(o.updated_at, b.updated_at) END AS updated_at
FROM old o FULL JOIN b ON b.api_fixture_id = o.api_fixture_id""",
    "o_update_if_changed": f"""WITH b AS (SELECT api_team_id, last(team_name ORDER BY updated_at, created_at, team_name) AS team_name FROM raw_league_standings WHERE team_name IS NOT NULL GROUP BY 1)
SELECT coalesce(t.api_team_id, b.api_team_id) AS api_team_id, t.team_id, CASE WHEN t.api_team_id IS NULL OR b.team_name <> t.team_name THEN b.team_name ELSE t.team_name END AS team_name,
CASE WHEN t.api_team_id IS NULL OR b.team_name <> t.team_name THEN {_NOW_SQL} ELSE t.updated_at END AS updated_at FROM dim_teams t FULL JOIN b ON b.api_team_id = t.api_team_id""",
    "o_insert_absent": """WITH seen AS (SELECT id, max(name) AS name FROM (SELECT home_team_id AS id, home_team_name AS name FROM raw_fixtures UNION ALL SELECT away_team_id, away_team_name FROM raw_fixtures) WHERE id IS NOT NULL GROUP BY id)
SELECT team_id, api_team_id, team_name FROM dim_teams UNION ALL
SELECT (SELECT max(team_id) FROM dim_teams) + row_number() OVER (ORDER BY id), id, name FROM seen WHERE id NOT IN (SELECT api_team_id FROM dim_teams)""",
    "o_partition_replace": f"""WITH {_SPLIT} SELECT fixture_id, api_fixture_id, api_league_id, season, updated_at FROM old o
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.api_league_id = o.api_league_id AND f.season = o.season) UNION ALL SELECT fixture_id, api_fixture_id, api_league_id, season, updated_at FROM fresh""",
    "o_upsert_last_wins": f"WITH {_SPLIT} SELECT * FROM old WHERE api_fixture_id NOT IN (SELECT api_fixture_id FROM fresh) UNION ALL SELECT * FROM fresh",
    "o_incremental_watermark": f"""SELECT fixture_id, api_fixture_id, created_at, updated_at FROM raw_fixtures
WHERE updated_at > (SELECT max(updated_at) FROM raw_fixtures WHERE created_at < {_CUT_SQL})""",
    "o_build_incremental": f"""WITH held AS (SELECT * EXCLUDE (rn), fixture_status = 'FT' AS is_played FROM (SELECT *, {_NEWEST} AS rn FROM raw_fixtures WHERE created_at < {_CUT_SQL}) WHERE rn = 1),
later AS (SELECT * EXCLUDE (rn), fixture_status = 'FT' AS is_played FROM (SELECT *, {_NEWEST} AS rn FROM raw_fixtures WHERE updated_at > (SELECT max(updated_at) FROM held)) WHERE rn = 1)
SELECT * FROM later UNION ALL SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.api_fixture_id = h.api_fixture_id)""",
    "o_kickoff_correction": f"WITH {_SPLIT}, {_MOVED} SELECT * FROM moved",
    "o_point_update": f"""WITH {_SPLIT}, {_MOVED} SELECT o.api_fixture_id, CASE WHEN m.api_fixture_id IS NOT NULL THEN m.new_kickoff_utc ELSE o.kickoff_utc END AS kickoff_utc,
CASE WHEN m.api_fixture_id IS NOT NULL THEN {_NOW_SQL} ELSE o.updated_at END AS updated_at FROM old o LEFT JOIN moved m ON m.api_fixture_id = o.api_fixture_id""",
    "o_attach_keys": f"WITH {_SPLIT} SELECT f.api_fixture_id, o.fixture_id FROM fresh f LEFT JOIN old o ON o.api_fixture_id = f.api_fixture_id",
    "o_stale_fixtures": chain(f"SELECT DISTINCT fixture_id, api_fixture_id FROM ({_STALE})"),
    "o_earliest_missing": chain(f"""SELECT league_season_id, api_league_id, season, CAST(min(kickoff_utc) AT TIME ZONE 'UTC' AS DATE) AS from_date
FROM ({_STALE}) GROUP BY league_season_id, api_league_id, season"""),
    "o_pending_work": """SELECT c.country_name, l.league_name, l.api_league_id, CAST(year(s.start_date) AS INTEGER) AS season_year, s.league_season_id
FROM dim_league_seasons s JOIN dim_leagues l ON l.league_id = s.league_id JOIN dim_countries c ON c.country_id = l.country_id WHERE NOT s.fixtures_bootstrap_done""",
    "o_mark_done": f"""WITH hit AS (SELECT DISTINCT s.league_season_id FROM dim_league_seasons s JOIN dim_leagues l ON l.league_id = s.league_id JOIN raw_fixtures r ON r.api_league_id = l.api_league_id AND r.season = s.season)
SELECT s.league_season_id, h.league_season_id IS NOT NULL OR s.fixtures_bootstrap_done AS fixtures_bootstrap_done,
CASE WHEN h.league_season_id IS NOT NULL THEN {_NOW_SQL} ELSE s.fixtures_bootstrap_at END AS fixtures_bootstrap_at FROM dim_league_seasons s LEFT JOIN hit h ON h.league_season_id = s.league_season_id""",
    "q_checks": "\nUNION ALL ".join(map(_check_sql, quality.CHECKS)),
    "q_model_checks": chain("\nUNION ALL ".join(map(_check_sql, quality.MODEL_CHECKS))),
    "q_not_null": "SELECT fixture_id, api_fixture_id FROM raw_fixtures WHERE home_team_id IS NULL",
    "q_unique": "SELECT api_fixture_id, count(*) AS n_rows FROM raw_fixtures GROUP BY 1 HAVING count(*) > 1",
    "q_accepted_values": "SELECT fixture_id, home_fulltime_result FROM raw_fixtures WHERE home_fulltime_result NOT IN ('win', 'draw', 'loss')",
    "q_relationships": "SELECT fixture_id, home_team_id FROM raw_fixtures WHERE home_team_id IS NOT NULL AND home_team_id NOT IN (SELECT api_team_id FROM dim_teams)",
    "q_future_finished": chain(f"SELECT fixture_id, api_fixture_id, kickoff_utc, fixture_status FROM stg_raw_fixtures WHERE is_played AND kickoff_utc > {_CUT_SQL}"),
    "q_freshness": "\nUNION ALL ".join(map(_fresh_sql, ["raw_fixtures", "raw_league_standings", "dim_teams", "dim_leagues"])),
    "o_flatten_fixtures": chain(f"""SELECT api_fixture_id, api_league_id, season, kickoff_utc, fixture_status, home_team_id, home_team_name, away_team_id, away_team_name,
home_team_halftime_goal, away_team_halftime_goal, home_team_fulltime_goal, away_team_fulltime_goal,
{_result('home_team_fulltime_goal', 'away_team_fulltime_goal')} AS home_fulltime_result, {_result('away_team_fulltime_goal', 'home_team_fulltime_goal')} AS away_fulltime_result,
{_result('home_team_halftime_goal', 'away_team_halftime_goal')} AS home_halftime_result, {_result('away_team_halftime_goal', 'home_team_halftime_goal')} AS away_halftime_result FROM stg_raw_fixtures"""),
    "o_rejected_payloads": chain("""SELECT api_fixture_id, 'missing ' || concat_ws(',', CASE WHEN home_team_id IS NULL OR away_team_id IS NULL THEN 'teams' END, CASE WHEN home_team_fulltime_goal IS NULL THEN 'score' END) AS reason
FROM stg_raw_fixtures WHERE home_team_id IS NULL OR away_team_id IS NULL OR home_team_fulltime_goal IS NULL"""),
    "o_flatten_standings": chain("""SELECT league_season_id, api_team_id, team_name, rank, points, games_played, wins, draws, losses, goals_for, goals_against, goal_diff, form FROM stg_raw_league_standings"""),
    "o_props_parse": """SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS INTEGER)) AS BIGINT) AS k_sum, max(CAST(props->>'k' AS INTEGER)) AS k_max FROM events GROUP BY event_type""",
    "o_event_islands": """WITH f AS (SELECT event_id, user_id, ts, CAST(event_type = 'purchase' AS INTEGER) AS flag FROM events),
n AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rn, lag(flag, 1, 0) OVER w AS prev FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(CASE WHEN flag = 1 AND prev = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n)
SELECT event_id, user_id, rn, island, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY rn) AS INTEGER) AS streak_length FROM i""",
    "o_trigrams": r"""WITH w AS (SELECT team_id, '  ' || unnest(regexp_extract_all(lower(team_name), '[\p{L}\p{N}]+')) || ' ' AS p FROM dim_teams)
SELECT DISTINCT team_id, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS trigram FROM w""",
    "o_search_trigrams": chain(r"""SELECT DISTINCT entity_type, entity_id, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS trigram
FROM (SELECT entity_type, entity_id, '  ' || unnest(regexp_extract_all(name_lc, '[\p{L}\p{N}]+')) || ' ' AS p FROM mart_dim_search)"""),
    "o_numbered": "SELECT venue_name, venue_id, row_number() OVER (ORDER BY venue_name, venue_id) AS n FROM dim_venue",
    "o_team_functions": r"""SELECT team_id, array_to_string(list_transform(regexp_extract_all(lower(team_name), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda x: upper(x[1]) || x[2:]), '') AS title,
lower(regexp_replace(team_name, '\s+', '-', 'g')) || '-' || team_id AS slug, least(team_id, api_team_id) || '_' || greatest(team_id, api_team_id) AS pair,
TRY_CAST(team_code AS INTEGER) AS code_number, md5(team_id || '::' || team_name) AS digest, '{' || coalesce(team_code, 'NULL') || ',NULL}' AS codes FROM dim_teams""",
    "o_season_labels": "SELECT league_season_id, season || '/' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS label, CAST(year(start_date) AS INTEGER) AS start_year FROM dim_league_seasons",
    "o_results": chain(f"""SELECT api_fixture_id, {_result('home_team_fulltime_goal', 'away_team_fulltime_goal')} AS home_result, {_result('away_team_fulltime_goal', 'home_team_fulltime_goal')} AS away_result,
CASE WHEN home_team_fulltime_goal > away_team_fulltime_goal THEN 'W' WHEN home_team_fulltime_goal = away_team_fulltime_goal THEN 'D' WHEN home_team_fulltime_goal < away_team_fulltime_goal THEN 'L' END AS letter,
date_trunc('second', kickoff_utc) AS kickoff, CAST(NULL AS TIMESTAMPTZ) AS unreadable FROM stg_raw_fixtures"""),
    "m_mart_fixture_page_context": chain(f"""SELECT f.fixture_id, f.team_pair_key, f.home_team_id, f.away_team_id, f.fixture_slug, f.fixture_info_json, s.fixture_streaks_json,
h.h2h_info_json, h.h2h_streaks_json, h.h2h_matches_json, h.h2h_context_scopes_json, coalesce(p.team_fixtures_json, '{{"home":{{"team_id":null,"team_name":null,"overall":null,"home":null}},"away":{{"team_id":null,"team_name":null,"overall":null,"away":null}}}}') AS team_fixtures_json
FROM (SELECT * FROM mart_fixture_info WHERE fixture_id = (SELECT min(fixture_id) FROM mart_fixture_info)) f
LEFT JOIN (SELECT fixture_id, CAST(json_object('home', to_json(list({_CARD} ORDER BY streak_length DESC, event_name, scope) FILTER (team_id = home_team_id)),
  'away', to_json(list({_CARD} ORDER BY streak_length DESC, event_name, scope) FILTER (team_id = away_team_id))) AS VARCHAR) AS fixture_streaks_json FROM mart_fixture_streaks GROUP BY fixture_id) s ON s.fixture_id = f.fixture_id
LEFT JOIN mart_head_to_head_info h ON h.current_fixture_id = f.fixture_id
LEFT JOIN (SELECT fixture_id, '{{' || {_PAGE_JSON.format('home')} || ',' || {_PAGE_JSON.format('away')} || '}}' AS team_fixtures_json FROM (
  SELECT i.fixture_id, {_PAGE_SIDE.format('home', _PAGE_LIST.format('home', 'overall'), _PAGE_LIST.format('home', 'home'))},
    {_PAGE_SIDE.format('away', _PAGE_LIST.format('away', 'overall'), _PAGE_LIST.format('away', 'away'))}
  FROM mart_fixture_info i JOIN mart_team_fixture t ON t.team_id IN (i.home_team_id, i.away_team_id) GROUP BY i.fixture_id)) p ON p.fixture_id = f.fixture_id"""),
    "m_mart_team_page_context": chain("""SELECT t.team_id, t.team_name, t.team_slug, t.rank, t.form, l.league_name, l.season_label, l.country_name, p.league_teams_json, s.streaks_json,
t.next_fixture_id, t.next_opponent_id, t.next_opponent_name, t.next_is_home, t.next_kickoff_utc
FROM (SELECT * FROM mart_team_info WHERE team_id = (SELECT min(team_id) FROM mart_team_streaks)) t
LEFT JOIN mart_league_info l ON l.league_season_id = t.league_season_id
LEFT JOIN (SELECT league_season_id, CAST(to_json(list(json_object('teamId', team_id, 'name', team_name, 'teamHref', team_slug, 'logoFileId', logo_file_id) ORDER BY team_rank NULLS LAST, team_id)) AS VARCHAR) AS league_teams_json
  FROM mart_league_teams WHERE team_id <> (SELECT min(team_id) FROM mart_team_streaks) GROUP BY league_season_id) p ON p.league_season_id = t.league_season_id
LEFT JOIN (SELECT team_id, CAST(to_json(list(json_object('teamId', team_id, 'streakId', streak_id, 'eventName', event_name, 'streakType', streak_type, 'streakLength', streak_length, 'polarity', polarity, 'scope', scope)
  ORDER BY streak_length DESC, event_name, scope)) AS VARCHAR) AS streaks_json FROM mart_team_streaks GROUP BY team_id) s ON s.team_id = t.team_id"""),
}
