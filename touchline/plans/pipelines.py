"""Loads end to end: full, incremental, corrections, standings, metadata and replay."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import upsert
from touchline.operators.shapes import flatten_fixtures, flatten_metadata, flatten_standings
from touchline.schemas import FIXTURE_PAYLOAD, LEAGUE_PAYLOAD, STANDINGS_PAYLOAD, TEAM_PAYLOAD
from touchline.session import materialise, scratched
from touchline.sources import api, landing


#: Tables that the loads publish and the models read; ratings come from outside.
SOURCES = ["raw_fixtures", "raw_league_standings", "dim_countries", "dim_leagues", "dim_league_seasons", "dim_venue", "dim_teams", "elo_rating"]


@dataclass(frozen=True)
class Config:
    """Settings of an installation, with typed defaults."""

    root: str
    warehouse: str
    base: str = ""
    folder: str = ""
    headers: str = "{}"
    first_season: int = 2020
    look: int = 11
    lanes: int = 1

    def transport(self) -> dict[str, str]:
        where = {"folder": self.folder} if self.folder else {"base": self.base, "headers": self.headers}
        return where | {"lanes": str(self.lanes)}

    @classmethod
    def from_environment(cls, prefix: str = "TOUCHLINE_", **given: str) -> Config:
        """Settings from variables named by ``prefix`` and the field in capitals; what is no number keeps its default."""
        values = {}
        for f in fields(cls):
            text = given.get(f.name) or os.environ.get(prefix + f.name.upper())
            if text is not None and f.type in (int, "int"):
                text = int(text) if str(text).strip().isdigit() else None
            if text is not None:
                values[f.name] = text
        return cls(**values)


def _at(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def pending_seasons(seasons: DataFrame, leagues: DataFrame, countries: DataFrame) -> DataFrame:
    """League seasons not loaded yet: country_name, league_name, api_league_id, season_year, league_season_id."""
    todo = seasons.filter(~F.col("fixtures_bootstrap_done"))
    joined = todo.join(leagues.select("league_id", "country_id", "league_name", "api_league_id"), "league_id").join(countries.select("country_id", "country_name"), "country_id")
    return joined.select("country_name", "league_name", "api_league_id", F.year("start_date").alias("season_year"), "league_season_id")


def stale_fixtures(fixtures: DataFrame, leagues: DataFrame, seasons: DataFrame, now: Column) -> DataFrame:
    """Fixtures of current seasons that began over two hours ago and lack goals.

    ``seasons`` has league_season_id, league_id, season and is_current.
    """
    late = (F.col("kickoff_utc") < now - F.expr("interval 2 hours")) & (
        F.col("home_team_fulltime_goal").isNull() | F.col("away_team_fulltime_goal").isNull()
    )
    current = seasons.filter("is_current").join(leagues.select("league_id", "api_league_id"), "league_id").select("api_league_id", "season", "league_season_id")
    return fixtures.filter(late).join(current, ["api_league_id", "season"])


def earliest_missing(stale: DataFrame) -> DataFrame:
    """The first day without a result of each league season, from ``stale_fixtures``."""
    groups = stale.groupBy("league_season_id", "api_league_id", "season")
    return groups.agg(F.min("kickoff_utc").cast("date").alias("from_date"))


def fetch(spark: SparkSession, config: Config, requests: list[dict], pipeline: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(flat fixtures, failed requests with their error) of many requests, each made once.

    Failed requests and rejected payloads are kept in ``landing.failures``.
    """
    rows = materialise(api.read_api(spark, "/fixtures", requests, **config.transport()), "answers")
    body = F.from_json("body", FIXTURE_PAYLOAD).alias("p")
    flat, rejected = flatten_fixtures(rows.filter(F.col("error").isNull()).select("request", "body", body).select("request", "body", "p.*"))
    failed = rows.filter(F.col("error").isNotNull())
    entries = failed.select("request", "error", "body").unionByName(rejected.select("request", F.col("reason").alias("error"), "body"))
    landing.put_failures(entries.withColumns({"pipeline": F.lit(pipeline), "timestamp": F.lit(now.isoformat())}), config.root)
    return flat, failed.select("request", "error")


@scratched
def full_load(spark: SparkSession, config: Config, ds: str, now: datetime) -> dict[str, int]:
    """Pending league seasons: fetched, landed, loaded by replacing their partitions, marked done.

    A season with no answer goes to the dead letters and stays pending. The work list is one row
    per league season, a small table that the driver may hold. Returns the numbers of units pending,
    loaded and failed (of these skipped: answered with nothing), and of fixtures extracted and loaded.
    """
    seasons, fixtures = landing.current(spark, config.warehouse, "dim_league_seasons"), landing.current(spark, config.warehouse, "raw_fixtures")
    work = pending_seasons(seasons, landing.current(spark, config.warehouse, "dim_leagues"), landing.current(spark, config.warehouse, "dim_countries")).collect()
    if not work:
        return {"pending": 0, "loaded": 0, "failed": 0, "skipped": 0, "extracted": 0, "fixtures": 0}
    flat, failed = fetch(spark, config, [{"league": r["api_league_id"], "season": r["season_year"]} for r in work], "full_load", now)
    path = landing.land_fixtures(flat, config.root, ds)
    landed = landing.read_landed(spark, path).filter(F.col("ds") == ds)
    counts = landed.groupBy("api_league_id", "season").agg(F.count(F.lit(1)).alias("n")).collect()
    got = {(r[0], r[1]): r[2] for r in counts}
    done = [r["league_season_id"] for r in work if (r["api_league_id"], r["season_year"]) in got]
    lost = [r for r in work if r["league_season_id"] not in set(done)]
    errors = dict(map(tuple, failed.collect())) if lost else {}
    skipped = _dead_letters(spark, config, lost, errors, ds, now)
    count = load(spark, config, landed.drop("league", "season_year", "ds"), fixtures, ["api_league_id", "season"], now) if got else 0
    marked = spark.createDataFrame([(k,) for k in done], "league_season_id bigint")
    landing.publish(upsert.mark_done(seasons, marked, ["league_season_id"], "fixtures_bootstrap_done", "fixtures_bootstrap_at", _at(now)), config.warehouse, "dim_league_seasons")
    # skipped are units that answered with nothing
    return {"pending": len(work), "loaded": len(done), "failed": len(lost), "skipped": skipped, "extracted": sum(got.values()), "fixtures": count}


def _dead_letters(spark: SparkSession, config: Config, lost: list, errors: dict[str, str], ds: str, now: datetime) -> int:
    """Put lost units into the queue; the number of those whose request didn't fail."""
    asked = [json.dumps({"league": r["api_league_id"], "season": r["season_year"]}, sort_keys=True) for r in lost]
    if lost:
        rows = [(r["api_league_id"], r["season_year"], r["league_name"], ds, errors.get(a, "no fixtures"), "", now.isoformat()) for r, a in zip(lost, asked)]
        landing.put_dead_letters(spark.createDataFrame(rows, landing.DLQ_ENTRY), config.root)
    return sum(a not in errors for a in asked)


def load(spark: SparkSession, config: Config, landed: DataFrame, fixtures: DataFrame, partition: list[str], now: datetime) -> int:
    """Replace the partitions that ``landed`` has by its rows, with new ids, and publish."""
    kept = fixtures.join(landed.select(*partition).distinct(), partition, "left_anti")
    top = fixtures.agg(F.max("fixture_id").alias("m")).first()["m"] or 0
    rows = upsert.numbered(landed, ["api_fixture_id"], "fixture_id", top).withColumns({"created_at": _at(now), "updated_at": _at(now)})
    new = materialise(upsert.normalise(rows, fixtures), "loaded")
    landing.publish(kept.unionByName(new), config.warehouse, "raw_fixtures")
    return new.count()


def apply_updates(fixtures: DataFrame, updates: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """The fixtures after a batch: copies merged field by field, ids attached, nulls kept from clearing."""
    merged = upsert.dedupe_last_non_null(updates, ["api_fixture_id"], order).filter(F.col("api_fixture_id").isNotNull())
    top = fixtures.agg(F.max("fixture_id").alias("m")).first()["m"] or 0
    new = merged.join(fixtures.select("api_fixture_id"), "api_fixture_id", "left_anti").select("api_fixture_id")
    ids = upsert.numbered(new, ["api_fixture_id"], "__tl_new_id", top)
    batch = merged.drop("fixture_id", "created_at", "updated_at").join(ids, "api_fixture_id", "left").withColumn("fixture_id", F.col("__tl_new_id"))
    stamped = batch.withColumns({"created_at": now, "updated_at": now})
    keep = {"fixture_id", "api_fixture_id", "created_at", "updated_at"}
    return upsert.coalesce_upsert(fixtures, stamped, ["api_fixture_id"], [c for c in fixtures.columns if c not in keep], now)


@scratched
def incremental_load(spark: SparkSession, config: Config, ds: str, now: datetime, mode: str = "ids", to_date: str | None = None, from_date: str | None = None) -> int:
    """Refresh stale fixtures, asked by ids or by dates of each league season; returns rows received."""
    fixtures = landing.current(spark, config.warehouse, "raw_fixtures")
    leagues, seasons = landing.current(spark, config.warehouse, "dim_leagues"), landing.current(spark, config.warehouse, "dim_league_seasons")
    stale = stale_fixtures(fixtures, leagues, _current(seasons, now), _at(now))
    if mode == "ids":
        requests = api.batches_of_ids([r[0] for r in stale.select("api_fixture_id").distinct().orderBy("api_fixture_id").toLocalIterator()])
    else:
        end = to_date or now.strftime("%Y-%m-%d")
        requests = [{"league": r["api_league_id"], "season": r["season"], "from": from_date or str(r["from_date"]), "to": end} for r in earliest_missing(stale).collect()]
    if not requests:
        return 0
    flat, _ = fetch(spark, config, requests, "incremental_load", now)
    path = landing.land_fixtures(flat, config.root, ds, full=False)
    landed = landing.read_landed(spark, path).filter(F.col("ds") == ds).drop("ds")
    landing.publish(apply_updates(fixtures, landed, _at(now), ["kickoff_utc"]), config.warehouse, "raw_fixtures")
    return landed.count()


def _current(seasons: DataFrame, now: datetime) -> DataFrame:
    """League seasons with ``is_current``: those whose dates hold today; one without dates isn't."""
    held = _at(now).cast("date").between(F.col("start_date"), F.col("end_date"))
    return seasons.withColumn("is_current", F.coalesce(held, F.lit(False)))


def _current_units(spark: SparkSession, config: Config, now: datetime) -> list:
    """(league_season_id, api_league_id, season) of the current seasons, in order."""
    seasons = _current(landing.current(spark, config.warehouse, "dim_league_seasons"), now).filter("is_current")
    leagues = landing.current(spark, config.warehouse, "dim_leagues").select("league_id", "api_league_id")
    return seasons.join(leagues, "league_id").select("league_season_id", "api_league_id", "season").orderBy("league_season_id").collect()


@scratched
def correct_kickoffs(spark: SparkSession, config: Config, now: datetime, mode: str = "both") -> int:
    """Compare the last and next fixtures of each league's current season with the service and move changed kickoffs."""
    fixtures = landing.current(spark, config.warehouse, "raw_fixtures")
    sides = {"missed": ["last"], "changed": ["next"], "both": ["last", "next"]}[mode]
    asked = [{"league": u["api_league_id"], "season": u["season"], side: config.look} for u in _current_units(spark, config, now) for side in sides]
    if not asked:
        return 0
    flat, _ = fetch(spark, config, asked, "correct_kickoffs", now)
    seen = upsert.dedupe_last_wins(flat.select("api_fixture_id", "kickoff_utc"), ["api_fixture_id"], ["kickoff_utc"])
    moved = upsert.moved_kickoffs(seen, fixtures, "api_fixture_id", "kickoff_utc", "fixture_status")
    changes = materialise(moved.filter(F.col("new_kickoff_utc").isNotNull()).select("api_fixture_id", F.col("new_kickoff_utc").alias("kickoff_utc")), "moved")
    n = changes.count()
    if n:
        landing.publish(upsert.point_update(fixtures, changes, ["api_fixture_id"], "kickoff_utc", _at(now)), config.warehouse, "raw_fixtures")
    return n


def fetch_standings(spark: SparkSession, config: Config, now: datetime) -> tuple[DataFrame, int]:
    """(payloads of STANDINGS_PAYLOAD of all current seasons, number of failed requests); of each answer the first element counts.

    Failed requests are kept in ``landing.failures``.
    """
    requests = {json.dumps({"league": u["api_league_id"], "season": u["season"]}, sort_keys=True): (u["league_season_id"],) for u in _current_units(spark, config, now)}
    body = STANDINGS_PAYLOAD.replace("league_season_id int,", "", 1)
    answers, failed = _ask(spark, config, "/standings", requests, "league_season_id bigint", body)
    rows = [("refresh_standings", r, e, None, now.isoformat()) for r, e in failed]
    if rows:
        landing.put_failures(spark.createDataFrame(rows, landing.FAILURE), config.root)
    first = answers.groupBy("league_season_id").agg(F.min_by("league", "pos").alias("league"))
    return first.select(F.col("league_season_id").cast("int").alias("league_season_id"), "league"), len(failed)


@scratched
def refresh_standings(spark: SparkSession, config: Config, now: datetime, payload: DataFrame | None = None) -> int:
    """Upsert the standings of all current seasons, the last row of a team and season counting.

    They are asked of the service, unless payloads of STANDINGS_PAYLOAD are given.
    """
    if payload is None:
        payload, _ = fetch_standings(spark, config, now)
    standings, seasons = landing.current(spark, config.warehouse, "raw_league_standings"), landing.current(spark, config.warehouse, "dim_league_seasons")
    leagues = landing.current(spark, config.warehouse, "dim_leagues").select("league_id", "api_league_id")
    context = seasons.join(leagues, "league_id").select(F.col("league_season_id").cast("int").alias("league_season_id"), "api_league_id", "season")
    rows = flatten_standings(payload).filter(F.col("api_team_id").isNotNull()).withColumn("pos", F.monotonically_increasing_id())
    last = upsert.dedupe_last_wins(rows, ["league_season_id", "api_team_id"], ["pos"]).drop("pos").join(context, "league_season_id")
    stamped = upsert.normalise(last.withColumns({"created_at": _at(now), "updated_at": _at(now)}), standings)
    landing.publish(upsert.replace_keys(standings, stamped, ["league_season_id", "api_team_id"]), config.warehouse, "raw_league_standings")
    return stamped.count()


def _ask(spark: SparkSession, config: Config, endpoint: str, requests: dict[str, tuple], context: str, payload: str) -> tuple[DataFrame, list[tuple]]:
    """(answers with the ``context`` of their request and their place, [(request, error)]), each request made once."""
    if not requests:
        return spark.createDataFrame([], f"{context}, pos bigint, {payload}"), []
    asked = spark.createDataFrame([(r, *values) for r, values in requests.items()], f"request string, {context}")
    rows = api.read_api(spark, endpoint, [json.loads(r) for r in requests], **config.transport())
    rows = materialise(rows.withColumn("pos", F.monotonically_increasing_id()), "answers")
    good = rows.filter(F.col("error").isNull()).join(asked, "request")
    failed = [tuple(r) for r in rows.filter(F.col("error").isNotNull()).select("request", "error").collect()]
    return good.select(*asked.drop("request").columns, "pos", F.from_json("body", payload).alias("p")).select("*", "p.*").drop("p"), failed


@scratched
def refresh_metadata(spark: SparkSession, config: Config, tree: DataFrame, now: datetime) -> dict:
    """Countries, leagues, seasons and teams of a config tree (``landing.read_config``), asked of the service.

    Each configured league is asked for by country and name, and the first answer counts; teams are
    asked for by league and season from ``config.first_season`` on. Countries are inserted where
    absent; leagues, seasons and teams are inserted, or updated where a value differs. Of several
    rows of a key the later one in the order of the config, the seasons and the answer comes last.
    All is fetched before anything is published. The config, and with it the leagues and seasons
    asked for, is small and held by the driver.

    Returns the numbers of countries, leagues, seasons and teams received, ``missing``, the
    (country, league) pairs without an answer, and ``failed``, the (request, error) pairs.
    """
    dims = {n: landing.current(spark, config.warehouse, n) for n in ("dim_countries", "dim_leagues", "dim_league_seasons", "dim_teams")}
    stamps = {"created_at": _at(now), "updated_at": _at(now)}
    held = [(r["country"], [lg["name"] for lg in r["leagues"] or []]) for r in tree.collect()]
    pairs = list(dict.fromkeys((c, lg) for c, names in held for lg in names))
    text = lambda **params: json.dumps(params, sort_keys=True)
    answers, failed = _ask(spark, config, "/leagues", {text(country=c, name=lg): (c, lg, i) for i, (c, lg) in enumerate(pairs)}, "country string, name string, place int", LEAGUE_PAYLOAD)
    earliest = answers.groupBy("country", "name").agg(F.min("pos").alias("pos"))
    # what several plans read is written, so that none of them holds the whole refresh
    first = materialise(answers.join(earliest, ["country", "name", "pos"]).filter(F.col("league.id").isNotNull()), "first")
    found = {(r["country"], r["name"]): r["place"] for r in first.select("country", "name", "place").collect()}

    listed = spark.createDataFrame([(c,) for c, _ in held], "country_name string").withColumns(stamps)
    countries = materialise(upsert.insert_absent(dims["dim_countries"], listed, ["country_name"], "country_id"), "countries")
    country_ids = countries.select(F.col("country_name").alias("country"), "country_id")

    named = first.join(country_ids, "country").select(F.col("league.id").alias("api_league_id"), "country_id", F.col("name").alias("league_name"), "place")
    batch = materialise(upsert.dedupe_in_turn(named, ["api_league_id"], ["league_name", "country_id"], ["place"]).withColumns(stamps), "batch")
    leagues = upsert.insert_absent(dims["dim_leagues"], batch, ["api_league_id"], "league_id")
    leagues = materialise(upsert.update_if_changed(leagues, batch, ["api_league_id"], ["league_name", "country_id"], _at(now)), "leagues")

    places = first.select("country", F.col("name").alias("league"), "place")
    years = materialise(flatten_metadata(tree, first, config.first_season).join(places, ["country", "league"]), "seasons")
    dated = years.join(leagues.select("league_id", "api_league_id"), "api_league_id").withColumnsRenamed({"season_start": "start_date", "season_end": "end_date"})
    columns = ["season_label", "start_date", "end_date"]
    periods = materialise(upsert.dedupe_in_turn(dated, ["league_id", "season"], columns, ["place", "season_place"]).withColumns(stamps | {"fixtures_bootstrap_done": F.lit(False)}), "periods")
    seasons = upsert.insert_absent(dims["dim_league_seasons"], periods, ["league_id", "season"], "league_season_id")
    # the time of a season's row stays, as in the original upsert
    seasons = upsert.update_if_changed(seasons, periods, ["league_id", "season"], columns, _at(now), touched="")

    asked = years.join(country_ids, "country").select("api_league_id", "season", "country_id", "place", "season_place").orderBy("place", "season_place").collect()
    requests = {text(league=r["api_league_id"], season=r["season"]): (r["country_id"], i) for i, r in enumerate(asked)}
    squads, lost = _ask(spark, config, "/teams", requests, "country_id bigint, place int", TEAM_PAYLOAD)
    known = squads.select(F.col("team.id").alias("api_team_id"), F.col("team.name").alias("team_name"), F.col("team.code").alias("team_code"), "country_id", "place", "pos")
    columns = ["team_name", "team_code", "country_id"]
    clubs = materialise(upsert.dedupe_in_turn(known.filter("api_team_id != 0 and team_name != ''"), ["api_team_id"], columns, ["place", "pos"]).withColumns(stamps), "clubs")
    teams = upsert.insert_absent(dims["dim_teams"], clubs, ["api_team_id"], "team_id")
    teams = upsert.update_if_changed(teams, clubs, ["api_team_id"], columns, _at(now))

    counts = {"countries": len({c for c, _ in held}), "leagues": batch.count(), "seasons": periods.count(), "teams": clubs.count()}
    for name, rows in zip(dims, (countries, leagues, seasons, teams)):
        landing.publish(rows, config.warehouse, name)
    return counts | {"missing": [p for p in pairs if p not in found], "failed": failed + lost}


@scratched
def replay_dead_letters(spark: SparkSession, config: Config, ds: str, now: datetime) -> dict[str, int]:
    """Try failed units again; those that answer are landed, loaded, marked done and removed from the queue.

    ``landing.residual`` lists what is left, unit by unit.
    """
    letters = landing.dead_letters(spark, config.root)
    units = letters.select("api_league_id", "season_year").distinct().collect()
    if not units:
        return {"replayed": 0, "left": 0}
    flat, _ = fetch(spark, config, [{"league": r[0], "season": r[1]} for r in units], "replay_dead_letters", now)
    path = landing.land_fixtures(flat, config.root, ds)
    landed = landing.read_landed(spark, path).filter(F.col("ds") == ds).drop("league", "season_year", "ds")
    got = landed.select("api_league_id", F.col("season").alias("season_year")).distinct()
    n = got.count()
    if n:
        load(spark, config, landed, landing.current(spark, config.warehouse, "raw_fixtures"), ["api_league_id", "season"], now)
        seasons = landing.current(spark, config.warehouse, "dim_league_seasons")
        leagues = landing.current(spark, config.warehouse, "dim_leagues")
        done = seasons.join(leagues.select("league_id", "api_league_id"), "league_id").withColumn("season_year", F.col("season")).join(got, ["api_league_id", "season_year"], "left_semi")
        landing.publish(upsert.mark_done(seasons, done, ["league_season_id"], "fixtures_bootstrap_done", "fixtures_bootstrap_at", _at(now)), config.warehouse, "dim_league_seasons")
        folders = [r[0] for r in letters.join(got, ["api_league_id", "season_year"], "left_semi").select("folder").distinct().collect()]
        landing.drop_dead_letters(spark, folders)
    return {"replayed": n, "left": len(units) - n}

