import json
from datetime import datetime

from pyspark.sql import functions as F

from touchline.operators.quality import freshness
from touchline.plans import pipelines
from touchline.plans.pipelines import Config
from touchline.schemas import STANDINGS_PAYLOAD, TABLES, create_tables, require_columns, require_keys
from touchline.sources import api, landing
from touchline.streaming import incremental

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 11, 1)


def _payload(i, league=7, kickoff="2024-10-01T18:00:00Z", goals=(1, 0), status="FT"):
    return {
        "fixture": {"id": i, "date": kickoff, "status": {"short": status}},
        "league": {"id": league, "season": 2024},
        "teams": {"home": {"id": 1, "name": "A"}, "away": {"id": 2, "name": "B"}},
        "score": {"halftime": {"home": 0, "away": 0}, "fulltime": {"home": goals[0], "away": goals[1]}},
    }


def _answer(root, endpoint, params, items):
    path = root / endpoint.strip("/")
    path.mkdir(parents=True, exist_ok=True)
    (path / ("_".join(f"{k}-{params[k]}" for k in sorted(params)) + ".json")).write_text(json.dumps({"response": items}))


def _install(spark, tmp_path):
    config = Config(str(tmp_path / "land"), str(tmp_path / "wh"), folder=str(tmp_path / "api"))
    frame = lambda n, rows: spark.createDataFrame(rows, TABLES[n])
    day = lambda y, m: datetime(y, m, 1).date()
    landing.publish(frame("dim_countries", [(1, "X", None, T0, T0)]), config.warehouse, "dim_countries")
    landing.publish(frame("dim_leagues", [(1, 1, "L", 7, 1, None, T0, T0), (2, 1, "M", 8, 1, None, T0, T0)]), config.warehouse, "dim_leagues")
    seasons = [(i, i, 2024, "2024/25", day(2024, 8), day(2025, 5), False, None, T0, T0) for i in (1, 2)]
    landing.publish(frame("dim_league_seasons", seasons), config.warehouse, "dim_league_seasons")
    return config


def test_full_load_dead_letters_replay_and_updates(spark, tmp_path):
    config = _install(spark, tmp_path)
    answers = tmp_path / "api"
    _answer(answers, "/fixtures", {"league": 7, "season": 2024}, [_payload(1), _payload(2, goals=(None, None), status="NS"), {"fixture": None}])
    counts = pipelines.full_load(spark, config, "2024-11-01", NOW)
    assert counts == {"pending": 2, "loaded": 1, "failed": 1, "skipped": 0, "extracted": 2, "fixtures": 2}
    fixtures = landing.current(spark, config.warehouse, "raw_fixtures")
    assert {(r.fixture_id, r.api_fixture_id, r.home_fulltime_result) for r in fixtures.collect()} == {(1, 1, "win"), (2, 2, None)}
    assert [r.api_league_id for r in landing.dead_letters(spark, config.root).collect()] == [8]
    assert pipelines.replay_dead_letters(spark, config, "2024-11-02", NOW) == {"replayed": 0, "left": 1}
    (left,) = landing.residual(spark, config.root).collect()
    assert (left.api_league_id, left.season_year, left.n_failures, left.ds, left.error) == (8, 2024, 1, "2024-11-01", "Failed: refused with status 404")
    _answer(answers, "/fixtures", {"league": 8, "season": 2024}, [_payload(3, league=8)])
    assert pipelines.replay_dead_letters(spark, config, "2024-11-02", NOW) == {"replayed": 1, "left": 0}
    assert landing.dead_letters(spark, config.root).count() == 0
    assert pipelines.full_load(spark, config, "2024-11-03", NOW)["pending"] == 0
    # fixture 2 is over and has no goals: it is asked for by id, and a null does not clear its status
    _answer(answers, "/fixtures", {"ids": "2"}, [_payload(2, goals=(2, 2)), _payload(2, goals=(None, None), status=None), _payload(5)])
    assert pipelines.incremental_load(spark, config, "2024-11-04", NOW) == 3
    rows = {r.api_fixture_id: r for r in landing.current(spark, config.warehouse, "raw_fixtures").collect()}
    assert rows[2].home_fulltime_result == "draw" and rows[2].fixture_id == 2
    assert rows[5].fixture_id == max(r.fixture_id for r in rows.values()) and len(rows) == 4
    assert pipelines.incremental_load(spark, config, "2024-11-05", NOW, mode="batch") == 0


def test_corrections_and_standings(spark, tmp_path):
    config = _install(spark, tmp_path)
    answers = tmp_path / "api"
    for league in (7, 8):
        _answer(answers, "/fixtures", {"league": league, "season": 2024}, [_payload(league, league, "2024-12-01T18:00:00", (None, None), "NS")])
    pipelines.full_load(spark, config, "d", NOW)
    _answer(answers, "/fixtures", {"league": 7, "season": 2024, "next": 11}, [_payload(7, 7, "2024-12-02T19:00:00+01:00", (None, None), "NS"), _payload(99)])
    _answer(answers, "/fixtures", {"league": 8, "season": 2024, "last": 11}, [_payload(8, 8, "2024-12-01T18:00:00Z")])
    assert pipelines.correct_kickoffs(spark, config, NOW) == 1
    rows = {r.api_fixture_id: r.kickoff_utc for r in landing.current(spark, config.warehouse, "raw_fixtures").collect()}
    assert rows == {7: datetime(2024, 12, 2, 18), 8: datetime(2024, 12, 1, 18)}
    line = {"team": {"id": 1, "name": "A"}, "rank": 1, "points": 3, "goalsDiff": 1, "form": "W", "all": {"played": 1, "win": 1, "draw": 0, "lose": 0, "goals": {"for": 1, "against": 0}}}
    table = {"league_season_id": 1, "league": {"standings": [[line], [{**line, "rank": 2}, {**line, "team": {"id": None, "name": "?"}}]]}}
    payload = spark.createDataFrame([table], STANDINGS_PAYLOAD).coalesce(1)
    assert pipelines.refresh_standings(spark, config, NOW, payload) == 1
    assert pipelines.refresh_standings(spark, config, NOW, payload) == 1
    held = landing.current(spark, config.warehouse, "raw_league_standings").collect()
    assert [(r.api_team_id, r["rank"], r.api_league_id) for r in held] == [(1, 2, 7)]
    # asked of the service: the first element of each answer counts, a refused season is kept as a failure
    _answer(answers, "/standings", {"league": 7, "season": 2024}, [{"league": {"standings": [[{**line, "rank": 5}], [{**line, "team": {"id": 4, "name": "D"}}]]}}, {"league": {"standings": [[{**line, "rank": 9}]]}}])
    assert pipelines.refresh_standings(spark, config, NOW) == 2
    held = landing.current(spark, config.warehouse, "raw_league_standings").collect()
    assert {(r.api_team_id, r["rank"]) for r in held} == {(1, 5), (4, 1)}
    assert [(r.pipeline, r.request) for r in landing.failures(spark, config.root).filter("pipeline = 'refresh_standings'").collect()] == [("refresh_standings", '{"league": 8, "season": 2024}')]


def test_metadata_refresh(spark, tmp_path):
    config = _install(spark, tmp_path)
    answers = tmp_path / "api"
    season = lambda y, end=None: {"year": y, "start": f"{y}-08-01", "end": end}
    # the same name in two countries: each has its own league
    _answer(answers, "/leagues", {"country": "X", "name": "L"}, [{"league": {"id": 7, "name": "L"}, "seasons": [season(2019), season(2024), season("x")]}, {"league": {"id": 70, "name": "L"}, "seasons": []}])
    _answer(answers, "/leagues", {"country": "Y", "name": "L"}, [{"league": {"id": 9, "name": "El"}, "seasons": [season(2023), season(2024, "2025-05-31")]}])
    _answer(answers, "/leagues", {"country": "Y", "name": "Bare"}, [{"league": {"id": 10, "name": "Bare"}, "seasons": []}])
    _answer(answers, "/leagues", {"country": "Y", "name": "Gone"}, [])
    club = lambda i, name, code: {"team": {"id": i, "name": name, "code": code}}
    _answer(answers, "/teams", {"league": 7, "season": 2024}, [club(1, "A", "AAA"), club(None, "?", None), club(3, "", None), {}])
    _answer(answers, "/teams", {"league": 9, "season": 2023}, [club(2, "B", "BBB")])
    _answer(answers, "/teams", {"league": 9, "season": 2024}, [club(2, "B", None), club(4, "D", None)])
    (tmp_path / "m.yaml").write_text("countries:\n- country: X\n  leagues:\n  - name: L\n- country: Y\n  leagues:\n  - name: L\n  - name: Bare\n  - name: Gone\n- country: Z\n")
    tree = landing.read_config(spark, str(tmp_path / "m.yaml"))
    counts = pipelines.refresh_metadata(spark, config, tree, NOW)
    assert {k: counts[k] for k in ("countries", "leagues", "seasons", "teams")} == {"countries": 3, "leagues": 3, "seasons": 3, "teams": 3}
    assert counts["missing"] == [("Y", "Gone")]

    def held():
        rows = {n: landing.current(spark, config.warehouse, n).collect() for n in ("dim_countries", "dim_leagues", "dim_league_seasons", "dim_teams")}
        return {n: sorted(map(tuple, r)) for n, r in rows.items()}, rows

    tables, rows = held()
    countries = {r.country_name: r.country_id for r in rows["dim_countries"]}
    assert countries == {"X": 1, "Y": countries["Y"], "Z": countries["Z"]} and len(set(countries.values())) == 3
    leagues = {r.api_league_id: r for r in rows["dim_leagues"]}
    assert {k: (r.country_id, r.league_name) for k, r in leagues.items()} == {7: (1, "L"), 8: (1, "M"), 9: (countries["Y"], "L"), 10: (countries["Y"], "Bare")}
    assert leagues[7].league_id == 1 and leagues[7].updated_at == T0 and leagues[9].updated_at == NOW
    seasons = {(r.league_id, r.season): r for r in rows["dim_league_seasons"]}
    assert set(seasons) == {(1, 2024), (2, 2024), (leagues[9].league_id, 2023), (leagues[9].league_id, 2024)}
    assert str(seasons[leagues[9].league_id, 2024].end_date) == "2025-05-31" and seasons[leagues[9].league_id, 2023].fixtures_bootstrap_done is False
    # an end that the answer lacks clears nothing by itself
    assert str(seasons[1, 2024].end_date) == "2025-05-01" and seasons[1, 2024].league_season_id == 1
    assert {(r.api_team_id, r.team_name, r.team_code, r.country_id) for r in rows["dim_teams"]} == {(1, "A", "AAA", 1), (2, "B", "BBB", countries["Y"]), (4, "D", None, countries["Y"])}
    # again: nothing changes; then a team's name does
    pipelines.refresh_metadata(spark, config, tree, datetime(2024, 11, 2))
    assert held()[0] == tables
    _answer(answers, "/teams", {"league": 7, "season": 2024}, [club(1, "A2", "AAA")])
    pipelines.refresh_metadata(spark, config, tree, datetime(2024, 11, 3))
    changed = {r.api_team_id: r for r in held()[1]["dim_teams"]}
    assert changed[1].team_name == "A2" and changed[1].updated_at == datetime(2024, 11, 3) and changed[2].updated_at == NOW


def test_failed_requests_and_rejected_payloads_are_kept(spark, tmp_path):
    config = _install(spark, tmp_path)
    answers = tmp_path / "api"
    kept = lambda: {(r.pipeline, r.request, r.error) for r in landing.failures(spark, config.root).collect()}
    assert kept() == set()
    _answer(answers, "/fixtures", {"league": 7, "season": 2024}, [_payload(2, goals=(None, None), status="NS"), {"fixture": None}])
    pipelines.full_load(spark, config, "2024-11-01", NOW)
    refused = "Failed: refused with status 404"
    full = {("full_load", '{"league": 7, "season": 2024}', "missing fixture,league,teams,score"), ("full_load", '{"league": 8, "season": 2024}', refused)}
    assert kept() == full
    assert [r.error for r in landing.dead_letters(spark, config.root).collect()] == [refused]
    # an empty answer is no failed request
    _answer(answers, "/fixtures", {"league": 8, "season": 2024}, [])
    pipelines.replay_dead_letters(spark, config, "2024-11-02", NOW)
    assert kept() == full
    assert pipelines.incremental_load(spark, config, "2024-11-02", NOW) == 0
    assert kept() - full == {("incremental_load", '{"ids": "2"}', refused)}
    pipelines.correct_kickoffs(spark, config, NOW, mode="missed")
    assert {r for _, r, _ in kept() - full} == {'{"ids": "2"}', '{"last": 11, "league": 7, "season": 2024}', '{"last": 11, "league": 8, "season": 2024}'}


def _pace(lanes=1, now=datetime(2024, 1, 1)):
    slept = []
    return api.Pace(lanes, slept.append, lambda: now), slept


def test_lost_requests_raise():
    for bad in [(404, {}, ""), (200, {}, "no json"), (200, {}, "[]"), (500, {}, "")]:
        pace, slept = _pace()
        try:
            api.require_response(lambda *a, bad=bad: bad, "/x", {}, pace)
            raise AssertionError
        except api.Failed:
            assert slept == ([1, 2, 4, 8] if bad[0] == 500 else [])
    assert api.require_response(lambda *a: (200, {}, '{"response": []}'), "/x", {}) == []


def test_requests_wait_and_retry():
    script = iter(["down", (429, {"Retry-After": "9"}, ""), (200, {"x-ratelimit-remaining": "0"}, '{"response": [1]}'), (200, {"x-ratelimit-remaining": "?"}, '{"response": [2]}')])

    def fetch(endpoint, params, timeout):
        step = next(script)
        if step == "down":
            raise api.Transient
        return step

    pace, slept = _pace()
    assert api.require_response(fetch, "/x", {}, pace) == [1] and slept == [1, 9]
    # a good answer counts even where it spends the minute; the next request waits
    assert api.require_response(fetch, "/x", {}, pace) == [2] and slept == [1, 9, 60]
    assert api.batches_of_ids(list(range(41)))[2] == {"ids": "40"}


def test_a_spent_day_fails_the_rest_at_once():
    pace, slept = _pace(lanes=3)
    assert api.require_response(lambda *a: (200, {"x-ratelimit-requests-remaining": "2"}, '{"response": [1]}'), "/x", {}, pace) == [1]
    try:
        api.require_response(lambda *a: (200, {}, '{"response": [2]}'), "/x", {}, pace)
        raise AssertionError
    except api.Failed as e:
        assert "day" in str(e) and slept == []
    pace.now = lambda: datetime(2024, 1, 2)
    assert api.require_response(lambda *a: (200, {}, '{"response": [2]}'), "/x", {}, pace) == [2]


def test_lanes_share_out_the_requests(spark, tmp_path):
    for i in range(5):
        _answer(tmp_path, "/x", {"i": i}, [i])
    for lanes in ("1", "3", "9"):
        df = api.read_api(spark, "/x", [{"i": i} for i in range(6)], folder=str(tmp_path), lanes=lanes)
        assert df.rdd.getNumPartitions() == min(int(lanes), 6)
        rows = df.collect()
        assert sorted(r.body for r in rows if r.body) == list("01234") and [r.request for r in rows if r.error] == ['{"i": 5}']


def test_settings_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("TOUCHLINE_LOOK", "5")
    monkeypatch.setenv("TOUCHLINE_LANES", "many")
    monkeypatch.setenv("TOUCHLINE_WAREHOUSE", "wh")
    config = Config.from_environment(root="r")
    assert (config.root, config.warehouse, config.look, config.lanes, config.first_season) == ("r", "wh", 5, 1, 2020)


def test_sources_and_contracts(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("category,weight\nresult,1.0\n")
    assert landing.read_seed(spark, str(tmp_path / "seed.csv"), "category string, weight double").first().weight == 1.0
    (tmp_path / "m.yaml").write_text("countries:\n- country: X\n  leagues:\n  - name: L\n- country: Y\n")
    assert {(r.country, len(r.leagues)) for r in landing.read_config(spark, str(tmp_path / "m.yaml")).collect()} == {("X", 1), ("Y", 0)}
    changed = lambda: landing.changed_since(spark, str(tmp_path / "m.yaml"), str(tmp_path / "mark"))
    assert changed()[0]
    landing.commit_marker(spark, str(tmp_path / "mark"), changed()[1])
    assert not changed()[0]
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": null}]')
    rows = landing.path_parts(landing.read_json_array(spark, str(tmp_path / "a.json"), "x int"), {"file": 1}).collect()
    assert [r.x for r in rows] == [1, None] and rows[0].file == "a.json"
    landing.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string"), str(tmp_path / "t"), ["p"])
    landing.write_partitions(spark.createDataFrame([(2, "c")], "p int, v string"), str(tmp_path / "t"), ["p"])
    assert {(r.p, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}
    landing.bulk_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv")).first()[1] is None
    frame = spark.createDataFrame([], TABLES["dim_teams"])
    assert require_columns(frame, "dim_teams") is frame
    try:
        require_columns(frame.drop("team_name"), "dim_teams")
        raise AssertionError
    except ValueError as e:
        assert "team_name" in str(e)
    row = (1, 5, "n", None, 1, None, None, T0, T0)
    good = spark.createDataFrame([row], TABLES["dim_teams"])
    assert require_keys(good, "dim_teams") is good
    loose = spark.createDataFrame([row, (2, 5, None, None, 1, None, None, T0, T0)], TABLES["dim_teams"].replace("not null", ""))
    try:
        require_keys(loose, "dim_teams")
        raise AssertionError
    except ValueError as e:
        assert "(team_name) is null in 1 rows" in str(e) and "(api_team_id) repeats for 1 values" in str(e) and "(team_id)" not in str(e)
    assert freshness(landing.current(spark, str(tmp_path / "none"), "raw_fixtures"), "updated_at", F.current_timestamp()).first().state == "error"


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    ddl = "id string, k int, at timestamp, v int"
    first = [("p1", 1, datetime(2024, 1, 2), 10), ("p2", 2, datetime(2024, 1, 1), 20), ("p1", 1, datetime(2024, 1, 1), 9), ("odd", 3, T0, 1)]
    spark.createDataFrame(first, ddl).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = lambda: incremental.file_stream(spark, str(source), ddl)
        for query in (
            incremental.upsert_stream(stream(), str(tmp_path / "up"), ddl, ["k"], ["at"]),
            incremental.exactly_once_stream(stream(), str(tmp_path / "once"), "id", ["at"]),
        ):
            query.awaitTermination()
            assert query.exception() is None
        held = {(r.k, r.v) for r in incremental.KeyedState(spark, str(tmp_path / "up"), ddl, ["k"]).read().collect()}
        out = sorted(r.id for r in spark.read.parquet(str(tmp_path / "once" / "out")).collect())
        return held, out

    assert run() == ({(1, 10), (2, 20), (3, 1)}, ["odd", "p1", "p2"])
    spark.createDataFrame([("p1", 1, T0, 5), ("p3", 2, datetime(2024, 3, 1), 21), ("odd", 9, T0, 1)], ddl).coalesce(1).write.mode("append").parquet(str(source))
    assert run() == ({(1, 10), (2, 21), (3, 1), (9, 1)}, ["odd", "p1", "p2", "p3"])
    assert run()[1] == ["odd", "p1", "p2", "p3"]


def test_state_rewrites_only_what_a_batch_touches(spark, tmp_path):
    state = incremental.KeyedState(spark, f"file://{tmp_path}/s", "k int, v int", ["k"])
    frame = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    everything = frame(*[(i, 0) for i in range(40)])
    state.replace(0, everything, state.touched(everything))
    assert state.seen(0) and not state.seen(1) and state.read().count() == 40
    one = frame((7, 1))
    (bucket,) = state.touched(one)
    rows = state.read([bucket]).filter("k != 7").unionByName(one)
    kept = rows.count()
    assert 0 < kept < 40
    state.replace(1, rows, [bucket])
    assert {(r.k, r.v) for r in state.read().collect()} == {(i, int(i == 7)) for i in range(40)}
    assert len(list((tmp_path / "s" / "b1").glob("__tl_bucket=*"))) == 1
    # the replaced files go one batch later, and a bucket may become empty
    assert (tmp_path / "s" / "b0" / f"__tl_bucket={bucket}").exists()
    state.replace(2, frame(), [bucket])
    assert state.read().count() == 40 - kept and not (tmp_path / "s" / "b0" / f"__tl_bucket={bucket}").exists()


def test_stream_windows(spark, tmp_path):
    ddl = "id string, kind string, at timestamp"
    spark.createDataFrame([("a", "x", T0), ("a", "x", T0), ("b", "x", T0)], ddl).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), ddl)
    query = incremental.distinct_events(stream, ["id"], "at").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 2
    query = incremental.counts_by_window(stream, "at", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] == [3]


def test_create_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tl_test LOCATION '{tmp_path}/db'")
    create_tables(spark, "tl_test")
    create_tables(spark, "tl_test")
    assert spark.catalog.tableExists("tl_test.raw_fixtures")
    assert [f.name for f in spark.table("tl_test.dim_leagues").schema][:2] == ["league_id", "country_id"]
    spark.sql("DROP DATABASE tl_test CASCADE")
