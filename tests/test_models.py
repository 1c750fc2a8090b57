from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from touchline.functions.columns import pair_key, round_ratio, season_label, slugify, title_words, utc_instant
from touchline.plans.model_queries import ratings
from touchline.plans.models import Warehouse, mart_fixture_page_context, mart_team_page_context
from touchline.sources.landing import published

NOW = datetime(2024, 11, 1)
STAMP = datetime(2024, 1, 1)


def _warehouse(spark, fixtures, standings=None, teams=4):
    """Teams 1..n in one current league season; fixtures are (id, day, home, away, home goals, away goals, status)."""
    def result(a, b):
        return None if a is None or b is None else "win" if a > b else "draw" if a == b else "loss"

    rows = []
    for i, day, h, a, hg, ag, status in fixtures:
        rows.append((i, i, 7, 2024, NOW + timedelta(days=day), status, h, f"t{h}", a, f"t{a}", 0, 0, hg, ag, result(hg, ag), result(ag, hg), "draw", "draw", STAMP, STAMP))
    from touchline.schemas import TABLES

    frame = lambda name, data: spark.createDataFrame(data, TABLES[name])
    table = standings or [(1, 7, 2024, t, f"t{t}", "W", t, 0, 0, 0, 0, 0, 0, 0, 0, STAMP, STAMP) for t in range(1, teams + 1)]
    return Warehouse(
        spark,
        "",
        NOW,
        elo_rating=ratings,
        raw_fixtures=frame("raw_fixtures", rows),
        raw_league_standings=frame("raw_league_standings", table),
        dim_countries=frame("dim_countries", [(1, "X", None, STAMP, STAMP)]),
        dim_leagues=frame("dim_leagues", [(1, 1, "Top  League", 7, 1, None, STAMP, STAMP)]),
        dim_league_seasons=frame("dim_league_seasons", [(1, 1, 2024, "24", datetime(2024, 8, 1).date(), datetime(2025, 5, 1).date(), True, None, STAMP, STAMP)]),
        dim_teams=frame("dim_teams", [(100 + t, t, f"saint-étienne o'x {t}", None, 1, None, None, STAMP, STAMP) for t in range(1, teams + 1)]),
    )


def test_84_event_rows_and_mirrored_goals(spark):
    w = _warehouse(spark, [(1, -3, 1, 2, 2, 1, "FT"), (2, 3, 1, 2, None, None, "NS"), (3, -9, 1, 3, 1, 1, "PST")])
    assert w.ref("fact_team_events").count() == 84
    rows = w.ref("fact_team_fixtures").filter("is_played").collect()
    assert {(r.team_id, r.goals_for, r.goals_against, r.next_fixture_id) for r in rows} == {(101, 2, 1, 2), (102, 1, 2, 2)}
    assert rows[0].team_pair_key == "101_102" and rows[0].team_name.startswith("Saint-Étienne O'X")


def test_streaks_suppression_and_scope(spark):
    played = [(i, -30 + i, 1, 2, 3, 0, "FT") for i in range(1, 5)]
    w = _warehouse(spark, [*played, (9, 2, 3, 1, None, None, "NS"), (10, 5, 1, 2, None, None, "NS")])
    latest = {(r.team_id, r.event_name, r.context_scope): r for r in w.ref("fact_team_streak_suppression").collect()}
    assert latest[101, "win", "all"].current_streak_length == 4
    # unbeaten is as long as win, so it is hidden; scoring once is hidden by scoring twice
    assert latest[101, "unbeaten", "all"].is_suppressed and not latest[101, "win", "all"].is_suppressed
    assert latest[101, "score_1goal", "all"].suppression_reason == "stronger_variant"
    assert latest[101, "Over_1_5", "all"].is_suppressed and not latest[101, "Over_2_5", "all"].is_suppressed
    # the next match is away, so a home streak does not apply to it
    assert not latest[101, "win", "home"].is_streak_eligible and latest[101, "win", "all"].is_streak_eligible
    score = {(r.team_id, r.event_name, r.context_scope): r.relevance_score for r in w.ref("fact_team_streak_relevance_score").collect()}
    assert score[101, "win", "all"] == pytest.approx(2.321928094887362)
    assert score[101, "score_2goals", "all"] == pytest.approx(0.7 * 2.321928094887362 * 1.25)
    top = w.ref("mart_homepage_top_streaks").collect()
    assert {r.next_fixture_id for r in top if r.team_id == 101} == {9}
    numbers = [r.streak_id for r in w.ref("mart_top_team_streaks").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_null_goals_inside_a_run(spark):
    w = _warehouse(spark, [(1, -9, 1, 2, 1, 0, "FT"), (2, -8, 1, 2, None, None, "FT"), (3, -7, 1, 2, 1, 0, "FT")])
    rows = w.ref("fact_team_streaks").filter("team_id = 101 and event_name = 'win' and context_scope = 'all'").orderBy("kickoff_utc").collect()
    assert [(r.streak_length, r.current_streak_length, r.is_active) for r in rows] == [(1, 1, True), (2, 0, None), (3, 3, True)]


def test_same_kickoff_and_no_future(spark):
    w = _warehouse(spark, [(2, -3, 1, 2, 1, 0, "FT"), (1, -3, 1, 3, 0, 1, "FT")])
    rows = {r.fixture_id: r for r in w.ref("fact_team_fixtures").filter("team_id = 101").collect()}
    assert rows[1].next_fixture_id == 2 and rows[2].next_fixture_id is None
    assert not any(r.is_streak_eligible for r in w.ref("fact_team_streaks").filter("context_scope <> 'all'").collect())
    assert w.ref("mart_fixture_info").count() == 0


def test_wins_draws_losses_make_games(spark):
    w = _warehouse(spark, [(i, -40 + i, 1 + i % 2, 3, i % 3, 1, "FT") for i in range(1, 12)])
    rows = w.ref("fact_team_stats").collect()
    assert all(r.wins + r.draws + r.losses == r.games_played for r in rows)
    assert max(r.games_played for r in rows if r.team_id == 103) == 11
    assert {r["rank"] for r in rows if r.team_id == 103} == set(range(1, 12))


def test_pages_and_one_sided_fixture(spark):
    played = [(i, -30 + i, 1, 2, 3, 0, "FT") for i in range(1, 5)]
    # for team 2 the fixture 9 comes first, so fixture 10 is next for team 1 only
    w = _warehouse(spark, [*played, (9, 2, 2, 3, None, None, "NS"), (10, 5, 1, 2, None, None, "NS")])
    info = {r.fixture_id: r for r in w.ref("mart_fixture_info").collect()}
    assert info[10].home_team_id == 101 and info[10].away_team_id is None
    page = mart_fixture_page_context(w, 10).collect()
    assert len(page) == 1 and '"away":null' in page[0].fixture_info_json and page[0].h2h_info_json.startswith('{"totalMatches":4')
    team = mart_team_page_context(w, 101).collect()
    assert len(team) == 1 and team[0].season_label == 2024 and '"streakLength":4' in team[0].streaks_json
    assert mart_fixture_page_context(w, 999).count() == 0


def test_empty_tables(spark):
    w = _warehouse(spark, [])
    for name in w.names():
        assert w.ref(name) is not None
    for name in ("fact_team_events", "mart_homepage_top_streaks", "mart_head_to_head_info", "int_tier_sensitive_events", "mart_top_team_streaks"):
        assert w.ref(name).count() == 0


def test_build_writes_tables(spark, tmp_path):
    w = _warehouse(spark, [(1, -3, 1, 2, 2, 1, "FT")])
    done = w.build(str(tmp_path), ["int_fixtures", "fact_team_fixtures", "fact_team_events"])
    assert done[-1] == "fact_team_events" and published(spark, str(tmp_path), "fact_team_fixtures").count() == 2
    assert not (tmp_path / "fact_team_events").exists()


def test_incremental_models_take_only_what_is_new(spark, tmp_path):
    names = ["stg_raw_fixtures", "int_fixtures", "fact_team_fixtures", "fact_head_to_head"]

    def run(rows, **how):
        w = _warehouse(spark, rows)
        # a fixture of one delivery is as new as its number
        w._given["raw_fixtures"] = w._given["raw_fixtures"].withColumn("updated_at", F.make_interval(days=F.col("fixture_id").cast("int")) + F.col("updated_at"))
        w.build(str(tmp_path), names, **how)
        return [published(spark, str(tmp_path), n) for n in names]

    first = [(3, -9, 1, 2, 1, 0, "FT"), (4, -8, 2, 1, 2, 2, "FT")]
    run(first)
    stale = (1, -7, 1, 3, 5, 5, "FT")  # older than the mark, so a further run passes it over
    stg, _, sides, meetings = run([(3, -9, 1, 2, 9, 9, "FT"), stale, (5, -6, 1, 2, 0, 1, "FT")])
    assert {(r.fixture_id, r.home_team_fulltime_goal) for r in stg.collect()} == {(3, 1), (4, 2), (5, 0)}
    assert sides.count() == 6 and meetings.select("team_fixture_key").distinct().count() == meetings.count() == 6
    assert {r.next_fixture_id for r in sides.filter("fixture_id = 4").collect()} == {5}
    stg, *_ = run([stale], full_refresh=True)
    assert [r.fixture_id for r in stg.collect()] == [1]


def test_now_is_the_present_and_ratings_are_not_invented(spark):
    w = Warehouse(spark, "/no/such/folder")
    assert abs((w.as_of - datetime.now(timezone.utc).replace(tzinfo=None)).total_seconds()) < 60
    with pytest.raises(Exception, match="elo_rating"):
        w.ref("elo_rating")


def test_fixtures_without_an_identifier_all_stay(spark):
    w = _warehouse(spark, [(1, -3, 1, 2, 2, 1, "FT"), (2, -3, 1, 2, 2, 1, "FT")])
    w._given["raw_fixtures"] = w._given["raw_fixtures"].withColumn("api_fixture_id", F.lit(None).cast("bigint"))
    assert w.ref("stg_raw_fixtures").count() == 2


def test_columns(spark):
    df = spark.createDataFrame([("saint-étienne  FC o'b", 57, 200), (None, 1, 0)], "n string, a int, b int")
    one, two = df.select(title_words("n"), slugify("n", "a"), pair_key("a", "b"), round_ratio("a", "b", 2), season_label("b")).collect()
    assert tuple(one) == ("Saint-Étienne  Fc O'B", "saint-étienne-fc-o'b-57", "57_200", 0.29, "200/01")
    assert two[0] is None and two[3] is None
    times = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01T12:00:00+02:00",), ("2024-05-01 10:00:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in times.select(utc_instant("t")).collect()] == [datetime(2024, 5, 1, 10)] * 3 + [None, None]


def test_models_know_what_they_refer_to():
    assert Warehouse.used_by("stg_raw_fixtures") == set()
    assert {"int_league_context", "dim_team", "stg_raw_fixtures", "stg_dim_teams"} <= Warehouse.used_by("int_fixtures")
    assert {"fact_head_to_head_latest", "fact_team_fixtures", "mart_fixture_info"} <= Warehouse.used_by("mart_head_to_head_info")
    order = list(Warehouse.names())
    assert all(order.index(n) < order.index(name) for name in order for n in Warehouse.used_by(name))


def test_side_by_side_build(spark, tmp_path):
    w = _warehouse(spark, [(i, -30 + i, 1, 2, 3, 0, "FT") for i in range(1, 5)] + [(10, 5, 1, 2, None, None, "NS")])
    assert set(w.build(str(tmp_path), threads=4)) == set(w.names())
    tables = {n for n, kind in w.names().items() if kind != "view"} | {"mart_dim_search_trigrams"}
    assert {p.name for p in tmp_path.iterdir()} == tables
    assert published(spark, str(tmp_path), "mart_head_to_head_info").first().h2h_info_json.startswith('{"totalMatches":4')


def test_seeds_come_from_files_where_given(spark, tmp_path):
    from touchline.sources.landing import read_seed

    (tmp_path / "w.csv").write_text("category,weight,version\nresult,2.0,v1\n")
    w = _warehouse(spark, [(i, -30 + i, 1, 2, 3, 0, "FT") for i in range(1, 5)])
    w._given["category_weights"] = read_seed(spark, str(tmp_path / "w.csv"), "category string, weight double, version string")
    score = {(r.team_id, r.event_name, r.context_scope): r.relevance_score for r in w.ref("fact_team_streak_relevance_score").collect()}
    assert score[101, "win", "all"] == pytest.approx(2 * 2.321928094887362) and score[101, "score_2goals", "all"] is None
