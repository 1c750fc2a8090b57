import json
import zipfile
from collections import Counter
from datetime import date
from pathlib import Path

import pytest

from touchline.plans import load_queries
from touchline.session import scratch
from touchline.sources import api

YEARS = range(2018, 2023)


@pytest.fixture
def dims(spark, tmp_path):
    """A country with six leagues, two of them of one name, and eight clubs; one with a league and no club; one whose league ended."""
    write = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    write("dim_countries", [(1, "X"), (2, "Y"), (3, "Z")], "country_id bigint, country_name string")
    leagues = [(i, 1, f"L{max(i, 2)}", 10 + i) for i in range(1, 7)] + [(7, 2, "L1", 17), (8, 3, "L1", 18)]
    write("dim_leagues", leagues, "league_id bigint, country_id bigint, league_name string, api_league_id int")
    seasons = [(i, y, date(y, 8, 1), date(y + 1, 5, 1)) for i in range(1, 9) for y in YEARS if i < 8 or y < 2020]
    write("dim_league_seasons", seasons, "league_id bigint, season int, start_date date, end_date date")
    teams = [(1, t, f"T{t}", None if t % 2 else f"C{t}") for t in range(1, 9)] + [(3, 9, "T9", "C9")]
    write("dim_teams", teams, "country_id bigint, api_team_id int, team_name string, team_code string")
    return str(tmp_path)


def test_recorded_squads_hold_each_club_once_a_season(spark, dims):
    with scratch(spark):
        folder = Path(load_queries._metadata(spark, dims).folder.removeprefix("file://")) / "teams"
        answers = {p.stem: [i["team"]["id"] for i in json.loads(p.read_text())["response"]] for p in folder.glob("*.json")}
    assert set(answers) == {f"league-{10 + i}_season-{y}" for i in range(1, 9) for y in YEARS if i < 8 or y < 2020}
    for y in YEARS:
        assert sorted(answers[f"league-11_season-{y}"]) == sorted(answers[f"league-12_season-{y}"])
        told_apart = [t for i in range(2, 9) for t in answers.get(f"league-{10 + i}_season-{y}", [])]
        assert Counter(told_apart) == Counter([*range(1, 9), *[9] * (y < 2020)])
    assert all(answers[f"league-17_season-{y}"] == [] for y in YEARS)


def test_metadata_teams_has_all_clubs_of_countries_that_still_play(spark, dims):
    with scratch(spark):
        rows = {tuple(r) for r in load_queries.o_metadata_teams(spark, dims).collect()}
    assert rows == {(t, t, f"T{t}", None if t % 2 else f"C{t}", "X") for t in range(1, 9)}


def test_metadata_seasons_asks_for_no_product_of_clubs_and_leagues(spark, dims, monkeypatch):
    recorded = []
    record = load_queries._record
    monkeypatch.setattr(load_queries, "_record", lambda items, endpoint, by, config: (recorded.append((endpoint, items.filter("item is not null").count())), record(items, endpoint, by, config)))
    with scratch(spark):
        rows = {(r.country_name, r.league_name, r.season) for r in load_queries.o_metadata_seasons(spark, dims).collect()}
    assert rows == {(c, n, y) for c, n in [*[("X", f"L{i}") for i in range(2, 7)], ("Y", "L1")] for y in range(2020, 2023)}
    # eight clubs in each year, and those of the two leagues of one name twice
    assert dict(recorded)["teams"] <= 2 * 8 * len(YEARS) + 2


def _packed(monkeypatch):
    monkeypatch.setattr(api, "SINGLE", 3)
    monkeypatch.setattr(api, "PACKED", 4)


def test_many_answers_are_packed_and_leagues_of_one_name_list_their_clubs_once(spark, dims, monkeypatch):
    """More leagues of one name, on larger tables, must not bring the product of clubs and leagues back."""
    _packed(monkeypatch)
    more = spark.range(100, 140).selectExpr("id league_id", "1L country_id", "'L2' league_name", "cast(id as int) api_league_id")
    more.write.mode("append").parquet(f"{dims}/dim_leagues.parquet")
    more.selectExpr("league_id", "explode(array(2019, 2020)) season").selectExpr("*", "make_date(season, 8, 1) start_date", "make_date(season + 1, 5, 1) end_date").write.mode("append").parquet(f"{dims}/dim_league_seasons.parquet")
    with scratch(spark):
        folder = Path(load_queries._metadata(spark, dims).folder.removeprefix("file://"))
        answers = {}
        for path in (folder / "teams").iterdir():
            with zipfile.ZipFile(path) as pack:
                answers |= {n.removesuffix(".json"): json.loads(pack.read(n)) for n in pack.namelist()}
        n_files = len([*folder.rglob("*.zip"), *folder.rglob("*.json")])
        fetch = api.folder_fetch(str(folder))
        squad = lambda i, y: [c["team"]["id"] for c in json.loads(fetch("/teams", {"league": i, "season": y}, 1)[2])["response"]]
        assert squad(139, 2020) == squad(11, 2020) == squad(12, 2020)
        assert {c for i in (11, *range(13, 17)) for c in squad(i, 2020)} == set(range(1, 9))
        assert fetch("/teams", {"league": 139, "season": 2021}, 1)[0] == fetch("/teams", {"league": 5, "season": 2020}, 1)[0] == 404
    assert len(answers) == 7 * len(YEARS) + 2 + 80
    assert Counter(c["team"]["id"] for a in answers.values() for c in a["response"]) == {**dict.fromkeys(range(1, 9), len(YEARS)), 9: 2}
    assert n_files <= -(-len(answers) // 4) + 2


def test_metadata_of_packed_answers_is_whole(spark, dims, monkeypatch):
    _packed(monkeypatch)
    with scratch(spark):
        teams = {tuple(r) for r in load_queries.o_metadata_teams(spark, dims).collect()}
        seasons = sorted((r.country_name, r.league_name, r.api_league_id, r.season) for r in load_queries.o_metadata_seasons(spark, dims).collect())
    assert teams == {(t, t, f"T{t}", None if t % 2 else f"C{t}", "X") for t in range(1, 9)}
    # of the two leagues of one name the first counts, in every run
    assert seasons == [(c, n, i, y) for c, n, i in [("X", "L2", 11), *[("X", f"L{i}", 10 + i) for i in range(3, 7)], ("Y", "L1", 17)] for y in range(2020, 2023)]
