from datetime import datetime, timedelta

from touchline.operators.collect import as_json, ordered_list, payload
from touchline.operators.sequences import islands, latest_per, next_pointers, recent_values, running_stats, tile
from touchline.operators.shapes import EVENTS, fan_out_events, fan_out_scopes, flatten_fixtures, flatten_metadata, unpivot_sides
from touchline.schemas import CONFIG_TREE, FIXTURE_PAYLOAD, LEAGUE_PAYLOAD
from pyspark.sql import Window
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def _lengths(spark, flags):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, i int, flag int")
    return [r.streak_length for r in islands(df, ["k"], ["i"], "flag").orderBy("i").collect()]


def test_islands(spark):
    assert _lengths(spark, [1, 1, 0, 1]) == [1, 2, 3, 1]
    assert _lengths(spark, [0, 0, 0]) == [1, 2, 3]
    assert _lengths(spark, [1]) == [1]
    # a null flag neither opens an island nor lets the next row open one
    assert _lengths(spark, [1, None, 1, 0, 1]) == [1, 2, 3, 4, 1]
    assert _lengths(spark, []) == []


def test_latest_pointers_and_ties(spark):
    df = spark.createDataFrame([(1, T0, 5, "a"), (1, T0, 6, "b"), (1, None, 9, "c"), (2, T0, 1, None)], "k int, at timestamp, id int, v string")
    assert {(r.k, r.v) for r in latest_per(df, ["k"], ["at", "id"]).collect()} == {(1, "b"), (2, None)}
    rows = next_pointers(df, ["k"], ["at", "id"], {"v": "nv"}).collect()
    assert {(r.v, r.nv) for r in rows} == {("a", "b"), ("b", "c"), ("c", None), (None, None)}
    ranked = latest_per(df, ["k"], ["at", "id"], 9, "r")
    assert {(r.k, r.f) for r in recent_values(ranked, ["k"], "r", "v", 2, "f").collect()} == {(1, "{b,a}"), (2, "{NULL}")}


def test_running_stats_round_half_up(spark):
    rows = [(1, T0 + timedelta(days=i), i, r, g, 0) for i, (r, g) in enumerate([("win", 1), ("loss", None), (None, 0), ("draw", 2), ("win", 0), ("loss", 0), ("loss", 0), ("loss", 0)])]
    df = spark.createDataFrame(rows, "k int, at timestamp, id int, r string, g int, c int")
    last = running_stats(df, ["k"], ["at", "id"], "r", "g", "c").orderBy("id").collect()[-1]
    assert (last.games_played, last.wins, last.draws, last.losses, last.points) == (8, 2, 1, 4, 7)
    assert (last.win_rate, last.draw_rate) == (0.25, 0.13)  # 1/8 is a tie
    assert last.avg_goals_for == 0.43 and last.recency_rank == 1


def test_tiers_split_evenly(spark):
    df = spark.createDataFrame([(1, i) for i in range(8)], "k int, v int")
    assert [r.t for r in df.withColumn("t", tile(F.col("v"), F.lit(8), 3)).orderBy("v").collect()] == [1, 1, 1, 2, 2, 2, 3, 3]
    for n in range(1, 12):
        few = df.unionByName(df.selectExpr("k", "v + 8 AS v")).filter(F.col("v") < n)
        rows = few.withColumn("t", F.ntile(3).over(Window.partitionBy("k").orderBy("v"))).withColumn("u", tile(F.col("v"), F.lit(n), 3)).collect()
        assert all(r.t == r.u for r in rows) and len(rows) == n


def test_fan_out(spark):
    df = spark.createDataFrame([(1, True, 2, 0, "win", "draw"), (2, None, None, None, None, None)], "id int, h boolean, a int, b int, ft string, ht string")
    rows = fan_out_events(fan_out_scopes(df, "h", "scope"), "a", "b", "ft", "ht").collect()
    assert len(rows) == 2 * len(EVENTS) + len(EVENTS)
    flags = {r.event_name: r.event_flag for r in rows if r.id == 1 and r.scope == "home"}
    assert flags["score_2goals"] == 1 and flags["Over_1_5"] == 1 and flags["Over_2_5"] == 0 and flags["clean_sheet"] == 1 and flags["halftime_win"] == 0 and flags["BTTS"] == 0
    assert {r.scope for r in rows if r.id == 2} == {"all"} and {r.event_flag for r in rows if r.id == 2} == {None}


def test_unpivot_mirrors(spark):
    df = spark.createDataFrame([(1, 10, 20, 3, None)], "id int, h int, a int, hg int, ag int")
    rows = unpivot_sides(df, ["id"], {"team": ("h", "a"), "gf": ("hg", "ag"), "ga": ("ag", "hg"), "home": (F.lit(True), F.lit(False))}).collect()
    assert [tuple(r) for r in rows] == [(1, 10, 3, None, True), (1, 20, None, 3, False)]


def test_ordered_list_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 1, "x"), (1, None, "n"), (1, 2, "y")], "k int, o int, v string")
    down = df.groupBy("k").agg(ordered_list(F.col("v"), [(F.col("o"), True)]).alias("l")).first().l
    up = df.groupBy("k").agg(ordered_list(F.col("v"), [(F.col("o"), False)]).alias("l")).first().l
    assert down == ["n", None, "y", "x"] and up == ["x", "y", None, "n"]
    assert df.select(as_json(payload(a=F.col("v"), b=F.lit(1))).alias("j")).first().j == '{"a":null,"b":1}'


def test_flatten_payloads(spark):
    good = {"fixture": {"id": 1, "date": "2024-05-01T18:00:00+02:00", "status": {"short": None}}, "league": {"id": 7, "season": 2024}, "teams": {"home": {"id": 1, "name": "A"}, "away": {"id": 2, "name": "B"}}, "score": {"halftime": {"home": 0, "away": 0}, "fulltime": {"home": 2, "away": None}}}
    other = {**good, "fixture": {"id": 2, "date": "garbage", "status": {"short": "FT"}}}
    df = spark.createDataFrame([good, other, {**good, "teams": None}, {**good, "score": None, "league": None}], FIXTURE_PAYLOAD)
    flat, bad = flatten_fixtures(df)
    rows = flat.orderBy("api_fixture_id").collect()
    assert rows[0].kickoff_utc == datetime(2024, 5, 1, 16) and rows[0].fixture_status == "NS"
    assert rows[0].home_halftime_result == "draw" and rows[0].home_fulltime_result is None
    assert rows[1].kickoff_utc is None
    assert sorted(r.reason for r in bad.collect()) == ["missing league,score", "missing teams"]


def test_flatten_metadata(spark):
    tree = spark.createDataFrame([{"country": "X", "leagues": [{"name": "L"}]}, {"country": "Y", "leagues": None}], CONFIG_TREE)
    seasons = [{"year": "2019", "start": "2019-08-01", "end": "2020-05-01"}, {"year": "2099", "start": "2099-08-01", "end": None}, {"year": "x", "start": None, "end": None}]
    leagues = spark.createDataFrame([{"league": {"id": 5, "name": "L"}, "seasons": seasons}], LEAGUE_PAYLOAD)
    rows = flatten_metadata(tree, leagues).collect()
    assert [(r.country, r.api_league_id, r.season, r.season_label) for r in rows] == [("X", 5, 2099, "2099/00")]


def test_flag_islands_are_islands_of_each_flag(spark):
    import random

    from touchline.operators.sequences import flag_islands

    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.randrange(200), i, *[rnd.choice([0, 1, 1, None]) for _ in range(3)], rnd.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at int, id int, a int, b int, c int, side boolean")
    found = flag_islands(df, ["k"], ["at", "id"], [F.col(x) for x in "abc"], ends="side", totals=True)
    got = {}
    for r in found.collect():
        assert [e["__tl_event"] for e in r["__tl_flags"]] == [0, 1, 2]
        for e in r["__tl_flags"]:
            got[e["__tl_event"], r.id] = (r["__tl_rn"], e["event_flag"], e["island"], e["streak_length"], e["n_rows"], e["n_flagged"], e["at_end"], e["latest"])
    assert sum(r["__tl_last"] for r in found.collect()) == 3
    for i, flag in enumerate("abc"):
        alone = islands(df, ["k"], ["at", "id"], flag).collect()
        for r in alone:
            mine = [x for x in alone if x.k == r.k]
            end = max((x for x in mine if x.island == r.island), key=lambda x: x.rn)
            flagged = [x.rn for x in mine if x[flag] == 1]
            want = (r.rn, r[flag], r.island, r.streak_length, len(mine), sum(x[flag] for x in mine if x[flag] is not None), end.side, r.rn == max(flagged))
            assert got[i, r.id] == want
