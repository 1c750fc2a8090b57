"""Rows reshaped: two sides of a fixture, event and scope fan-out, nested payloads made flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import result_of

#: The events of one team in one fixture, by goals for (gf), against (ga) and results.
#: (name, condition, type, polarity, composition, threshold)
EVENTS = [
    ("score_1goal", "gf >= 1", "goal", "positive", "single", 1),
    ("score_2goals", "gf >= 2", "goal", "positive", "single", 2),
    ("concede_1", "ga >= 1", "goal", "negative", "single", 1),
    ("concede_2", "ga >= 2", "goal", "negative", "single", 2),
    ("goalless", "gf = 0", "goal", "negative", "single", None),
    ("Over_1_5", "gf + ga > 1.5", "goal", None, None, None),
    ("Over_2_5", "gf + ga > 2.5", "goal", None, None, None),
    ("Over_3_5", "gf + ga > 3.5", "goal", None, None, None),
    ("Over_4_5", "gf + ga > 4.5", "goal", None, None, None),
    ("Under_1_5", "gf + ga < 1.5", "goal", None, None, None),
    ("Under_2_5", "gf + ga < 2.5", "goal", None, None, None),
    ("Under_3_5", "gf + ga < 3.5", "goal", None, None, None),
    ("Under_4_5", "gf + ga < 4.5", "goal", None, None, None),
    ("clean_sheet", "ga = 0", "goal", "positive", "single", None),
    ("win", "ft = 'win'", "result", "positive", "single", None),
    ("draw", "ft = 'draw'", "result", "neutral", "single", None),
    ("loss", "ft = 'loss'", "result", "negative", "single", None),
    ("unbeaten", "ft in ('win', 'draw')", "result", "positive", "single", None),
    ("winless", "ft in ('draw', 'loss')", "result", "negative", "single", None),
    ("halftime_win", "ht = 'win'", "result", "positive", None, None),
    ("BTTS", "gf > 0 and ga > 0", "goal", None, None, None),
]


def unpivot_sides(df: DataFrame, keep: list[str], sides: dict[str, tuple[str | Column, str | Column]]) -> DataFrame:
    """Two rows per input row: ``keep`` and, for each output column, its (first, second) source.

    One generate over an array of two structs, no shuffle. Nulls stay nulls; an empty input gives
    no rows; input columns that aren't kept can't clash with the outputs.
    """
    def side(i: int) -> Column:
        return F.struct(*[(F.col(s[i]) if isinstance(s[i], str) else s[i]).alias(name) for name, s in sides.items()])

    return df.select(*keep, F.inline(F.array(side(0), side(1))))


def fan_out_scopes(df: DataFrame, is_home: str, out: str, everywhere: str = "all") -> DataFrame:
    """A row for the scope ``everywhere`` and one for home or away; a null side has only the first."""
    home = F.col(is_home)
    scopes = F.array_compact(F.array(F.lit(everywhere), F.when(home, "home").when(~home, "away")))
    return df.withColumn(out, F.explode(scopes))


def fan_out_events(df: DataFrame, gf: str, ga: str, ft: str, ht: str) -> DataFrame:
    """One row per event of the catalogue: event_name, event_flag (0, 1 or null), streak_type,
    polarity, composition, threshold.

    A flag is null where the goals or the result it needs are. Only the 21 flags are generated for
    each row; what else is known of an event is looked up in constant arrays by its place, which
    keeps the generated code small enough for the JVM to compile. No shuffle.
    """
    flags = event_flags(gf, ga, ft, ht)
    fanned = df.select(*df.columns, F.posexplode(F.array(*flags)).alias("__tl_event", "event_flag"))
    return name_events(fanned, df.columns, ["event_flag"])


def event_flags(gf: str, ga: str, ft: str, ht: str) -> list[Column]:
    """The flag of each event of the catalogue, in its order."""
    names = {"gf": gf, "ga": ga, "ft": ft, "ht": ht}
    return [F.expr(" ".join(f"`{names[w]}`" if w in names else w for w in condition.split(" "))).cast("int") for _, condition, *_ in EVENTS]


def name_events(df: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Rows with the place ``__tl_event`` of an event, and what is known of it: ``before``, event_name,
    ``after``, streak_type, polarity, composition, threshold, from constant arrays.
    """

    def known(i: int, kind: str) -> Column:
        return F.get(F.array(*[F.lit(e[i]).cast(kind) for e in EVENTS]), F.col("__tl_event"))

    return df.select(
        *before,
        known(0, "string").alias("event_name"),
        *after,
        known(2, "string").alias("streak_type"),
        known(3, "string").alias("polarity"),
        known(4, "string").alias("composition"),
        known(5, "int").alias("threshold"),
    )


def flatten_fixtures(payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flat fixtures, rejected payloads) of nested API documents.

    A payload without fixture, teams, league or score is rejected with a ``reason``. A missing
    status text becomes ``NS``. Kickoffs without an offset are UTC. Results come from the goals.
    """
    parts = ["fixture", "league", "teams", "score"]
    reason = F.concat_ws(",", *[F.when(F.col(p).isNull(), p) for p in parts])
    tagged = payload.withColumn("reason", F.when(reason != "", F.concat(F.lit("missing "), reason)))
    good = tagged.filter(F.col("reason").isNull())
    h, a = "score.fulltime.home", "score.fulltime.away"
    hh, ha = "score.halftime.home", "score.halftime.away"
    flat = good.select(
        F.col("fixture.id").alias("api_fixture_id"),
        F.col("league.id").alias("api_league_id"),
        F.col("league.season").alias("season"),
        F.col("fixture.date").try_cast("timestamp").alias("kickoff_utc"),
        F.coalesce(F.col("fixture.status.short"), F.lit("NS")).alias("fixture_status"),
        F.col("teams.home.id").alias("home_team_id"),
        F.col("teams.home.name").alias("home_team_name"),
        F.col("teams.away.id").alias("away_team_id"),
        F.col("teams.away.name").alias("away_team_name"),
        F.col(hh).alias("home_team_halftime_goal"),
        F.col(ha).alias("away_team_halftime_goal"),
        F.col(h).alias("home_team_fulltime_goal"),
        F.col(a).alias("away_team_fulltime_goal"),
        result_of(h, a).alias("home_fulltime_result"),
        result_of(a, h).alias("away_fulltime_result"),
        result_of(hh, ha).alias("home_halftime_result"),
        result_of(ha, hh).alias("away_halftime_result"),
    )
    return flat, tagged.filter(F.col("reason").isNotNull())


def flatten_standings(payload: DataFrame, league_season_id: str = "league_season_id") -> DataFrame:
    """One row per team of nested standings, a list of tables of rows."""
    rows = payload.select(league_season_id, F.explode("league.standings").alias("t")).select(league_season_id, F.explode("t").alias("r"))
    return rows.select(
        league_season_id,
        F.col("r.team.id").alias("api_team_id"),
        F.col("r.team.name").alias("team_name"),
        F.col("r.rank").alias("rank"),
        F.col("r.points").alias("points"),
        F.col("r.all.played").alias("games_played"),
        F.col("r.all.win").alias("wins"),
        F.col("r.all.draw").alias("draws"),
        F.col("r.all.lose").alias("losses"),
        F.col("r.all.goals.for").alias("goals_for"),
        F.col("r.all.goals.against").alias("goals_against"),
        F.col("r.goalsDiff").alias("goal_diff"),
        F.col("r.form").alias("form"),
    )


def flatten_metadata(config: DataFrame, leagues: DataFrame, first_season: int = 2020) -> DataFrame:
    """(country, league, api_league_id, season, season_start, season_end, season_label, season_place) of a config
    tree joined to league payloads; seasons that are no whole number or before ``first_season`` drop out.

    Payloads with columns ``country`` and ``name``, what was asked for, are joined on both, so that a
    league name used in two countries keeps two ids; without them the payload's own name decides.
    """
    from touchline.functions.columns import season_label

    tree = config.select("country", F.explode("leagues").alias("l")).select("country", F.col("l.name").alias("league"))
    asked = {"country", "name"} <= set(leagues.columns)
    payload = leagues.select(
        *([F.col("country"), F.col("name").alias("league")] if asked else [F.col("league.name").alias("league")]), F.col("league.id").alias("api_league_id"), F.posexplode("seasons").alias("season_place", "s")
    )
    years = tree.join(payload, ["country", "league"] if asked else "league").withColumn("season", F.col("s.year").cast("string").try_cast("int"))
    return years.filter(F.col("season") >= first_season).select(
        "country",
        "league",
        "api_league_id",
        "season",
        F.col("s.start").try_cast("date").alias("season_start"),
        F.col("s.end").try_cast("date").alias("season_end"),
        season_label("season").alias("season_label"),
        "season_place",
    )
