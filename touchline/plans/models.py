"""The analytic models: lazy DataFrames that refer to one another by name."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from types import CodeType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.columns import iso_time, letter_of, pair_key, slugify, title_words
from touchline.operators.collect import as_json, ordered_list, payload
from touchline.operators.search import trigrams
from touchline.operators.sequences import flag_islands, latest_per, next_pointers, ordered, recent_values, running_stats, tile
from touchline.operators.shapes import EVENTS, event_flags, fan_out_events, fan_out_scopes, name_events, unpivot_sides
from touchline.operators.upsert import newer_than, numbered, replace_keys
from touchline.session import materialise, read_table
from touchline.sources.landing import publish, published

#: Statuses that take part in the analysis.
STATUSES = ["FT", "1H", "HT", "2H", "LIVE", "NS"]
#: Seeds of the relevance score, for a warehouse that isn't given others.
SEEDS = {
    "category_weights": {"result": 1.00, "special": 0.90, "goal": 0.70, "defense": 0.65},
    "threshold_multipliers": {1: 1.00, 2: 1.25},
    "composition_multipliers": {"single": 1.00, "compound": 1.35},
}
#: Events whose streak hides that of a weaker event of equal length.
STRONGER = {
    "win": ["unbeaten"],
    "loss": ["winless"],
    "score_2goals": ["score_1goal"],
    "concede_2": ["concede_1"],
    "clean_sheet": ["no_clean_sheet"],
    "Over_4_5": ["Over_3_5", "Over_2_5", "Over_1_5"],
    "Over_3_5": ["Over_2_5", "Over_1_5"],
    "Over_2_5": ["Over_1_5"],
    "Under_1_5": ["Under_2_5", "Under_3_5", "Under_4_5"],
    "Under_2_5": ["Under_3_5", "Under_4_5"],
    "Under_3_5": ["Under_4_5"],
}
#: Events that concern both teams of a match alike.
BOTH_TEAMS = ["btts", "over_1_5", "over_2_5", "over_3_5", "over_4_5", "under_1_5", "under_2_5", "under_3_5", "under_4_5"]
LONG_EVENTS = ["score_1goal", "concede_1"]
NEXT = {
    "opponent_id": "next_opponent_id",
    "opponent_name": "next_opponent_name",
    "fixture_id": "next_fixture_id",
    "kickoff_utc": "next_kickoff_utc",
    "is_home": "next_is_home",
}
_SEQUENCE = ["team_id", "event_name", "context_scope"]
_ORDER = ["kickoff_utc", "fixture_id"]

@dataclass(frozen=True)
class Model:
    """A model: its function, its kind (view, table, incremental), and how an incremental one goes on."""

    build: Callable
    kind: str
    key: tuple[str, ...] = ()
    since: tuple[str, str] | None = None
    index: tuple[str, ...] = ()
    trigrams: tuple[str, ...] = ()


_MODELS: dict[str, Model] = {}


def model(kind: str, **how):
    """Register a function of a warehouse as a model of ``kind`` view, table or incremental.

    ``key`` tells the rows of an incremental model apart, and ``since``, a source or model and its
    column, restricts a further run to its rows after the largest value the model already has.
    ``index`` are columns by which the table is looked up: it is written in ranges and sorted by
    them, so that a filter on the first reads few files and row groups. ``trigrams`` are keys and a
    text column whose trigrams are written as a table of their own, sorted by trigram.
    """

    def add(f: Callable) -> Callable:
        _MODELS[f.__name__] = Model(f, kind, **how)
        return f

    return add


def min_length(event: Column) -> Column:
    """The shortest streak of an event that counts."""
    return F.when(event.isin(LONG_EVENTS), 4).otherwise(3)


def _words(code: CodeType) -> set[str]:
    """The texts in a function, in those within it and in the helpers of this module that it calls."""
    found = {c for c in code.co_consts if isinstance(c, str)}
    for inner in code.co_consts:
        found |= _words(inner) if isinstance(inner, CodeType) else set()
    for helper in code.co_names:
        f = globals().get(helper)
        if helper.startswith("_") and getattr(f, "__module__", None) == __name__ and hasattr(f, "__code__"):
            found |= _words(f.__code__)
    return found


class Warehouse:
    """The models over the tables of one folder, as of one instant, by default the present one.

    ``ref`` builds a model once and gives the same DataFrame to all that refer to it; nothing
    runs before an action, but for the few models that write what they read several times. ``given`` puts DataFrames, or functions of the warehouse, in the place of
    sources and models. Small dimensions are joined without hints: Spark broadcasts them below its
    threshold and sorts beyond it.
    """

    def __init__(self, spark: SparkSession, root: str, as_of: datetime | None = None, **given: DataFrame | Callable) -> None:
        self.spark, self.root = spark, root
        self.as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        self._given, self._built, self._tables = given, {}, set()

    def source(self, table: str) -> DataFrame:
        if table not in self._built:
            self._built[table] = self._put(table) if table in self._given else read_table(self.spark, self.root, table)
        return self._built[table]

    def ref(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._put(name) if name in self._given else _MODELS[name].build(self)
        return self._built[name]

    def seed(self, name: str, key: str, value: str) -> DataFrame:
        """A small table of a key and a number: the first two columns of what was given (``landing.read_seed``), or the fixed values."""
        if name in self._given:
            table = self._put(name)
            return table.select(F.col(table.columns[0]).alias(key), F.col(table.columns[1]).cast("double").alias(value))
        rows = SEEDS[name]
        kind = "int" if all(isinstance(k, int) for k in rows) else "string"
        return F.broadcast(self.spark.createDataFrame(list(rows.items()), f"{key} {kind}, {value} double"))

    def written(self, name: str) -> DataFrame:
        """``ref``, as a table: one that ``build`` wrote, or one written now, once, for what reads it several times."""
        if name not in self._tables:
            self._built[name] = materialise(self.ref(name), name)
            self._tables.add(name)
        return self._built[name]

    def _put(self, name: str) -> DataFrame:
        given = self._given[name]
        return given(self) if callable(given) else given

    def limited(self, **parts: DataFrame) -> Warehouse:
        """The same warehouse with some models replaced by part of their rows.

        What those models don't depend on is shared; all that is built on them is built on the part.
        """
        shared = {n: df for n, df in self._built.items() if n not in _MODELS} | {n: self.ref(n) for n in ("int_league_context", "dim_team")}
        return Warehouse(self.spark, self.root, self.as_of, **shared | self._given | parts)

    def now(self) -> Column:
        return F.lit(self.as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")

    @staticmethod
    def names() -> dict[str, str]:
        return {name: m.kind for name, m in _MODELS.items()}

    def build(self, target: str, names: list[str] | None = None, full_refresh: bool = False, threads: int = 1) -> list[str]:
        """Write the table and incremental models to ``target``, each after those it refers to.

        A written model replaces its lazy form, so that what refers to it reads the table. Model
        functions call ``ref``, so asking for one builds what it needs. An incremental model that is
        already there takes only new rows, by its key; ``full_refresh`` builds it anew. Tables are
        written as new versions beside the old ones (``landing.publish``). With more ``threads``,
        models that don't refer to one another are written at the same time.
        """
        wanted, done, levels = names or list(_MODELS), [], {}
        for name in wanted:
            used = [levels[n] for n in self.used_by(name) if n in levels]
            levels[name] = 1 + max(used, default=0)
        for level in sorted(set(levels.values())):
            mine = [n for n in wanted if levels[n] == level]
            # plans are made one after another, as they share what is built; only the writing runs side by side
            plans = {n: self._plan(target, n, full_refresh) for n in mine}
            with ThreadPoolExecutor(max(1, threads)) as pool:
                paths = dict(pool.map(lambda n: (n, publish(plans[n], target, n)), [n for n in mine if plans[n] is not None]))
            for n in paths:
                if _MODELS[n].trigrams:
                    *keys, text = _MODELS[n].trigrams
                    found = trigrams(self.spark.read.parquet(paths[n]), keys, text)
                    publish(found.repartitionByRange("trigram").sortWithinPartitions("trigram", *keys), target, f"{n}_trigrams")
            for n, path in paths.items():
                self._built[n] = self.spark.read.parquet(path)
                self._tables.add(n)
            done += mine
        return done

    def _plan(self, target: str, name: str, full_refresh: bool) -> DataFrame | None:
        kind = _MODELS[name].kind
        if kind == "view":
            return None
        held = published(self.spark, target, name) if kind == "incremental" and not full_refresh else None
        df, by = self.ref(name) if held is None else self.next_run(name, held), _MODELS[name].index
        return df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df

    @staticmethod
    def used_by(name: str) -> set[str]:
        """All models that a model refers to, directly or not, as its code names them."""
        seen, todo = set(), [name]
        while todo:
            code = _MODELS[todo.pop()].build.__code__
            for word in _words(code):
                if word in _MODELS and word not in seen and word != name:
                    seen.add(word)
                    todo.append(word)
        return seen

    def next_run(self, name: str, held: DataFrame) -> DataFrame:
        """An incremental model after a further run: new and changed keys take the place of old ones.

        The model sees only what its source has after the mark. Columns that it gained meanwhile are
        null in old rows.
        """
        m, at = _MODELS[name], self
        if m.since:
            source, column = m.since
            fresh = newer_than(self.ref(source) if source in _MODELS else self.source(source), held, column)
            at = Warehouse(self.spark, self.root, self.as_of, **self._given | {source: fresh})
        return replace_keys(held, at.ref(name), list(m.key))


@model("view")
def stg_dim_countries(w: Warehouse) -> DataFrame:
    return w.source("dim_countries").select("country_id", "country_name", "logo_file_id")


@model("view")
def stg_dim_leagues(w: Warehouse) -> DataFrame:
    return w.source("dim_leagues").select("league_id", "api_league_id", "league_name", "country_id", "tier", "logo_file_id")


@model("view")
def stg_dim_league_seasons(w: Warehouse) -> DataFrame:
    """A season without dates is not current."""
    current = F.coalesce(w.now().cast("date").between(F.col("start_date"), F.col("end_date")), F.lit(False))
    columns = ["league_season_id", "league_id", "season", "season_label", "start_date", "end_date"]
    return w.source("dim_league_seasons").select(*columns, current.alias("is_current"))


@model("view")
def stg_dim_teams(w: Warehouse) -> DataFrame:
    return w.source("dim_teams").select("team_id", "api_team_id", "team_name", "logo_file_id", "venue_id")


@model("incremental", key=("api_fixture_id",), since=("raw_fixtures", "updated_at"))
def stg_raw_fixtures(w: Warehouse) -> DataFrame:
    """The newest delivery of each fixture, by one aggregate with map-side combining; those without an identifier all stay."""
    rows = w.source("raw_fixtures")
    rest = [c for c in rows.columns if c not in ("api_fixture_id", "updated_at", "fixture_id")]
    own = F.when(F.col("api_fixture_id").isNull(), F.col("fixture_id")).alias("own")
    newest = rows.groupBy("api_fixture_id", own).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "fixture_id")).alias("r"), F.max(F.struct("updated_at", "fixture_id")).alias("k"))
    flat = newest.select("k.fixture_id", "api_fixture_id", *[F.col(f"r.{c}") for c in rest if c != "created_at"], "r.created_at", "k.updated_at")
    return flat.withColumn("is_played", F.col("fixture_status") == "FT")


@model("view")
def stg_raw_league_standings(w: Warehouse) -> DataFrame:
    """The newest snapshot of each team and season; exact ties go by the larger values."""
    order = ["updated_at", "created_at", "form", "rank", "team_name"]
    return latest_per(w.source("raw_league_standings"), ["league_season_id", "api_team_id"], order)


@model("table")
def int_league_context(w: Warehouse) -> DataFrame:
    leagues = w.ref("stg_dim_leagues").withColumnRenamed("logo_file_id", "league_logo_file_id")
    countries = w.ref("stg_dim_countries").withColumnRenamed("logo_file_id", "country_logo_file_id")
    return (
        w.ref("stg_dim_league_seasons")
        .join(leagues, "league_id")
        .join(countries, "country_id")
        .select(
            "country_name",
            "league_name",
            "league_id",
            "api_league_id",
            "tier",
            "season",
            "league_season_id",
            "is_current",
            slugify("league_name", "league_season_id").alias("league_slug"),
            "league_logo_file_id",
            "country_logo_file_id",
        )
    )


@model("table")
def dim_team_standings(w: Warehouse) -> DataFrame:
    """Teams with their standing, one row per team and league season."""
    teams = w.ref("stg_dim_teams").withColumn("team_name", title_words("team_name")).drop("venue_id")
    standings = w.ref("stg_raw_league_standings").drop("team_name", "created_at", "updated_at", "api_league_id", "season")
    return teams.join(standings, "api_team_id").select(
        "team_id",
        "api_team_id",
        "team_name",
        slugify("team_name", "team_id").alias("team_slug"),
        "logo_file_id",
        *["rank", "points", "games_played", "wins", "draws", "losses", "goals_for", "goals_against", "goal_diff", "form"],
        "league_season_id",
    )


@model("view")
def dim_team(w: Warehouse) -> DataFrame:
    """Teams that have a standing, once each, so that joins on a team keep their rows' number.

    Whether a team has one needs no newest snapshot: the standings' keys are made distinct, on the
    map side first, and that is all of them that is read.
    """
    teams = w.ref("stg_dim_teams").withColumn("team_name", title_words("team_name"))
    placed = w.source("raw_league_standings").filter(F.col("league_season_id").isNotNull()).select("api_team_id").distinct()
    return teams.join(placed, "api_team_id", "left_semi").select("team_id", "api_team_id", "team_name", slugify("team_name", "team_id").alias("team_slug"), "logo_file_id")


@model("table")
def int_fixtures(w: Warehouse) -> DataFrame:
    """Fixtures with warehouse keys; those of unknown leagues or teams stay out."""
    context = w.ref("int_league_context").select("api_league_id", "season", "league_season_id", "league_name", "is_current")
    team = w.ref("dim_team")
    home = team.select(F.col("api_team_id").alias("h_api"), F.col("team_id").alias("h_id"), F.col("team_name").alias("h_name"))
    away = team.select(F.col("api_team_id").alias("a_api"), F.col("team_id").alias("a_id"), F.col("team_name").alias("a_name"))
    raw = w.ref("stg_raw_fixtures")
    joined = raw.join(context, ["api_league_id", "season"]).join(home, F.col("home_team_id") == F.col("h_api")).join(away, F.col("away_team_id") == F.col("a_api"))
    return joined.select(
        "fixture_id",
        "league_season_id",
        "league_name",
        "season",
        "kickoff_utc",
        F.col("h_id").alias("home_team_id"),
        F.col("a_id").alias("away_team_id"),
        F.col("h_name").alias("home_team_name"),
        F.col("a_name").alias("away_team_name"),
        F.col("home_team_fulltime_goal").alias("home_ftg"),
        F.col("away_team_fulltime_goal").alias("away_ftg"),
        F.col("home_team_halftime_goal").alias("home_htg"),
        F.col("away_team_halftime_goal").alias("away_htg"),
        F.col("home_fulltime_result").alias("home_ftr"),
        F.col("away_fulltime_result").alias("away_ftr"),
        F.col("home_halftime_result").alias("home_htr"),
        F.col("away_halftime_result").alias("away_htr"),
        "updated_at",
        "is_played",
        "fixture_status",
        "is_current",
    )


@model("view")
def int_dim_search(w: Warehouse) -> DataFrame:
    """Teams and league seasons to search for."""

    def part(df: DataFrame, kind: str, key: str, name: str, logo: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("entity_type"),
            F.col(key).alias("entity_id"),
            F.col(name).alias("name"),
            F.lower(name).alias("name_lc"),
            F.col(logo).alias("logo_file_id"),
        )

    teams = part(w.ref("dim_team_standings"), "team", "team_id", "team_name", "logo_file_id")
    return teams.unionByName(part(w.ref("int_league_context"), "league", "league_season_id", "league_name", "league_logo_file_id"))


@model("incremental", key=("fixture_id", "team_id"))
def fact_team_fixtures(w: Warehouse) -> DataFrame:
    """Two rows per fixture, with what the team plays next; all later windows reuse this shuffle by team."""
    keep = ["fixture_id", "kickoff_utc", "league_season_id", "league_name", "season", "updated_at", "is_played", "is_current"]
    sides = {
        "team_id": ("home_team_id", "away_team_id"),
        "team_name": ("home_team_name", "away_team_name"),
        "is_home": (F.lit(True), F.lit(False)),
        "goals_for": ("home_ftg", "away_ftg"),
        "goals_against": ("away_ftg", "home_ftg"),
        "halftime_goals_for": ("home_htg", "away_htg"),
        "halftime_goals_against": ("away_htg", "home_htg"),
        "fulltime_result": ("home_ftr", "away_ftr"),
        "halftime_result": ("home_htr", "away_htr"),
        "opponent_id": ("away_team_id", "home_team_id"),
        "opponent_name": ("away_team_name", "home_team_name"),
    }
    two = unpivot_sides(w.ref("int_fixtures").filter(F.col("fixture_status").isin(STATUSES)), keep, sides)
    return next_pointers(two, ["team_id"], _ORDER, NEXT).withColumn("team_pair_key", pair_key("team_id", "opponent_id"))


@model("table")
def fact_team_info(w: Warehouse) -> DataFrame:
    """Standings with the next fixture after the team's last played one."""
    pointers = ["next_fixture_id", "next_opponent_id", "next_opponent_name", "next_is_home", "next_kickoff_utc"]
    last = latest_per(w.ref("fact_team_fixtures").filter("is_played"), ["team_id"], _ORDER)
    return w.ref("dim_team_standings").drop("api_team_id").join(last.select("team_id", "league_season_id", *pointers), ["team_id", "league_season_id"], "left")


def _scoped_matches(w: Warehouse) -> DataFrame:
    """Two rows per side of a played fixture, one for each scope, with the averages of its team and scope."""
    scoped = fan_out_scopes(w.ref("fact_team_fixtures").filter("is_played"), "is_home", "context_scope")
    group = Window.partitionBy("team_id", "context_scope")
    return scoped.withColumns(
        {"avg_goals_for_context": F.avg("goals_for").over(group), "avg_goals_against_context": F.avg("goals_against").over(group)}
    )


@model("view")
def fact_team_events(w: Warehouse) -> DataFrame:
    """84 rows per played fixture. Averages of a team and scope are taken before the events fan out."""
    events = fan_out_events(_scoped_matches(w), "goals_for", "goals_against", "fulltime_result", "halftime_result")
    return events.drop("halftime_goals_for", "halftime_goals_against", "halftime_result").withColumn("is_active", F.col("event_flag") == 1)


def _streak_rows(w: Warehouse, latest: bool) -> DataFrame:
    """Runs of every event in the current seasons; with ``latest`` only each sequence's last row fans out.

    Islands of all events are found on the matches, before they fan out.
    """
    rows = _scoped_matches(w).filter("is_current")
    season = ordered(["team_id", "league_season_id"], _ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upcoming = rows.withColumns({c: F.last(c).over(season) for c in NEXT.values()})
    flags = event_flags("goals_for", "goals_against", "fulltime_result", "halftime_result")
    # a sequence's last row is also the last of its island
    found = flag_islands(upcoming, ["team_id", "context_scope"], _ORDER, flags, ends=None if latest else "next_is_home", numbers=False)
    gone = {"goals_for", "goals_against", "halftime_goals_for", "halftime_goals_against", "fulltime_result", "halftime_result", "season", "is_current", "is_played", "team_pair_key"}
    kept = [c for c in rows.columns if c not in gone]
    events = (found.filter("__tl_last") if latest else found).select(*kept, F.inline("__tl_flags"))
    home = F.col("context_checker")
    eligible = (
        F.when(F.col("context_scope") == "home", F.coalesce(home, F.lit(False)))
        .when(F.col("context_scope") == "away", F.coalesce(~home, F.lit(False)))
        .otherwise(True)
    )
    checked = events.withColumn("context_checker", F.col("next_is_home")) if latest else events.withColumnRenamed("at_end", "context_checker")
    named = name_events(checked, kept, ["event_flag", "streak_length", "context_checker"])
    return named.withColumn("is_active", F.col("event_flag") == 1).withColumns(
        {
            "is_streak_eligible": eligible,
            "current_streak_length": F.when(F.col("is_active"), F.col("streak_length")).otherwise(0),
            "min_required_length": min_length(F.col("event_name")),
        }
    )


@model("view")
def fact_team_streaks(w: Warehouse) -> DataFrame:
    """Runs of every event in the current seasons."""
    return _streak_rows(w, False)


@model("view")
def fact_team_streaks_latest(w: Warehouse) -> DataFrame:
    """Streaks that still run and are long enough, one row per team, event and scope."""
    last = _streak_rows(w, True)
    return last.filter(F.col("is_active") & (F.col("current_streak_length") >= F.col("min_required_length"))).withColumn(
        "streak_id", F.md5(F.concat_ws("::", F.col("team_id").cast("string"), "event_name", "context_scope"))
    )


@model("table", index=("team_id", "event_name", "context_scope", "fixture_id", "current_streak_length"))
def fact_team_streak_suppression(w: Warehouse) -> DataFrame:
    """Flags a streak if a stronger one of the same team, scope, fixture and length runs.

    Each streak names the events it would hide; these keys, made distinct, are one equi-join.
    """
    base = w.ref("fact_team_streaks_latest")
    on = ["team_id", "context_scope", "fixture_id", "current_streak_length"]
    hides = reduce(lambda c, kv: c.when(F.col("event_name") == kv[0], F.array(*map(F.lit, kv[1]))), STRONGER.items(), F)
    hidden = base.select(*on, F.explode(hides).alias("event_name")).distinct().withColumn("h", F.lit(True))
    flagged = base.join(hidden, [*on, "event_name"], "left")
    return flagged.withColumns(
        {
            "is_suppressed": F.coalesce("h", F.lit(False)),
            "suppression_reason": F.when(F.col("h"), "stronger_variant"),
        }
    ).drop("h", "next_is_home", "min_required_length", "updated_at", "context_checker")


@model("table")
def fact_team_streak_relevance_score(w: Warehouse) -> DataFrame:
    """weight * log2(length + 1) * multipliers; null for a type without a weight."""
    rows = w.ref("fact_team_streak_suppression").filter(~F.col("is_suppressed") & F.col("is_active"))
    weighted = (
        rows.join(w.seed("category_weights", "streak_type", "weight"), "streak_type", "left")
        .join(w.seed("threshold_multipliers", "threshold", "tm"), "threshold", "left")
        .join(w.seed("composition_multipliers", "composition", "cm"), "composition", "left")
    )
    score = F.col("weight") * F.log(2.0, F.col("current_streak_length") + 1) * F.coalesce("tm", F.lit(1.0)) * F.coalesce("cm", F.lit(1.0))
    return weighted.withColumn("relevance_score", score).drop("weight", "tm", "cm", "event_flag", "is_active", "is_suppressed", "suppression_reason")


@model("view")
def fact_team_analysis(w: Warehouse) -> DataFrame:
    team = w.ref("dim_team").select("team_id", F.col("team_name").alias("t_name"), "logo_file_id")
    scored = w.ref("fact_team_streak_relevance_score").join(team, "team_id", "left")
    return scored.select(
        "team_id",
        F.coalesce("t_name", "team_name").alias("team_name"),
        "logo_file_id",
        *["league_season_id", "league_name", "event_name", "streak_type", "composition", "polarity", "threshold", "context_scope"],
        *["current_streak_length", "streak_length", "kickoff_utc", "fixture_id", "opponent_id", "opponent_name", "is_home"],
        *["next_fixture_id", "next_kickoff_utc", "next_opponent_id", "next_opponent_name"],
        F.col("avg_goals_for_context").alias("avg_goals_for"),
        F.col("avg_goals_against_context").alias("avg_goals_against"),
        "relevance_score",
    )


@model("table")
def fact_team_stats(w: Warehouse) -> DataFrame:
    """Running record of each team in each season."""
    context = w.ref("int_league_context").select("league_season_id", "league_id", F.col("country_name").alias("country"))
    played = w.ref("fact_team_fixtures").filter("is_played").join(context, "league_season_id", "left")
    keys = ["league_season_id", "team_id"]
    base = played.withColumnsRenamed({"fulltime_result": "result", "goals_for": "goals_scored", "goals_against": "goals_conceded"})
    stats = running_stats(base, keys, _ORDER, "result", "goals_scored", "goals_conceded")
    return recent_values(stats, keys, "recency_rank", "result", 5, "recent_form").select(
        *["fixture_id", "kickoff_utc", "team_name", "team_id", "is_home", "league_name", "league_id", "league_season_id", "country", "season"],
        *["result", "opponent_name", "opponent_id", "games_played", "wins", "draws", "losses", "points", "goals_scored", "goals_conceded"],
        *["win_rate", "draw_rate", "loss_rate", "avg_goals_for", "avg_goals_against"],
        *["next_opponent_id", "next_opponent_name", "next_fixture_id", "next_kickoff_utc"],
        F.col("recency_rank").alias("rank"),
        "recent_form",
    )


@model("view")
def elo_rating(w: Warehouse) -> DataFrame:
    """Ratings from outside the models: the table of that name; an error where there is none."""
    return w.source("elo_rating").select("team_id", "league_season_id", "fixture_id", "pre_elo_rating", "snapshot_type")


@model("view")
def int_events_with_tier(w: Warehouse) -> DataFrame:
    """Events with the third of the season, by rating, in which the opponent stands.

    NTILE over all event rows in order of rating, fixture, team, event and scope, without sorting
    them: every match of a team gives the same 42 rows in a known order, so matches are ranked and
    a row's number follows from its match's rank and its own place among the 42.
    """
    elo = w.ref("elo_rating").filter("snapshot_type = 'match'")
    opponent = elo.select(F.col("team_id").alias("opponent_id"), "fixture_id", "pre_elo_rating")
    columns = ["league_season_id", "fixture_id", "team_id", "opponent_id", "is_home", "goals_for", "goals_against", "fulltime_result", "halftime_result"]
    played = w.ref("fact_team_fixtures").filter("is_played").select(*columns).join(opponent, ["opponent_id", "fixture_id"])
    ranked = played.withColumns(
        {
            "r": F.row_number().over(ordered(["league_season_id"], ["pre_elo_rating", "fixture_id", "team_id"])),
            "n": F.count(F.lit(1)).over(Window.partitionBy("league_season_id")),
        }
    )
    events = fan_out_events(fan_out_scopes(ranked, "is_home", "context_scope"), "goals_for", "goals_against", "fulltime_result", "halftime_result")
    names = F.array(*map(F.lit, sorted(e[0] for e in EVENTS)))
    each = 2 * len(EVENTS)
    place = (F.array_position(names, F.col("event_name")) - 1) * 2 + F.when(F.col("context_scope") == "all", 0).otherwise(1)
    row = (F.col("r") - 1) * each + place
    return events.select(
        *["league_season_id", "fixture_id", "team_id", "event_name", "context_scope", "event_flag"],
        tile(row, F.col("n") * each, 3).cast("int").alias("opponent_tier"),
    )


_TIER = ["league_season_id", "event_name", "context_scope"]


@model("view")
def int_opponent_tier_mu(w: Warehouse) -> DataFrame:
    grouped = w.ref("int_events_with_tier").groupBy(*_TIER, "opponent_tier")
    return grouped.agg(
        F.count(F.lit(1)).alias("n_matches"), F.sum("event_flag").alias("n_occurrences"), F.round(F.avg("event_flag"), 6).alias("mu_tier")
    ).filter("n_matches >= 15")


@model("view")
def int_tier_event_divergence(w: Warehouse) -> DataFrame:
    """Each tier's rate against the plain mean of the tiers' rates."""
    rates = w.ref("int_events_with_tier").groupBy(*_TIER, "opponent_tier").agg(F.count(F.lit(1)).alias("n_matches"), F.avg("event_flag").alias("rate"))
    mean = F.avg("rate").over(Window.partitionBy(*_TIER))
    return rates.withColumn("mean", mean).select(
        *_TIER,
        "opponent_tier",
        "n_matches",
        F.round("rate", 6).alias("event_rate"),
        F.round("mean", 6).alias("unconditional_rate"),
        F.round(F.abs(F.col("rate") - F.col("mean")), 6).alias("abs_divergence"),
    )


@model("view")
def int_tier_sensitive_events(w: Warehouse) -> DataFrame:
    """Events whose rate depends on the opponent's tier by more than a threshold that adapts.

    The median over a season's events, at most 63 rows, is a window, so the rates are computed once.
    """
    mean = w.ref("int_tier_event_divergence").groupBy(*_TIER).agg(F.avg("abs_divergence").alias("d"), F.min("n_matches").alias("min_tier_n"))
    median = F.percentile("d", 0.5).over(Window.partitionBy("league_season_id"))
    floor = F.lit(0.03) + F.lit(0.03) * F.exp(-F.col("min_tier_n") / F.lit(60.0))
    scaled = mean.withColumn("m", median).withColumns({"f": floor, "s": F.least(F.lit(0.06), F.col("m") * 1.2)})
    return scaled.filter(F.col("league_season_id").isNotNull()).withColumn("t", F.greatest("f", "s")).select(
        *_TIER,
        "min_tier_n",
        F.round("d", 6).alias("avg_abs_divergence"),
        F.round("f", 6).alias("dynamic_floor"),
        F.round("s", 6).alias("league_scale"),
        F.round("t", 6).alias("threshold"),
        (F.col("d") >= F.col("t")).alias("is_tier_sensitive"),
    )


@model("incremental", key=("team_fixture_key",), since=("fact_team_fixtures", "updated_at"))
def fact_head_to_head(w: Warehouse) -> DataFrame:
    columns = ["league_season_id", "league_name", "season", "fixture_id", "team_id", "team_name", "opponent_id", "opponent_name", "kickoff_utc"]
    columns += ["goals_for", "goals_against", "halftime_result", "fulltime_result", "is_home", "is_current", "is_played", "updated_at", "team_pair_key"]
    return w.ref("fact_team_fixtures").filter("is_played").select(
        *columns,
        F.when(F.col("is_home"), "home").otherwise("away").alias("h2h_context_scope"),
        F.concat_ws("_", "team_id", "fixture_id").alias("team_fixture_key"),
    )


_MET = ["league_season_id", "league_name", "season", "fixture_id", "team_id", "team_name", "opponent_id", "opponent_name", "kickoff_utc"]
_MET += ["fulltime_result", "is_home", "is_current", "updated_at", "team_pair_key"]


@model("table")
def fact_head_to_head_events(w: Warehouse) -> DataFrame:
    """Events by opponent."""
    scoped = fan_out_scopes(w.ref("fact_team_fixtures").filter("is_played"), "is_home", "h2h_context_scope")
    events = fan_out_events(scoped, "goals_for", "goals_against", "fulltime_result", "halftime_result")
    return events.select(*_MET, "event_name", "event_flag", "streak_type", "polarity", "h2h_context_scope")


def _meeting_rows(w: Warehouse, latest: bool) -> DataFrame:
    """Runs of events between two teams, found on the meetings; with ``latest`` only the last row of each event that has it fans out."""
    scoped = fan_out_scopes(w.ref("fact_team_fixtures").filter("is_played"), "is_home", "h2h_context_scope")
    flags = event_flags("goals_for", "goals_against", "fulltime_result", "halftime_result")
    found = flag_islands(scoped, ["team_id", "opponent_id", "h2h_context_scope"], _ORDER, flags, totals=True)
    listed = F.filter("__tl_flags", lambda x: x["latest"]) if latest else F.col("__tl_flags")
    events = found.select(*_MET, "h2h_context_scope", F.inline(listed))
    length = F.when(F.col("event_flag") == 1, F.col("streak_length")).otherwise(0)
    counted = events.withColumns({"streak_length": length, "current_streak_length": length}).withColumnsRenamed(
        {"island": "streak_id", "n_rows": "total_event_count", "n_flagged": "total_event_flag_sum"}
    )
    columns = ["event_flag", "streak_id", "streak_length", "current_streak_length", "total_event_count", "total_event_flag_sum"]
    named = name_events(counted, [*_MET, "h2h_context_scope"], columns)
    return named.drop("composition", "threshold").withColumn("min_required_length", min_length(F.col("event_name")))


@model("table")
def fact_head_to_head_streaks(w: Warehouse) -> DataFrame:
    """Runs of events between two teams; lengths are 0 off a run, totals cover the whole sequence."""
    return _meeting_rows(w, False)


@model("view")
def fact_head_to_head_latest(w: Warehouse) -> DataFrame:
    """The last occurrence of each event between two teams, whether or not it still runs."""
    renamed = {
        "event_flag": "latest_event_flag",
        "streak_length": "latest_streak_length",
        "fixture_id": "latest_fixture_id",
        "kickoff_utc": "latest_kickoff_utc",
        "is_home": "latest_is_home",
    }
    gone = ["fulltime_result", "is_current", "streak_id", "current_streak_length", "min_required_length"]
    return _meeting_rows(w, True).withColumnsRenamed(renamed).drop(*gone)


@model("table")
def mart_team_info(w: Warehouse) -> DataFrame:
    return w.ref("fact_team_info")


@model("table")
def mart_fixture_info(w: Warehouse) -> DataFrame:
    """Fixtures that are next for at least one of their teams; the other side's columns may be null."""
    info = w.ref("mart_team_info")
    team = info.select("team_id", "team_name", "team_slug", "logo_file_id", "form", F.col("next_fixture_id").alias("fixture_id"))
    sides = w.ref("fact_team_fixtures").select("fixture_id", "team_id", "is_home", "team_pair_key").join(team, ["team_id", "fixture_id"])
    card = payload(
        team_id=F.col("team_id"),
        team_name=F.col("team_name"),
        shortname=F.lit(None).cast("string"),
        team_slug=F.col("team_slug"),
        logo_file_id=F.col("logo_file_id"),
        form=F.col("form"),
    )
    home, away = F.col("is_home"), ~F.col("is_home")
    rolled = sides.withColumn("card", card).groupBy("fixture_id").agg(
        F.max("team_pair_key").alias("team_pair_key"),
        F.max(F.when(home, F.col("team_id"))).alias("home_team_id"),
        F.max(F.when(away, F.col("team_id"))).alias("away_team_id"),
        F.max(F.when(home, F.col("team_slug"))).alias("hs"),
        F.max(F.when(away, F.col("team_slug"))).alias("as"),
        F.max_by(F.when(home, F.col("card")), F.when(home, F.col("team_id"))).alias("hc"),
        F.max_by(F.when(away, F.col("card")), F.when(away, F.col("team_id"))).alias("ac"),
    )
    slug = F.concat_ws("-", "hs", "as", F.col("fixture_id").cast("string"))
    info_json = payload(fixture_id=F.col("fixture_id"), fixture_slug=slug, team_info=payload(home=F.col("hc"), away=F.col("ac")))
    return rolled.select(
        "fixture_id", "team_pair_key", "home_team_id", "away_team_id", slug.alias("fixture_slug"), as_json(info_json).alias("fixture_info_json")
    )


@model("view")
def mart_team_streaks(w: Warehouse) -> DataFrame:
    rows = w.ref("fact_team_streak_suppression").filter(~F.col("is_suppressed") & F.col("is_active"))
    return rows.select(
        *["streak_id", "team_id", "team_name", "event_name", "streak_type"],
        F.col("current_streak_length").alias("streak_length"),
        "polarity",
        F.col("context_scope").alias("scope"),
        *["is_streak_eligible", "league_season_id", "league_name"],
        F.col("next_opponent_id").alias("opponent_id"),
        F.col("next_opponent_name").alias("opponent_name"),
        F.col("next_fixture_id").alias("fixture_id"),
        F.col("next_kickoff_utc").alias("kickoff_utc"),
    )


def _streak_card() -> Column:
    return payload(
        event_name=F.col("event_name"),
        count=F.col("streak_length"),
        total=F.lit(None).cast("string"),
        scope=F.when(F.col("scope") == "all", "overall").otherwise(F.col("scope")),
        polarity=F.col("polarity"),
    )


@model("view")
def mart_fixture_streaks(w: Warehouse) -> DataFrame:
    info = w.ref("mart_fixture_info").select("fixture_id", "fixture_slug", "team_pair_key", "home_team_id", "away_team_id")
    rows = w.ref("mart_team_streaks").filter(F.col("is_streak_eligible") & F.col("fixture_id").isNotNull())
    return rows.join(info, "fixture_id", "left").withColumn("fixture_streak_json", as_json(_streak_card())).drop("streak_id", "is_streak_eligible")


@model("table")
def mart_head_to_head_fixtures(w: Warehouse) -> DataFrame:
    return w.ref("fact_head_to_head")


def _meetings_rolled(w: Warehouse) -> DataFrame:
    """One row per pair of teams: the list of its streaks, and the wins and draws of each team by its id."""
    scope = F.col("h2h_context_scope")
    teams = F.when(F.lower("event_name").isin(BOTH_TEAMS), "both").otherwise(scope)
    card = payload(
        **{c: F.col(c) for c in ["team_id", "team_name", "opponent_id", "opponent_name", "event_name", "streak_type", "polarity"]},
        scope=scope,
        streak_length=F.col("latest_streak_length"),
        total=F.col("total_event_flag_sum"),
        teams=teams,
        fixture_id=F.col("latest_fixture_id"),
        kickoff_utc=iso_time("latest_kickoff_utc"),
        is_home=F.col("latest_is_home"),
    )
    order = [(F.col("latest_streak_length"), True), (F.col("event_name"), False), (F.col("team_id"), False), (scope, False)]

    def by_team(event: str) -> Column:
        totals = F.struct("team_id", F.struct(F.col("total_event_count").alias("n"), F.col("total_event_flag_sum").alias("hits")))
        return F.map_from_entries(F.collect_list(F.when((scope == "all") & (F.col("event_name") == event), totals)))

    return w.ref("fact_head_to_head_latest").groupBy("team_pair_key").agg(
        as_json(ordered_list(card, order)).alias("h2h_streaks_json"), F.max("updated_at").alias("updated_at"), by_team("win").alias("wins"), by_team("draw").alias("drawn")
    )


@model("table")
def mart_head_to_head_streaks(w: Warehouse) -> DataFrame:
    return _meetings_rolled(w).select("team_pair_key", "h2h_streaks_json", "updated_at")


@model("table")
def mart_head_to_head_matches(w: Warehouse) -> DataFrame:
    """The last five meetings of the two teams of each coming fixture."""
    meetings = w.ref("fact_head_to_head")
    home, away = F.col("is_home"), ~F.col("is_home")
    matches = meetings.groupBy("fixture_id", "team_pair_key").agg(
        F.max("kickoff_utc").cast("date").alias("kickoff_date"),
        F.max(F.when(home, F.col("team_id"))).alias("home_team_id"),
        F.max(F.when(home, F.col("goals_for"))).alias("hg"),
        F.max(F.when(away, F.col("goals_for"))).alias("ag"),
    )
    current = w.ref("mart_fixture_info").select(F.col("fixture_id").alias("current_fixture_id"), "team_pair_key", F.col("home_team_id").alias("current_home"))
    scope = meetings.select("fixture_id", "team_pair_key", F.col("team_id").alias("current_home"), "h2h_context_scope")
    joined = matches.join(current, "team_pair_key").join(scope, ["fixture_id", "team_pair_key", "current_home"], "left")
    top = joined.withColumn("day", F.unix_date("kickoff_date"))
    last = latest_per(top, ["current_fixture_id"], ["day", "fixture_id"], 5)
    result = F.when(F.col("hg") > F.col("ag"), "H").when(F.col("hg") == F.col("ag"), "D").otherwise("A")
    card = payload(
        date=F.col("kickoff_date").cast("string"),
        home=F.col("hg"),
        away=F.col("ag"),
        result=result,
        isHomeTeamHome=F.col("home_team_id") == F.col("current_home"),
    )
    order = [(F.col("day"), True), (F.col("fixture_id"), True)]
    return last.groupBy("team_pair_key", "current_fixture_id").agg(
        as_json(ordered_list(card, order)).alias("h2h_matches_json"),
        as_json(ordered_list(F.col("h2h_context_scope"), order)).alias("h2h_context_scopes_json"),
    )


@model("table")
def mart_head_to_head_info(w: Warehouse) -> DataFrame:
    """Totals of the two teams of each coming fixture; null where a side's event never happened.

    Only meetings of pairs that have a coming fixture fan out into events, and once. All sides of
    fixtures, the coming fixtures and these pairs' rows are read several times, so they are tables.
    """
    fixtures, info = w.written("fact_team_fixtures"), w.written("mart_fixture_info")
    current = info.select(F.col("fixture_id").alias("current_fixture_id"), "team_pair_key", "home_team_id", "away_team_id")
    ahead = fixtures.join(current.select("team_pair_key").distinct(), "team_pair_key", "left_semi")
    part = w.limited(fact_team_fixtures=materialise(ahead, "meetings"), mart_fixture_info=info)
    of = lambda table, side: F.try_element_at(table, F.col(f"{side}_team_id"))
    counts = F.struct(
        of("wins", "home").n.alias("totalMatches"), of("wins", "home").hits.alias("homeWins"), of("drawn", "home").hits.alias("draws"), of("wins", "away").hits.alias("awayWins")
    )
    info = current.join(_meetings_rolled(part), "team_pair_key").select("team_pair_key", "current_fixture_id", as_json(counts).alias("h2h_info_json"), "h2h_streaks_json")
    return info.join(part.ref("mart_head_to_head_matches"), ["team_pair_key", "current_fixture_id"], "left")


@model("table")
def mart_team_stats(w: Warehouse) -> DataFrame:
    return w.ref("fact_team_stats").drop("fixture_id", "points")


@model("view")
def mart_team_fixture(w: Warehouse) -> DataFrame:
    """The last five matches of each team in each scope."""
    scoped = fan_out_scopes(w.ref("fact_team_fixtures").filter("is_played"), "is_home", "context_scope", "overall")
    last = latest_per(scoped, ["team_id", "context_scope"], _ORDER, 5)
    card = payload(
        date=F.col("kickoff_utc").cast("date").cast("string"),
        opponent=F.col("opponent_name"),
        score=F.concat_ws("-", "goals_for", "goals_against"),
        result=letter_of("fulltime_result"),
        isHome=F.col("is_home"),
    )
    order = [(F.unix_micros("kickoff_utc"), True), (F.col("fixture_id"), True)]
    return last.groupBy("team_id", "team_name", "context_scope").agg(as_json(ordered_list(card, order)).alias("fixtures_json"))


@model("view")
def mart_teams_fixture_stats(w: Warehouse) -> DataFrame:
    stats = w.ref("mart_team_stats")
    mine = ["next_fixture_id", "next_kickoff_utc", "league_season_id", "league_name", "team_id", "team_name", "season", "games_played", "wins", "draws", "losses"]
    both = ["win_rate", "draw_rate", "loss_rate", "avg_goals_for", "avg_goals_against", "recent_form"]
    other = stats.select("next_fixture_id", F.col("team_id").alias("next_opponent_id"), F.col("team_name").alias("next_opponent_name"), *[F.col(c).alias(f"opponent_{c}") for c in both])
    return stats.select(*mine, *both, "next_opponent_id").join(other, ["next_fixture_id", "next_opponent_id"])


@model("view")
def mart_teams_fixture_streaks(w: Warehouse) -> DataFrame:
    """Streaks of a team beside those of its last opponent, where both meet the same fixture next."""
    latest = w.ref("fact_team_streaks_latest")
    two = ["event_name", "streak_type", "event_flag"]
    mine = latest.filter("context_scope = 'all'").select(
        *["team_id", "team_name", "league_season_id", "league_name", "next_fixture_id", "next_kickoff_utc", "is_home", "opponent_id"],
        *[F.col(c).alias(f"team_{c}") for c in two],
        F.col("current_streak_length").alias("team_streak_length"),
    )
    other = latest.select(
        F.col("team_id").alias("opponent_id"),
        F.col("team_name").alias("opponent_name"),
        "next_fixture_id",
        *[F.col(c).alias(f"opponent_{c}") for c in two],
        F.col("current_streak_length").alias("opponent_streak_length"),
    )
    return mine.join(other, ["next_fixture_id", "opponent_id"])


@model("table", trigrams=("entity_type", "entity_id", "name_lc"))
def mart_dim_search(w: Warehouse) -> DataFrame:
    return w.ref("int_dim_search")


@model("table")
def mart_nav_leagues(w: Warehouse) -> DataFrame:
    return w.ref("int_league_context").select("country_name", "league_name", "country_logo_file_id", "league_logo_file_id", "league_season_id")


@model("table")
def mart_league_info(w: Warehouse) -> DataFrame:
    return w.ref("int_league_context").select("league_season_id", "league_name", "league_slug", F.col("season").alias("season_label"), "country_name")


@model("table")
def mart_league_teams(w: Warehouse) -> DataFrame:
    """Of a team's row only its standing is wanted here, which needs no fixtures."""
    return w.ref("dim_team_standings").select(
        "team_id", "team_name", "team_slug", F.col("rank").alias("team_rank"), F.col("form").alias("team_form"), "logo_file_id", "league_season_id"
    )


@model("view")
def mart_homepage_top_streaks(w: Warehouse) -> DataFrame:
    """Streaks of matches within seven days, best first.

    A streak's next match is that of one of its team's rows, so only teams with such a row fan out;
    that is known by a window in the partitions that the pointers already have.
    """
    team = w.ref("dim_team").select("team_id", "team_name", F.col("logo_file_id").alias("team_logo_file_id"))
    league = w.ref("int_league_context").select("league_season_id", "league_name", "league_logo_file_id", "country_name", "country_logo_file_id")
    soon = (F.col("next_kickoff_utc") > w.now()) & (F.col("next_kickoff_utc") < w.now() + F.expr("interval 7 days"))
    playing = F.bool_or(F.coalesce(soon & F.col("is_played") & F.col("is_current"), F.lit(False))).over(Window.partitionBy("team_id"))
    ahead = w.ref("fact_team_fixtures").withColumn("__tl_soon", playing).filter("__tl_soon").drop("__tl_soon")
    scores = w.limited(fact_team_fixtures=ahead).ref("fact_team_streak_relevance_score")
    rows = latest_per(scores, _SEQUENCE, _ORDER).filter(soon & F.col("is_streak_eligible"))
    joined = rows.drop("team_name", "league_name").join(team, "team_id").join(league, "league_season_id")
    return joined.select(
        *["streak_id", "team_id", "team_name", "team_logo_file_id", "league_season_id", "league_name", "league_logo_file_id"],
        *["country_name", "country_logo_file_id", "event_name", "streak_type", "context_scope"],
        F.col("current_streak_length").alias("streak_length"),
        *["next_fixture_id", "next_kickoff_utc", "next_opponent_id", "next_opponent_name", "relevance_score"],
    ).orderBy(F.desc_nulls_first("relevance_score"), F.desc("streak_length"), F.asc("team_name"), "streak_id")


@model("table")
def mart_top_team_streaks(w: Warehouse) -> DataFrame:
    """Eligible streaks, numbered in order of team, season, event, type and scope."""
    rows = w.ref("fact_team_streaks_latest").filter("is_streak_eligible")
    columns = ["team_id", "league_name", "team_name", "next_opponent_name", "next_opponent_id", "next_fixture_id"]
    columns += ["next_kickoff_utc", "event_name", "streak_type", "context_scope", "current_streak_length"]
    order = ["team_id", "league_season_id", "event_name", "streak_type", "context_scope"]
    return numbered(rows.select(*columns, "league_season_id"), order, "streak_id").select("streak_id", *columns)


def of_teams(w: Warehouse, team_ids: list) -> Warehouse:
    """The warehouse of a few teams: their standings and their own rows of the fixtures, before anything fans out."""
    ids = [i for i in team_ids if i is not None]
    api = [r[0] for r in w.ref("stg_dim_teams").filter(F.col("team_id").isin(ids)).select("api_team_id").collect()]
    fixtures = w.written("int_fixtures")
    both = F.col("home_team_id").isin(ids) | F.col("away_team_id").isin(ids)
    part = w.limited(
        stg_raw_league_standings=w.ref("stg_raw_league_standings").filter(F.col("api_team_id").isin(api)), int_fixtures=fixtures.filter(both)
    )
    # the other sides of these matches have gaps, so only the teams' own rows stay
    return part.limited(fact_team_fixtures=materialise(part.ref("fact_team_fixtures").filter(F.col("team_id").isin(ids)), "team-fixtures"))


def mart_fixture_page_context(w: Warehouse, fixture_id: int) -> DataFrame:
    """One row of payloads for a fixture. Its two teams are looked up first, and only their rows are worked on."""
    teams = w.written("int_fixtures").filter(F.col("fixture_id") == fixture_id).select("home_team_id", "away_team_id").first()
    w = of_teams(w, list(teams or []))
    fixture = w.ref("mart_fixture_info").filter(F.col("fixture_id") == fixture_id)
    w = w.limited(mart_fixture_info=fixture)
    streaks = w.ref("mart_fixture_streaks").filter(F.col("fixture_id") == fixture_id)
    order = [(F.col("streak_length"), True), (F.col("event_name"), False), (F.col("scope"), False)]
    home, away = F.col("team_id") == F.col("home_team_id"), F.col("team_id") == F.col("away_team_id")
    card = _streak_card()
    listed = streaks.groupBy("fixture_id").agg(ordered_list(card, order, home).alias("h"), ordered_list(card, order, away).alias("a"))
    empty = lambda c: F.when(F.size(c) > 0, F.col(c))
    streak_json = listed.select("fixture_id", as_json(payload(home=empty("h"), away=empty("a"))).alias("fixture_streaks_json"))
    h2h = w.ref("mart_head_to_head_info").filter(F.col("current_fixture_id") == fixture_id).drop("team_pair_key").withColumnRenamed("current_fixture_id", "fixture_id")
    sides = fixture.select("fixture_id", "home_team_id", "away_team_id", F.explode(F.array_distinct(F.array("home_team_id", "away_team_id"))).alias("team_id"))
    lists = w.ref("mart_team_fixture").join(sides, "team_id")
    scope = F.col("context_scope")

    def of(side: Column, column: str, *scopes: str) -> Column:
        return F.max(F.when(side & (scope.isin(*scopes) if scopes else F.lit(True)), F.col(column)))

    # a list's JSON text goes into the page as it is
    def part(side: Column, name: str) -> Column:
        head = as_json(F.struct(of(side, "team_id").alias("team_id"), of(side, "team_name").alias("team_name")))
        body = [F.concat(F.lit(f',"{s}":'), F.coalesce(of(side, "fixtures_json", s), F.lit("null"))) for s in ("overall", name)]
        return F.concat(F.lit(f'"{name}":'), head.substr(F.lit(1), F.length(head) - 1), *body, F.lit("}"))

    pages = lists.groupBy("fixture_id").agg(F.concat(F.lit("{"), part(home, "home"), F.lit(","), part(away, "away"), F.lit("}")).alias("team_fixtures_json"))
    side = '{"team_id":null,"team_name":null,"overall":null,"%s":null}'
    nothing = '{"home":' + side % "home" + ',"away":' + side % "away" + "}"  # for teams that haven't played
    page = fixture.join(streak_json, "fixture_id", "left").join(h2h, "fixture_id", "left").join(pages, "fixture_id", "left")
    return page.withColumn("team_fixtures_json", F.coalesce("team_fixtures_json", F.lit(nothing)))


def mart_team_page_context(w: Warehouse, team_id: int) -> DataFrame:
    """Payloads for a team, one row per season it has a standing in. Only its own matches fan out."""
    everyone, w = w, of_teams(w, [team_id])
    team = w.ref("mart_team_info").filter(F.col("team_id") == team_id)
    peer = payload(teamId=F.col("team_id"), name=F.col("team_name"), teamHref=F.col("team_slug"), logoFileId=F.col("logo_file_id"))
    peers = everyone.ref("mart_league_teams").filter(F.col("team_id") != team_id).join(team.select("league_season_id").distinct(), "league_season_id", "left_semi")
    listed = peers.groupBy("league_season_id").agg(as_json(ordered_list(peer, [(F.col("team_rank"), False), (F.col("team_id"), False)])).alias("league_teams_json"))
    card = payload(
        teamId=F.col("team_id"),
        streakId=F.col("streak_id"),
        eventName=F.col("event_name"),
        streakType=F.col("streak_type"),
        streakLength=F.col("streak_length"),
        polarity=F.col("polarity"),
        scope=F.col("scope"),
    )
    order = [(F.col("streak_length"), True), (F.col("event_name"), False), (F.col("scope"), False)]
    streaks = w.ref("mart_team_streaks").filter(F.col("team_id") == team_id).groupBy("team_id").agg(as_json(ordered_list(card, order)).alias("streaks_json"))
    league = w.ref("mart_league_info").select("league_season_id", "league_name", "season_label", "country_name")
    return (
        team.join(league, "league_season_id", "left")
        .join(listed, "league_season_id", "left")
        .join(streaks, "team_id", "left")
        .select(
            *["team_id", "team_name", "team_slug", "rank", "form", "league_name", "season_label", "country_name", "league_teams_json"],
            *["streaks_json", "next_fixture_id", "next_opponent_id", "next_opponent_name", "next_is_home", "next_kickoff_utc"],
        )
    )
