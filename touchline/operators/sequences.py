"""Ordered sequences: islands of a flag, latest rows, pointers, running statistics, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import array_text, round_ratio


def ordered(keys: list[str], order: list[str], descending: bool = False):
    """A window over ``keys`` in ``order`` with nulls last either way."""
    if descending:
        return Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])


def islands(df: DataFrame, keys: list[str], order: list[str], flag: str, position: str = "rn", island: str = "island", length: str = "streak_length") -> DataFrame:
    """Number rows, islands of ones, and rows within an island, all in one sort.

    An island opens at a row whose flag is 1 after a row (or none) whose flag is 0, and lasts until
    the next opens; trailing zeros belong to it. A null flag neither opens an island nor lets the
    next row open one. ``order`` should be unique within ``keys``.
    """
    w = ordered(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumns({position: F.row_number().over(w), "__tl_prev": F.lag(flag, 1, 0).over(w)})
    opens = (F.col(flag) == 1) & (F.col("__tl_prev") == 0)
    # all windows share one order, so the rows are sorted once; a length counts from the last opening
    start = F.coalesce(F.max(F.when(opens, F.col(position))).over(so_far), F.lit(1))
    return numbered.withColumns({island: F.sum(F.when(opens, 1).otherwise(0)).over(so_far), length: F.col(position) - start + 1}).drop("__tl_prev")


def flag_islands(df: DataFrame, keys: list[str], order: list[str], flags: list[Column], ends: str | None = None, totals: bool = False, numbers: bool = True) -> DataFrame:
    """Islands of many flags of the same rows at once, before the rows fan out into one for each flag.

    Adds ``__tl_rn`` (place of the row), ``__tl_last`` (whether it is the last), and an array
    ``__tl_flags`` of (__tl_event, event_flag, streak_length) structs, one for each flag: lengths as
    ``islands`` gives them. With ``numbers`` the structs also have the island, and latest, whether no
    later row has the flag; with ``ends`` also ``at_end``, the value of that column in the last row of
    the island; with ``totals`` n_rows and n_flagged of the key. All is done in two sorts of the
    rows, so that sorting costs as little as there are rows, not rows times flags.
    """
    up = ordered(keys, order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_first(c) for c in order])
    so_far, rest = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, 0)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = range(len(flags))
    f, o, e = ([f"__tl_{kind}{i}" for i in n] for kind in "foe")
    rows = df.withColumns({f[i]: flags[i] for i in n}).withColumns({"__tl_rn": F.row_number().over(up)} | {o[i]: F.lag(f[i], 1, 0).over(up) for i in n})
    rows = rows.withColumns({o[i]: F.coalesce((F.col(f[i]) == 1) & (F.col(o[i]) == 0), F.lit(False)) for i in n})
    number = {f"__tl_i{i}": F.sum(F.col(o[i]).cast("int")).over(so_far) for i in n} if numbers else {}
    start = {f"__tl_s{i}": F.max(F.when(F.col(o[i]), F.col("__tl_rn"))).over(so_far) for i in n}
    latest = {f"__tl_l{i}": F.max(F.when(F.col(f[i]) == 1, F.col("__tl_rn"))).over(whole) for i in n} if numbers else {}
    over_all = {"__tl_n": F.count(F.lit(1)).over(whole)}
    if totals:
        over_all |= {f"__tl_t{i}": F.sum(f[i]).over(whole) for i in n}
    rows = rows.withColumns(number | start).withColumns(latest | over_all)
    if ends:
        # the last row of an island is the one before an opening, or the last of all; null is told from no such row
        closes = {e[i]: F.coalesce(F.lag(o[i]).over(down), F.lit(True)) for i in n}
        value = F.struct(F.col(ends).alias("v"))
        rows = rows.withColumns(closes).withColumns({e[i]: F.last(F.when(F.col(e[i]), value), ignorenulls=True).over(rest) for i in n})

    def item(i: int) -> Column:
        length = F.col("__tl_rn") - F.coalesce(f"__tl_s{i}", F.lit(1)) + 1
        parts = [F.lit(i).alias("__tl_event"), F.col(f[i]).alias("event_flag"), length.alias("streak_length")]
        parts += [F.col(f"__tl_i{i}").alias("island"), (F.col(f"__tl_l{i}") == F.col("__tl_rn")).alias("latest")] if numbers else []
        parts += [F.col(f"{e[i]}.v").alias("at_end")] if ends else []
        parts += [F.col("__tl_n").alias("n_rows"), F.col(f"__tl_t{i}").alias("n_flagged")] if totals else []
        return F.struct(*parts)

    return rows.select(*df.columns, "__tl_rn", (F.col("__tl_rn") == F.col("__tl_n")).alias("__tl_last"), F.array(*map(item, n)).alias("__tl_flags"))


def latest_per(df: DataFrame, keys: list[str], order: list[str], n: int = 1, rank: str | None = None) -> DataFrame:
    """The last ``n`` rows of each key in ``order``; ``rank`` names a column for the position."""
    name = rank or "__tl_rank"
    found = df.withColumn(name, F.row_number().over(ordered(keys, order, True))).filter(F.col(name) <= n)
    return found if rank else found.drop(name)


def next_pointers(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Values of the following row of each key: output name by source column, null at the end."""
    w = ordered(keys, order)
    return df.withColumns({out: F.lead(c).over(w) for c, out in columns.items()})


def running_stats(df: DataFrame, keys: list[str], order: list[str], result: str, scored: str, conceded: str) -> DataFrame:
    """Running games, wins, draws, losses, goals, points and rates up to each row, one sort in all.

    Adds games_played, wins, draws, losses, total_goals_for, total_goals_against, points (longs),
    win_rate, draw_rate, loss_rate, avg_goals_for, avg_goals_against (two digits, half up) and
    recency_rank (1 is the newest). Averages leave null goals out; sums of nothing are null.
    """
    run = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)

    def total(x: Column) -> Column:
        return F.sum(x).over(run)

    def is_(r: str) -> Column:
        return F.when(F.col(result) == r, 1).otherwise(0)

    counted = df.withColumns(
        {
            "games_played": F.count(F.lit(1)).over(run),
            "wins": total(is_("win")),
            "draws": total(is_("draw")),
            "losses": total(is_("loss")),
            "points": total(is_("win") * 3 + is_("draw")),
            "total_goals_for": total(F.col(scored)),
            "total_goals_against": total(F.col(conceded)),
            "__tl_nf": F.count(scored).over(run),
            "__tl_na": F.count(conceded).over(run),
            "recency_rank": F.row_number().over(ordered(keys, order, True)),
        }
    )
    return counted.withColumns(
        {
            "win_rate": round_ratio("wins", "games_played", 2),
            "draw_rate": round_ratio("draws", "games_played", 2),
            "loss_rate": round_ratio("losses", "games_played", 2),
            "avg_goals_for": round_ratio("total_goals_for", "__tl_nf", 2),
            "avg_goals_against": round_ratio("total_goals_against", "__tl_na", 2),
        }
    ).drop("__tl_nf", "__tl_na")


def recent_values(df: DataFrame, keys: list[str], rank: str, value: str, n: int, out: str) -> DataFrame:
    """Add the ``n`` newest values of the key, newest first, as ``{a,b}`` text; null values stay in it.

    ``rank`` is 1 for the newest row. A window over the key, no join: at most ``n`` values a key.
    """
    listed = F.collect_list(F.when(F.col(rank) <= n, F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))).over(Window.partitionBy(*keys))
    return df.withColumn(out, array_text(F.transform(F.sort_array(listed), lambda x: x.v)))


def tile(row: Column, rows: Column, n: int) -> Column:
    """The tier 1..n of row number ``row``, from 0, among ``rows``: the first tiers are the larger by one."""
    size, larger = F.floor(rows / n), F.pmod(rows, F.lit(n))
    cut = larger * (size + 1)
    return F.when(row < cut, F.floor(row / (size + 1)) + 1).otherwise(larger + F.floor((row - cut) / F.when(size > 0, size)) + 1)
