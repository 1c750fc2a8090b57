"""Exact counts, fair shares and slices for keys that hold too many rows."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import shuffle_parts

#: A key below this many rows is never worth splitting.
MIN_HOT_ROWS = 20_000


def heavy_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS, share: float = 1.0) -> list[tuple]:
    """(key, rows) of each key with more rows than ``share`` fair partitions, from exact counts.

    With P shuffle partitions and N rows a key is heavy above ``max(min_rows, share * N / P)``
    rows, so at most P / share keys can be: the list that reaches the driver is bounded by the
    session's partition number, not by the data. The count combines on the map side.
    """
    return _above(df, key, max(min_rows, ceil(share * df.count() / shuffle_parts(df.sparkSession))))


def _above(df: DataFrame, key: str, limit: int) -> list[tuple]:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [(r[0], r[1]) for r in counts.filter(F.col("n") > limit).collect()]


def slice_bounds(df: DataFrame, key: str, order: str, min_rows: int = MIN_HOT_ROWS) -> tuple[list[tuple], int]:
    """((key, bounds) of each heavy key, largest size of an uncut key).

    Bounds are approximate quantiles of ``order``, a long, that cut a heavy key into slices of about
    one fair partition each; a value that fills a slice by itself has one of its own. They number at
    most about four times the partitions in total.
    """
    fair = max(min_rows, ceil(df.count() / shuffle_parts(df.sparkSession)))
    by_depth: dict[int, list] = {}
    for k, n in _above(df, key, fair):
        if k is not None:
            by_depth.setdefault(ceil(log2(n / fair)), []).append(k)
    bounds = []
    for depth, keys in by_depth.items():
        cuts = [i / 2**depth for i in range(1, 2**depth)]
        found = df.filter(F.col(key).isin(keys)).groupBy(key).agg(F.percentile_approx(order, cuts, 1000).alias("b"))
        bounds += [(r[0], _apart(r[1] or [])) for r in found.collect()]
    return bounds, fair


def _apart(quantiles: list[int]) -> list[int]:
    """Distinct quantiles, and before each that comes several times one more, which cuts it off."""
    return sorted({*quantiles, *(a - 1 for a, b in zip(quantiles, quantiles[1:]) if a == b)})


def cut_by(df: DataFrame, key: str, order: str, out: str, bounds: list[tuple]) -> DataFrame:
    """Add an int column ``out``: 0 for keys without bounds, else 1..s, the slice in which ``order`` lies."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    kind = df.schema[key].dataType.simpleString()
    table = df.sparkSession.createDataFrame(bounds, f"__tl_k {kind}, __tl_b array<bigint>")
    joined = df.join(F.broadcast(table), F.col(key) == F.col("__tl_k"), "left")
    below: Column = F.size(F.filter("__tl_b", lambda b: b < F.col(order)))
    sliced = joined.withColumn(out, F.when(F.col("__tl_b").isNull(), 0).otherwise(below + 1).cast("int"))
    return sliced.drop("__tl_k", "__tl_b")


def time_slices(
    df: DataFrame, key: str, order: str, out: str, min_rows: int = MIN_HOT_ROWS, sizes_of: DataFrame | None = None
) -> tuple[DataFrame, int, bool]:
    """Add an int column ``out``; also tell the largest size of an uncut key, and whether any was cut.

    ``out`` is 0 for ordinary keys and 1..s in order of ``order``, a long, for heavy ones; rows with
    equal ``order`` share a slice, and slices keep the order, so that what slices yield can be
    joined at the cuts. How exact the quantiles are decides only balance, never the result. The
    bounds number at most about four times the partitions in total, so they may be broadcast.

    Sizes and quantiles may come from ``sizes_of``, cheaper rows that include those of ``df``.
    """
    bounds, fair = slice_bounds(sizes_of if sizes_of is not None else df, key, order, min_rows)
    return cut_by(df, key, order, out, bounds), fair, bool(bounds)
