"""Problem 4: the N best items of every group, whatever the size of a group."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import shuffle_parts

#: Groups below this many rows are ordinary.
HEAVY_ROWS = 20_000
#: Score ranges for each factor of e; a range is about 0.4 % wide.
RANGES_PER_E = 256
#: More possible heavy groups than this are joined by shuffle instead of broadcast.
BROADCAST_GROUPS = 100_000
_RN, _RANGE, _SALT, _KEY, _CUT, _SALTS = "__tl_rn", "__tl_range", "__tl_salt", "__tl_key", "__tl_cut", "__tl_salts"


def latest_of_key(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The row with the latest ``at`` of each key: ``keys`` and ``columns``.

    One aggregate with map-side combining, so copies of a key shrink before the shuffle. A null
    ``at`` is the oldest; of rows that tie the largest by ``columns``, in their order, counts. Null
    keys group together. Columns other than those named are not read.
    """
    best = F.max(F.struct(F.col(at).alias("a"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("__tl_best")
    found = df.groupBy(*keys).agg(best)
    return found.select(*keys, *[F.col(f"__tl_best.c{i}").alias(c) for i, c in enumerate(columns)])


def _range_of(score: str) -> Column:
    """The range of a score, a long that never falls as the score rises; null of null, the largest of NaN."""
    x = F.col(score).cast("double")
    size = F.floor(F.log1p(F.abs(x) * F.lit(float(1 << 20))) * RANGES_PER_E)
    far = F.lit(1 << 40)
    near = F.when(F.abs(x) > 1e300, far).otherwise(size)
    return F.when(F.isnan(x), far + 1).when(x < 0, -near).otherwise(near)


def top_n(
    df: DataFrame,
    group: str,
    score: str,
    order: list[Column],
    n: int,
    rank: str | None = None,
    counts_of: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """The first ``n`` rows of each ``group`` in ``order``, with all columns of ``df``.

    ``order`` must begin with descending ``score``, a number, and should decide all ties; rows
    that are equal in all of it are interchangeable. ``rank`` names a column for the position.

    Exact counts split the groups. Light ones go through one window. A heavy group holds more than
    a fair partition; its rows are counted by ranges of the score, and ranges below the one in which
    its n-th row lies drop out before anything is sorted. What is left, still large where many rows
    tie, is salted by a hash of the row; each (range, salt) is sorted and yields its first n, and the
    group's first n come from these. Fewer groups than there are shuffle partitions can be heavy, so
    their table, one row each, is broadcast (joined by shuffle beyond 100,000 partitions). Ranges
    and both branches read the same rows: where ``df`` ends in a shuffle, Spark reuses it, and all
    three scan the input once.

    Counts may be taken from ``counts_of``, rows that include those of ``df`` and of which only the
    group is read; groups that only look heavy there are served as well. The null group
    is a group. Null scores sort as ``order`` says; NaN is the largest number. n <= 0 and empty
    tables give no rows.
    """
    parts = shuffle_parts(df.sparkSession)
    sizes = counts_of if counts_of is not None else df
    limit = max(heavy_rows, ceil(sizes.count() / parts))
    named = rank or _RN

    def first_n(rows: DataFrame, by: list[str], out: str) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if parts <= BROADCAST_GROUPS else table

    heavy = sizes.groupBy(F.col(group).alias(_KEY)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(_KEY)
    ranged = df.join(small(heavy), F.col(group).eqNullSafe(F.col(_KEY))).groupBy(_KEY, _range_of(score).alias("r")).agg(F.count(F.lit(1)).alias("c"))
    above = F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("c"))).over(Window.partitionBy(_KEY).orderBy(F.desc_nulls_last("r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rows without a score may come first or last, so they stay
    left = ranged.withColumn("above", above).filter((F.col("above") < n) | F.col("r").isNull())
    salts = F.greatest(F.lit(1), F.least(F.lit(parts), F.ceil(F.sum("c") / limit)))
    cuts = left.groupBy(_KEY).agg(F.coalesce(F.min("r"), F.lit(0)).alias(_CUT), salts.alias(_SALTS))
    tagged = df.join(small(cuts), F.col(group).eqNullSafe(F.col(_KEY)), "left").withColumn(_RANGE, _range_of(score))
    light = first_n(tagged.filter(F.col(_CUT).isNull()).select(*df.columns), [group], named)
    big = tagged.filter(F.col(_CUT).isNotNull() & (F.col(_RANGE).isNull() | (F.col(_RANGE) >= F.col(_CUT))))
    salted = big.withColumn(_SALT, F.pmod(F.xxhash64(*df.columns), F.col(_SALTS)))
    candidates = first_n(salted, [group, _RANGE, _SALT], _RN)
    found = light.unionByName(first_n(candidates.select(*df.columns), [group], named))
    return found if rank else found.drop(_RN)
