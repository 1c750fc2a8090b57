"""Keyed changes of a target by a batch, each one a plan from DataFrames to the new target.

A plan never writes to the path it reads; ``touchline.sources.landing`` publishes results. All
functions need the key columns on both sides; the target's columns decide the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise, shuffle_parts


def numbered(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` + 1 in ``order``, without one task sorting all rows.

    Rows are range-partitioned and sorted, and written once, so that positions are settled; a
    partition's numbers begin after the rows of those before it, one count for each partition.
    """
    parts = shuffle_parts(df.sparkSession)
    ranged = df.repartitionByRange(parts, *[F.asc_nulls_last(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_last(c) for c in order])
    place = materialise(ranged.withColumn("__tl_m", F.monotonically_increasing_id()), "numbers")
    part = F.shiftright("__tl_m", 33)
    counts = place.groupBy(part.alias("__tl_p")).agg(F.count(F.lit(1)).alias("__tl_n"))
    before = F.coalesce(F.sum("__tl_n").over(Window.orderBy("__tl_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__tl_p", before.alias("__tl_s"))  # one row per partition
    number = F.lit(start + 1) + F.col("__tl_s") + F.col("__tl_m").bitwiseAND(F.lit((1 << 33) - 1))
    return place.join(F.broadcast(starts), part == F.col("__tl_p")).withColumn(out, number).drop("__tl_m", "__tl_p", "__tl_s", "__tl_n")


def normalise(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The batch in the target's columns and types; columns it lacks are null."""
    have = set(batch.columns)
    return batch.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])


def dedupe_last_wins(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``; one aggregate with map-side combining."""
    rest = [c for c in batch.columns if c not in key]
    last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in batch.columns])


def dedupe_in_turn(batch: DataFrame, key: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """``key`` and ``columns`` of each key after its rows were upserted one after another in ``order``.

    As with SQL's ``!=``, a row replaces the one before only where a value differs from one that
    isn't null. All rows of a key meet in one array.
    """
    rows = batch.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("l"))

    def turn(old: Column, new: Column) -> Column:
        differs = F.lit(False)
        for c in columns:
            differs = differs | F.coalesce(old[c] != new[c], F.lit(False))
        return F.when(differs, new).otherwise(old)

    last = rows.select(*key, F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", F.lit(0)), turn).alias("r"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in columns])


def dedupe_last_non_null(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key with the last value that isn't null of each column, in ``order``.

    Rows with a null key are no copies of one another and all stay.
    """
    rest = [c for c in batch.columns if c not in key]
    known = batch.filter(" and ".join(f"`{k}` is not null" for k in key))
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    each = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
    merged = known.groupBy(*key).agg(*each).select(*batch.columns)
    keyless = batch.filter(" or ".join(f"`{k}` is null" for k in key))
    return merged.unionByName(keyless)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys, without nulls, that occur more than once: ``key`` and n_rows."""
    known = df.filter(" and ".join(f"`{k}` is not null" for k in key))
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` unchanged, or an error that names some keys that are ambiguous."""
    odd = duplicate_keys(df, key).limit(5).collect()
    if odd:
        raise ValueError(f"ambiguous keys in ({', '.join(key)}): {[tuple(r[k] for k in key) for r in odd]}")
    return df


def insert_absent(target: DataFrame, batch: DataFrame, key: list[str], id_col: str | None = None) -> DataFrame:
    """The target and those keys of the batch that it lacks; new rows get the ids after the largest.

    Batch rows with a null key are left out, copies of a key count once.
    """
    known = normalise(batch, target).filter(" and ".join(f"`{k}` is not null" for k in key)).dropDuplicates(key)
    new = known.join(target.select(*key), key, "left_anti")
    if id_col:
        top = target.agg(F.max(id_col).alias("m")).first()["m"] or 0
        kind = target.schema[id_col].dataType
        new = numbered(new.drop(id_col), key, id_col, int(top)).withColumn(id_col, F.col(id_col).cast(kind))
    return target.unionByName(new.select(*target.columns))


def _paired(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Target (t) and batch (b) rows side by side; a null key meets nothing."""
    t = target.select(*key, F.struct(*target.columns).alias("t"))
    b = batch.select(*key, F.struct(*batch.columns).alias("b"))
    return t.join(b, key, "full")


def update_if_changed(
    target: DataFrame, batch: DataFrame, key: list[str], columns: list[str], now: Column, touched: str = "updated_at", null_safe: bool = False
) -> DataFrame:
    """Insert new keys, and update ``columns`` where one differs, setting ``touched`` only then.

    As with SQL's ``!=``, a value against null is no difference, so null neither replaces a value
    nor is replaced, unless ``null_safe``. The batch must have each key once.
    """
    both = _paired(target, normalise(batch, target), key)
    differs = F.lit(False)
    for c in columns:
        old, new = F.col(f"t.{c}"), F.col(f"b.{c}")
        differs = differs | (~old.eqNullSafe(new) if null_safe else F.coalesce(old != new, F.lit(False)))
    hit = F.col("t").isNotNull() & F.col("b").isNotNull() & differs

    def value(c: str) -> Column:
        fresh = F.coalesce(F.col(f"b.{c}"), now) if c == touched else F.col(f"b.{c}")
        changed = now if c == touched else (F.col(f"b.{c}") if c in columns else F.col(f"t.{c}"))
        return F.when(F.col("t").isNull(), fresh).when(hit, changed).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c)

    return both.select(*[value(c) for c in target.columns])


def coalesce_upsert(target: DataFrame, batch: DataFrame, key: list[str], columns: list[str], now: Column, touched: str = "updated_at") -> DataFrame:
    """Insert new keys, and let the batch's values that aren't null replace the target's.

    Null never clears a value. ``touched`` becomes ``now`` in every matched row. The batch must
    have each key once (see ``dedupe_last_non_null``).
    """
    both = _paired(target, normalise(batch, target), key)
    matched = F.col("t").isNotNull() & F.col("b").isNotNull()

    def value(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"b.{c}")
        if c == touched:
            out = F.when(matched, now).otherwise(F.coalesce(old, new, now))
        elif c in columns:
            out = F.coalesce(new, old)
        else:
            out = F.when(F.col("t").isNull(), new).otherwise(old)
        return out.cast(target.schema[c].dataType).alias(c)

    return both.select(*[value(c) for c in target.columns])


def replace_keys(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys that the batch has are replaced by the batch's, columns only it has are added.

    With a key this is an upsert, with partition columns a partition replace. A null in a key
    meets nothing, so such rows of both sides stay.
    """
    kept = target.join(batch.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def newer_than(source: DataFrame, target: DataFrame, at: str, empty_loads_all: bool = True) -> DataFrame:
    """Rows of the source after the target's high-water mark, strictly.

    An empty target loads everything, or, with ``empty_loads_all`` false, nothing, as a comparison
    with a null maximum does.
    """
    mark = target.agg(F.max(at).alias("m")).first()["m"]
    if mark is None:
        return source if empty_loads_all else source.filter(F.lit(False))
    return source.filter(F.col(at) > F.lit(mark))


def point_update(target: DataFrame, changes: DataFrame, key: list[str], column: str, now: Column, touched: str = "updated_at") -> DataFrame:
    """Set ``column`` of the keys in ``changes``, and ``touched`` of these rows."""
    new = changes.select(*key, F.col(column).alias("__tl_new"), F.lit(True).alias("__tl_hit"))
    joined = target.join(new, key, "left")
    hit = F.col("__tl_hit").isNotNull()
    changed = {column: F.when(hit, F.col("__tl_new")).otherwise(F.col(column))}
    if touched in target.columns:
        changed[touched] = F.when(hit, now).otherwise(F.col(touched))
    return joined.withColumns(changed).select(*target.columns)


def mark_done(target: DataFrame, done: DataFrame, key: list[str], flag: str, at: str, now: Column) -> DataFrame:
    """Set ``flag`` true and ``at`` to now for the keys in ``done``."""
    joined = target.join(done.select(*key).distinct().withColumn("__tl_hit", F.lit(True)), key, "left")
    hit = F.col("__tl_hit").isNotNull()
    return joined.withColumns({flag: hit | F.col(flag), at: F.when(hit, now).otherwise(F.col(at))}).select(*target.columns)


def attach_keys(batch: DataFrame, target: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """Fill a missing ``surrogate`` of the batch from the target by ``natural``; an error if that is ambiguous."""
    wanted = batch.filter(F.col(surrogate).isNull()).select(natural).distinct()
    found = require_unique(target.join(wanted, natural, "left_semi").select(natural, F.col(surrogate).alias("__tl_id")), [natural])
    joined = batch.join(found, natural, "left").withColumn(surrogate, F.coalesce(surrogate, "__tl_id"))
    return joined.select(*batch.columns)


def moved_kickoffs(payload: DataFrame, warehouse: DataFrame, key: str, at: str, status: str, finished: str = "FT") -> DataFrame:
    """(key, old, new) where a fixture that isn't finished has another kickoff in the payload.

    Fixtures the warehouse lacks, or whose kickoff or status it lacks, are passed over; a payload
    without a readable kickoff is a change to null.
    """
    new = payload.select(key, F.col(at).alias("new_kickoff_utc"))
    old = warehouse.filter(F.col(at).isNotNull() & F.col(status).isNotNull()).select(key, F.col(at).alias("old_kickoff_utc"), status)
    return (
        new.join(old, key)
        .filter(~F.col("new_kickoff_utc").eqNullSafe(F.col("old_kickoff_utc")) & (F.col(status) != finished))
        .select(key, "old_kickoff_utc", "new_kickoff_utc")
    )
