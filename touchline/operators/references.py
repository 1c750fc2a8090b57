"""Problem 1: references to records that do not exist, or did not exist yet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Reference:
    """One referencing column: the child rows, its key, the parent's name, month and write time."""

    rows: DataFrame
    table: str
    column: str
    parent: str
    period_from: str
    written_at: str = "created_at"


@dataclass(frozen=True)
class Parent:
    """One referenced table: its rows, key and the time from which a row exists."""

    rows: DataFrame
    name: str
    key: str
    written_at: str = "created_at"


def _period(column: str):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM")


def _key_type(references: list[Reference], parents: list[Parent]) -> str:
    """long if all keys are whole numbers, else string, so that keys of any type can be compared."""
    kinds = [r.rows.schema[r.column].dataType for r in references] + [p.rows.schema[p.key].dataType for p in parents]
    return "long" if all(isinstance(k, T.IntegralType) for k in kinds) else "string"


def _children(references: list[Reference], kind: str) -> DataFrame:
    parts = [
        ref.rows.select(
            F.lit(ref.parent).alias("parent"),
            F.col(ref.column).cast(kind).alias("key"),
            F.lit(ref.table).alias("src_table"),
            F.lit(ref.column).alias("src_column"),
            _period(ref.period_from).alias("period"),
            F.lit(False).alias("is_parent"),
            F.col(ref.written_at).cast("timestamp").alias("written"),
        ).filter(F.col("key").isNotNull())
        for ref in references
    ]
    return reduce(DataFrame.unionByName, parts)


def _parents(parents: list[Parent], kind: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    parts = [
        parent.rows.select(
            F.lit(parent.name).alias("parent"),
            F.col(parent.key).cast(kind).alias("key"),
            nothing.alias("src_table"),
            nothing.alias("src_column"),
            nothing.alias("period"),
            F.lit(True).alias("is_parent"),
            F.col(parent.written_at).cast("timestamp").alias("written"),
        ).filter(F.col("key").isNotNull())
        for parent in parents
    ]
    return reduce(DataFrame.unionByName, parts)


def _judged(references: list[Reference], parents: list[Parent]) -> DataFrame:
    kind = _key_type(references, parents)
    combined = (
        _children(references, kind)
        .unionByName(_parents(parents, kind))
        .groupBy("parent", "key", "src_table", "src_column", "period", "is_parent")
        .agg(F.count(F.lit(1)).alias("n"), F.min("written").alias("first_written"), F.max("written").alias("last_written"))
    )
    group = Window.partitionBy("parent", "key")
    flagged = combined.withColumns(
        {
            "has_parent": F.max("is_parent").over(group),
            "born": F.min(F.when(F.col("is_parent"), F.col("first_written"))).over(group),
        }
    )
    fault = F.when(~F.col("has_parent"), "missing").when(F.col("first_written") < F.col("born"), "late")
    return flagged.filter(~F.col("is_parent")).withColumn("kind", fault).filter(F.col("kind").isNotNull())


def dangling_references(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """Keys that point nowhere: (src_table, src_column, ref_key, period, kind), distinct.

    ref_key is a long if all keys of all tables are whole numbers; otherwise keys are compared as
    text, and it is a string.

    ``kind`` is ``missing`` if the parent has no such key and ``late`` if a row of that month was
    written before the parent row was.

    All keys go into one long form, tagged by parent table and by side. Child rows are first
    combined per (parent, key, column, month), on the map side too, so a key that a third of all
    rows hold leaves each map task as one row per month; a group of (parent, key) then holds at
    most one row per column and month, however many rows refer to it.

    Null keys refer to nothing and are no references. A null month stays as a null period. A null
    write time, on either side, is never late. A parent key that occurs several times exists from
    its earliest row on. Empty inputs give an empty result. Other columns are never read.
    """
    return _judged(references, parents).select("src_table", "src_column", F.col("key").alias("ref_key"), "period", "kind")


def reference_report(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """Dangling references counted: (src_table, src_column, period, kind, n_keys, n_rows longs).

    Whether a row is late is a matter of each row, so the parent's birth, one small row for each
    parent key, is attached before rows are combined: a broadcast where the parents are small, else
    a join whose large keys AQE splits. Rows then combine per (key, column, month, kind) on the map
    side, and once more per month. Each table is scanned once. Nulls as in ``dangling_references``.
    """
    kind = _key_type(references, parents)
    born = _parents(parents, kind).groupBy("parent", "key").agg(F.min("written").alias("born")).withColumn("known", F.lit(True))
    fault = F.when(F.col("known").isNull(), "missing").when(F.col("written") < F.col("born"), "late")
    rows = _children(references, kind).join(born, ["parent", "key"], "left").withColumn("kind", fault).filter(F.col("kind").isNotNull())
    columns = ["src_table", "src_column", "period", "kind"]
    by_key = rows.groupBy("key", *columns).agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
