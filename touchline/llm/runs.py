"""Problem 5: runs of repeated consecutive events, collapsed to one event each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from touchline.operators.skew import MIN_HOT_ROWS, cut_by, slice_bounds
from touchline.session import materialise, shuffle_parts

#: Symbols of one entity that are matched as one string; a longer sequence is matched in pieces.
CHUNK = 1 << 18
#: Code point of the first event; the one below it ends an entity's string.
_FIRST = 0x100
_END = chr(_FIRST - 1)
_REPEATED = re.compile(r"([^" + _END + r"])\1+", re.S)
_EVERY = re.compile(r"([^" + _END + r"])\1*", re.S)
_ANY = re.compile(r"(.)\1*", re.S)


def to_symbols(events: pa.Array) -> np.ndarray:
    """A Unicode code point for each event; equal events, and no others, share one."""
    codes = np.asarray(events.dictionary_encode().indices).astype(np.uint32) + np.uint32(_FIRST)
    return codes + np.where(codes >= 0xD800, np.uint32(0x800), np.uint32(0))  # not into the surrogates


def _text(symbols: np.ndarray) -> str:
    return symbols.astype("<u4").tobytes().decode("utf-32-le")


def _spans(rows: pa.Table, cut: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row, end row, touches the start, touches the end) of each run in sorted rows.

    Whole entities yield runs of two or more, or of one too if ``single``. Pieces of a sequence, where ``cut`` is true, yield
    their first and last run at any length, flagged, as these may go on in the next piece.
    """
    n = rows.num_rows
    seg, symbols = rows["__tl_seg"].combine_chunks(), to_symbols(rows["__tl_event"].combine_chunks())
    new = np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(seg.slice(1), seg.slice(0, n - 1)))])
    # one string for all entities of the piece, an end sign after each
    text = _text(np.insert(symbols, new[1:], np.uint32(_FIRST - 1)))
    found = np.array([m.span() for m in (_EVERY if single else _REPEATED).finditer(text)], np.int64).reshape(-1, 2)
    shift = np.arange(new.size)  # row = position minus the end signs before it
    starts_in_text = new + shift
    which = np.searchsorted(starts_in_text, found[:, 0], side="right") - 1
    found -= shift[which][:, None]
    if not cut.any():
        return found[:, 0], found[:, 1], np.zeros(len(found), bool), np.zeros(len(found), bool)
    spans = {(a, b): [False, False] for a, b in found.tolist()}
    ends = np.r_[new[1:], n]
    for e in np.flatnonzero(cut[new]):
        a, b, at = int(new[e]), int(ends[e]), int(starts_in_text[e])
        piece = text[at : at + b - a]
        head = _ANY.match(piece).end()
        tail = _ANY.match(piece[::-1]).end() if head < len(piece) else head
        spans.setdefault((a, a + head), [False, False])[0] = True
        spans.setdefault((b - tail, b), [False, False])[1] = True
    table = np.array([(a, b, *f) for (a, b), f in spans.items()], np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2].astype(bool), table[:, 3].astype(bool)


def _cut_instants(sliced: DataFrame, sizes: DataFrame, fair: int) -> DataFrame:
    """Slices that hold one instant of an entity and more than two fair shares, cut again by the tie.

    ``sizes`` has (entity, at, slice). Fewer such slices than partitions can be, and their bounds are
    as few; where there are none, nothing else is done.
    """
    keys = ["__tl_entity", "__tl_slice"]
    held = sizes.filter("__tl_slice > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__tl_at").alias("a"), F.max("__tl_at").alias("b"))
    crowded = held.filter((F.col("n") > 2 * fair) & (F.col("a") == F.col("b"))).select(*keys, "n").collect()
    if not crowded:
        return sliced
    spark = sliced.sparkSession
    pieces = 1 << ceil(log2(max(r["n"] for r in crowded) / fair))
    kinds = T.StructType([sliced.schema[k] for k in keys])
    mine = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in crowded], kinds))
    cuts = F.percentile_approx(F.col("__tl_tie").cast("double"), [i / pieces for i in range(1, pieces)], 1000)
    found = sliced.join(mine, keys).groupBy(*keys).agg(cuts.alias("b")).collect()
    table = spark.createDataFrame([(r[0], r[1], sorted(set(r[2] or []))) for r in found], kinds.add("__tl_b", T.ArrayType(T.DoubleType())))
    below = F.size(F.filter("__tl_b", lambda b: b < F.col("__tl_tie").cast("double")))
    joined = sliced.join(F.broadcast(table), keys, "left")
    # slices of the first cut leave room for those of the second between them
    return joined.withColumn("__tl_slice", (F.col("__tl_slice") * pieces + F.coalesce(F.when(F.col("__tl_b").isNotNull(), below), F.lit(0))).cast("int")).drop("__tl_b")


def collapse_runs(
    df: DataFrame,
    entity: str,
    at: str,
    tie: str,
    event: str,
    min_events: int = 2,
    min_hot_rows: int = MIN_HOT_ROWS,
    chunk: int = CHUNK,
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """One row per run of equal consecutive events of an entity, of ``min_events`` or more; with 1, single events come out too.

    Returns ``entity``, event, first_id and last_id (values of ``tie``), first_at, last_at,
    n_events long, duration_s double. Order within an entity is ``at``, then ``tie``. Near-identical
    events must have been mapped to one canonical value before.

    Each event becomes a code point, an entity's events in order become a string, and a regular
    expression with a back reference finds the repetitions; spans map back to rows and times. The
    strings of many small entities are matched at once. An entity with more rows than a fair share
    is cut by time into slices for different tasks (and an instant that holds more than two shares by
    the tie, where that is a number), and any piece longer than ``chunk`` into
    several strings; a run across cuts is joined from the first and last runs of the pieces only.
    Sizes of entities may come from ``sizes_of``, cheaper rows with the columns ``entity`` and
    ``at`` that include those of ``df``.

    Rows with a null entity, event or time are left out and do not interrupt a run. Rows equal in
    all of the order are interchangeable. Empty input: no rows. Other columns are not read.
    """
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    rows = df.filter(F.col(entity).isNotNull() & F.col(event).isNotNull() & F.col(at).isNotNull()).select(
        F.col(entity).alias("__tl_entity"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("__tl_at"),
        F.col(tie).alias("__tl_tie"),
        F.col(event).cast("string").alias("__tl_event"),
    )
    sizes = rows
    if sizes_of is not None:
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        sizes = sizes_of.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("__tl_entity"), micros.alias("__tl_at"))
    bounds, largest = slice_bounds(sizes, "__tl_entity", "__tl_at", min_hot_rows)
    sliced, any_cut = cut_by(rows, "__tl_entity", "__tl_at", "__tl_slice", bounds), bool(bounds)
    if any_cut and isinstance(rows.schema["__tl_tie"].dataType, T.NumericType):
        sliced = _cut_instants(sliced, cut_by(sizes, "__tl_entity", "__tl_at", "__tl_slice", bounds), largest)
    any_cut = any_cut or largest >= chunk
    ordered = sliced.withColumn("__tl_seg", F.concat_ws("\u0001", F.col("__tl_entity").cast("string"), F.col("__tl_slice").cast("string")))
    out = T.StructType(
        [
            T.StructField("__tl_entity", rows.schema["__tl_entity"].dataType),
            T.StructField("event", T.StringType()),
            T.StructField("first_id", rows.schema["__tl_tie"].dataType),
            T.StructField("last_id", rows.schema["__tl_tie"].dataType),
            T.StructField("first_us", T.LongType()),
            T.StructField("last_us", T.LongType()),
            T.StructField("n_events", T.LongType()),
            T.StructField("slice", T.IntegerType()),
            T.StructField("piece", T.IntegerType()),
            T.StructField("at_start", T.BooleanType()),
            T.StructField("at_end", T.BooleanType()),
        ]
    )
    wanted = to_arrow_schema(out)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        piece = 0  # number of the piece that the held rows begin

        def flush(table: pa.Table, goes_on: bool) -> Iterator[pa.RecordBatch]:
            nonlocal piece
            seg = table["__tl_seg"]
            first_of = np.asarray(pc.equal(seg, seg[0]))
            last_of = np.asarray(pc.equal(seg, seg[-1]))
            # cut are sliced entities, pieces after the first, and the piece that goes on
            cut = np.asarray(pc.greater(table["__tl_slice"], 0)) | (first_of & (piece > 0)) | (last_of & goes_on)
            numbers = np.where(first_of, piece, 0).astype(np.int32)
            a, b, at_start, at_end = _spans(table, cut, min_events < 2)
            if a.size:
                one, two = table.take(pa.array(a)), table.take(pa.array(b - 1))
                found = [one["__tl_entity"], one["__tl_event"], one["__tl_tie"], two["__tl_tie"], one["__tl_at"], two["__tl_at"]]
                found += [pa.array(b - a), one["__tl_slice"], pa.array(numbers[a]), pa.array(at_start), pa.array(at_end)]
                yield from pa.Table.from_arrays(found, names=wanted.names).cast(wanted).to_batches()
            same = bool(first_of[-1])
            piece = ((piece if same else 0) + 1) if goes_on else 0

        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            seg = held["__tl_seg"]
            tail = held.num_rows - int(pc.sum(pc.equal(seg, seg[-1])).as_py())
            if tail:
                yield from flush(held.slice(0, tail).combine_chunks(), False)
                held = held.slice(tail)
            if held.num_rows >= chunk:
                yield from flush(held.combine_chunks(), True)
                held = None
        if held is not None:
            yield from flush(held.combine_chunks(), False)

    spread = ordered.repartition(parts, "__tl_entity", "__tl_slice").sortWithinPartitions("__tl_entity", "__tl_slice", "__tl_at", "__tl_tie")
    found = spread.mapInArrow(match, out)
    edge = F.col("at_start") | F.col("at_end")
    found = materialise(found, "runs") if any_cut else found
    line = Window.partitionBy("__tl_entity").orderBy("slice", "piece", F.desc("at_start"))
    goes_on = F.col("at_start") & F.lag("at_end").over(line) & (F.lag("event").over(line) == F.col("event"))
    chain = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    joined = (
        found.filter(edge)
        .withColumn("chain", chain)
        .groupBy("__tl_entity", "chain")
        .agg(
            F.first("event").alias("event"),
            F.min_by("first_id", F.struct("slice", "piece", ~F.col("at_start"))).alias("first_id"),
            F.max_by("last_id", F.struct("slice", "piece", "at_end")).alias("last_id"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("n_events").alias("n_events"),
        )
    )
    columns = ["__tl_entity", "event", "first_id", "last_id", "first_us", "last_us", "n_events"]
    whole = found.filter(~edge).select(*columns)
    if any_cut:
        whole = whole.unionByName(joined.select(*columns))
    return whole.filter(F.col("n_events") >= min_events).select(
        F.col("__tl_entity").alias(entity),
        "event",
        "first_id",
        "last_id",
        F.timestamp_micros("first_us").alias("first_at"),
        F.timestamp_micros("last_us").alias("last_at"),
        "n_events",
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_s"),
    )
