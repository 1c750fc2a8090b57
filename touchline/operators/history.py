"""Problem 2: the full history of changing attributes, built from snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from touchline import files
from touchline.operators.skew import MIN_HOT_ROWS, cut_by, slice_bounds
from touchline.session import materialise, new_shared_path, shuffle_parts

#: What runs are sorted by: entity (and slice), time, delivery, and a hash that settles exact ties.
_SEG, _T, _D, _H = "__tl_seg", "__tl_t", "__tl_d", "__tl_h"
_SORT = [(c, "ascending") for c in (_SEG, _T, _D, _H)]
#: Rows that one run of a merge holds in memory at a time.
BATCH_ROWS = 8192


def _key_at(batch: pa.RecordBatch, i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c, _ in _SORT)


def _rows_up_to(batch: pa.RecordBatch, key: tuple) -> int:
    low, high = 0, batch.num_rows
    while low < high:
        mid = (low + high) // 2
        if _key_at(batch, mid) <= key:
            low = mid + 1
        else:
            high = mid
    return low


def merge_runs(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.Table]:
    """Merge k key-sorted runs; at any time one batch of each run is in memory.

    The smallest of the runs' last keys bounds what can be given out: no run can still bring a
    key below it. Those rows of all runs are cut off, sorted together and yielded, and each run
    that is used up takes its next batch.
    """
    heads: list[list] = []
    for run in runs:
        if (batch := next((b for b in run if b.num_rows), None)) is not None:
            heads.append([run, batch])
    while heads:
        bound = min(_key_at(b, b.num_rows - 1) for _, b in heads)
        ready = []
        for head in heads:
            n = _rows_up_to(head[1], bound)
            if n:
                ready.append(head[1].slice(0, n))
                head[1] = head[1].slice(n)
            if head[1].num_rows == 0:
                head[1] = next((b for b in head[0] if b.num_rows), None)
        heads = [h for h in heads if h[1] is not None]
        table = pa.Table.from_batches(ready)
        yield (table.sort_by(_SORT) if len(ready) > 1 else table).combine_chunks()


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.Array:
    """True where two columns differ; null equals null and NaN equals NaN."""
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(a.type):
        unequal = pc.and_(unequal, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b)))


def close_versions(merged: Iterator[pa.Table], payload: list[str]) -> Iterator[pa.Table]:
    """Versions of sorted snapshots, each given out once the next one, or its entity's end, closes it.

    Adds ``__tl_to`` (start of the entity's next version, else null) and ``__tl_first``. Between
    tables only the last snapshot row and the open version stay in memory.
    """
    pending: pa.Table | None = None  # the last snapshot row, which a later delivery may replace
    last: pa.Table | None = None  # the snapshot before it, to compare with
    opened: pa.Table | None = None  # the version not yet closed

    def starts(rows: pa.Table, before: pa.Table | None) -> pa.Table:
        table = rows if before is None else pa.concat_tables([before, rows])
        table = table.combine_chunks()
        now, prior = table.slice(1), table.slice(0, table.num_rows - 1)
        other = pc.not_equal(now[_SEG], prior[_SEG])
        changed = other
        for c in payload:
            changed = pc.or_(changed, _differs(now[c], prior[c]))
        if before is None:
            lead = pa.array([True])
            changed = pa.concat_arrays([lead, *_chunks(changed)])
            other = pa.concat_arrays([lead, *_chunks(other)])
            now = table
        return now.append_column("__tl_first", pa.chunked_array([*_chunks(other)])).filter(changed)

    def closed(found: pa.Table, final: bool) -> Iterator[pa.Table]:
        nonlocal opened
        table = found if opened is None else pa.concat_tables([opened, found])
        if table.num_rows == 0:
            return
        table = table.combine_chunks()
        nxt = table.slice(1)
        ends = pc.if_else(pc.equal(nxt[_SEG], table.slice(0, table.num_rows - 1)[_SEG]), nxt[_T], pa.scalar(None, pa.int64()))
        if final:
            opened = None
            yield table.append_column("__tl_to", pa.chunked_array([*_chunks(ends), pa.nulls(1, pa.int64())]))
        else:
            opened = table.slice(table.num_rows - 1)
            if table.num_rows > 1:
                yield table.slice(0, table.num_rows - 1).append_column("__tl_to", ends)

    for table in merged:
        rows = table if pending is None else pa.concat_tables([pending, table]).combine_chunks()
        pending = rows.slice(rows.num_rows - 1)
        body, nxt = rows.slice(0, rows.num_rows - 1), rows.slice(1)
        if body.num_rows == 0:
            continue
        keep = pc.or_(pc.not_equal(body[_SEG], nxt[_SEG]), pc.not_equal(body[_T], nxt[_T]))
        kept = body.filter(keep)
        if kept.num_rows == 0:
            continue
        found = starts(kept, last)
        last = kept.slice(kept.num_rows - 1)
        yield from closed(found, False)
    if pending is not None:
        yield from closed(starts(pending, last), True)


def _chunks(array) -> list[pa.Array]:
    return array.chunks if isinstance(array, pa.ChunkedArray) else [array]


def _runs_of(root: str, bucket: int, columns: list[str]) -> list[Iterator[pa.RecordBatch]]:
    """The runs' files of one bucket below ``root``, found by the task that merges them."""
    import pyarrow.fs as pafs

    system, base = files.arrow_system(root)
    runs = [f.path for f in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("__tl_run=")]
    found = []
    for run in sorted(runs):
        held = system.get_file_info(pafs.FileSelector(f"{run}/__tl_bucket={bucket}", allow_not_found=True))
        found += sorted(f.path for f in held if f.base_name.endswith(".parquet") and f.base_name[0] not in "._")
    return [_read_run(system, path, columns) for path in found]


def _read_run(system, path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of one run's file, in its order; the file is read row group by row group."""
    import pyarrow.parquet as pq

    with system.open_input_file(path) as source:
        yield from pq.ParquetFile(source).iter_batches(batch_size=BATCH_ROWS, columns=columns, use_threads=False)


def _entity(keys: list[str]) -> Column:
    """One text for the key columns that differs wherever one of them does: each value after its length, null apart."""
    text = [F.col(k).cast("string") for k in keys]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in text])


@dataclass(frozen=True)
class SnapshotRuns:
    """Snapshots in the folder ``root`` as runs: co-partitioned by entity and sorted by entity and time.

    ``add`` sorts and writes new snapshots as runs beside the old ones, which are left as they are;
    ``history`` merges all runs. Buckets, and the cuts of entities that are large when the first run
    is added, are settled then and kept in ``root``/layout; an entity that grows large later is
    merged by one task, in bounded memory, until its runs are written anew into another folder.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    at: str
    delivered: str
    payload: list[str]

    @property
    def _names(self) -> list[str]:
        return [f"__tl_k{i}" for i in range(len(self.keys))]

    @property
    def _values(self) -> list[str]:
        return [f"__tl_v{i}" for i in range(len(self.payload))]

    def _layout(self, snapshots: DataFrame | None = None, min_hot_rows: int = MIN_HOT_ROWS) -> dict:
        """What was settled with the first run: at most a few numbers for each partition."""
        path = f"{self.root}/layout"
        text = files.read_text(self.spark, path)
        if text is None:
            if snapshots is None:
                raise ValueError(f"no runs in {self.root}")
            bounds, _ = slice_bounds(snapshots, "__tl_e", _T, min_hot_rows)
            kept = snapshots.select(*self._names, *self._values).schema
            text = json.dumps({"buckets": shuffle_parts(self.spark), "bounds": bounds, "types": kept.json()})
            files.write_text(self.spark, path, text)
        return json.loads(text)

    def add(self, df: DataFrame, run: Column, min_hot_rows: int = MIN_HOT_ROWS) -> None:
        """Write snapshots as the runs that the column ``run`` names; a run that exists is replaced."""
        name, value = self._names, self._values
        snapshots = df.filter(F.col(self.at).isNotNull()).select(
            *[F.col(k).alias(n) for k, n in zip(self.keys, name)],
            *[F.col(p).alias(v) for p, v in zip(self.payload, value)],
            _entity(self.keys).alias("__tl_e"),
            F.unix_micros(F.col(self.at).cast("timestamp")).alias(_T),
            F.coalesce(F.unix_micros(F.col(self.delivered).cast("timestamp")), F.lit(-(2**63) + 1)).alias(_D),
            run.alias("__tl_run"),
        )
        # no constant, even if the run is one: else the writer's own sort would take the place of the one below
        snapshots = snapshots.withColumn("__tl_run", F.concat(F.col("__tl_run").cast("string"), F.substring("__tl_e", 1, 0)))
        layout = self._layout(snapshots, min_hot_rows)
        parts = layout["buckets"]
        sliced = cut_by(snapshots, "__tl_e", _T, "__tl_slice", [tuple(b) for b in layout["bounds"]])
        ordered = sliced.withColumns(
            {
                _SEG: F.concat("__tl_e", F.lpad(F.col("__tl_slice").cast("string"), 9, "0")),
                _H: F.xxhash64(*value),
                "__tl_bucket": F.pmod(F.xxhash64("__tl_e", "__tl_slice"), F.lit(parts)).cast("int"),
            }
        )
        ordered = ordered.select(*name, *value, "__tl_e", "__tl_slice", _SEG, _T, _D, _H, "__tl_bucket", "__tl_run")
        if layout["bounds"]:  # copies of one snapshot of a heavy entity shrink to one row on the map side
            ordered = ordered.filter("__tl_slice = 0").unionByName(_newest_of_instant(ordered.filter("__tl_slice > 0"), name, value))
        (
            ordered.repartitionById(parts, F.col("__tl_bucket"))
            .sortWithinPartitions("__tl_run", "__tl_bucket", _SEG, _T, _D, _H)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("__tl_run", "__tl_bucket")
            .parquet(f"{self.root}/runs")
        )

    def history(self) -> DataFrame:
        """The versions of ``entity_history``, from all runs added so far; no run is sorted again."""
        layout, name, value = self._layout(), self._names, self._values
        types = T.StructType.fromJson(json.loads(layout["types"]))
        out = T.StructType(
            [*types, T.StructField("__tl_e", T.StringType()), T.StructField("__tl_slice", T.IntegerType()), T.StructField(_T, T.LongType())]
            + [T.StructField("__tl_first", T.BooleanType()), T.StructField("__tl_to", T.LongType())]
        )
        columns, wanted, root = [*types.names, "__tl_e", "__tl_slice", _SEG, _T, _D, _H], to_arrow_schema(out), f"{self.root}/runs"

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column(0).to_pylist():
                    for table in close_versions(merge_runs(_runs_of(root, bucket, columns)), value):
                        yield from table.select(wanted.names).cast(wanted).to_batches()

        # a task for each bucket; it lists its own files
        versions = self.spark.range(0, layout["buckets"], 1, layout["buckets"]).mapInArrow(merge, out)
        joined = _join_slices(materialise(versions, "versions"), value) if layout["bounds"] else versions
        return joined.select(
            *[F.col(n).alias(k) for n, k in zip(name, self.keys)],
            *[F.col(v).alias(p) for v, p in zip(value, self.payload)],
            F.timestamp_micros(_T).alias("valid_from"),
            F.timestamp_micros("__tl_to").alias("valid_to"),
            F.col("__tl_to").isNull().alias("is_current"),
        )


def entity_history(
    df: DataFrame,
    keys: list[str],
    at: str,
    delivered: str,
    payload: list[str],
    run: str | None = None,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """One row per version: ``keys``, ``payload``, valid_from, valid_to (timestamps), is_current.

    A version starts at an entity's first snapshot and wherever any payload column differs from
    the snapshot before, and is valid until the next version starts; the last one has a null
    valid_to. Of snapshots with equal ``at`` the one with the latest ``delivered`` counts (a null
    delivery is the earliest; of exact ties the largest payload hash counts).

    Snapshots are written to the shared folder as runs (``SnapshotRuns``), by default one for each
    year of delivery (or of the column ``run``): co-partitioned by entity and sorted by entity and
    time. A task then opens the k runs of its partition and merges their iterators; it holds one
    batch of each run and the open version, never a history. The history of an entity with more
    rows than a fair share is cut into slices of time, which different tasks merge, and versions
    that go on across a cut are joined from the slices' first and last versions alone. Copies of one
    snapshot of such an entity, even a third of all rows, are combined before they are shuffled.

    Null key values form an entity of their own, as in GROUP BY. Rows with a null ``at`` have no
    place in time and are left out. Null payloads are equal only to null. Empty input: no rows.
    Other columns are not read, whatever their names.
    """
    runs = SnapshotRuns(df.sparkSession, new_shared_path(df.sparkSession, "runs"), keys, at, delivered, payload)
    runs.add(df, F.year(delivered) if run is None else F.col(run), min_hot_rows)
    return runs.history()


def _newest_of_instant(rows: DataFrame, name: list[str], value: list[str]) -> DataFrame:
    """Of each entity and time the row that counts, by an aggregate that combines before it shuffles."""
    keys = [*name, "__tl_e", "__tl_slice", _SEG, _T, "__tl_bucket"]
    best = rows.groupBy(*keys).agg(F.max(F.struct(_D, _H, *value, "__tl_run")).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def _join_slices(versions: DataFrame, value: list[str]) -> DataFrame:
    """Join versions that go on across the cuts of sliced entities.

    A slice's inner versions are settled. Its first may continue the slice before and its last may
    run on, so only these take part, two for each slice.
    """
    edge = (F.col("__tl_slice") > 0) & (F.col("__tl_first") | F.col("__tl_to").isNull())
    inner, edges = versions.filter(~edge), versions.filter(edge)
    line = Window.partitionBy("__tl_e").orderBy("__tl_slice", _T)
    state = F.struct(*value)
    goes_on = F.col("__tl_first") & (F.lag("__tl_slice").over(line) < F.col("__tl_slice")) & state.eqNullSafe(F.lag(state).over(line))
    marked = edges.withColumn("__tl_on", F.coalesce(goes_on, F.lit(False)))
    chained = marked.withColumn("__tl_c", F.sum(F.when(F.col("__tl_on"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # a version ends where the last one of its chain does, or else where the next chain starts
    chain = Window.partitionBy("__tl_e", "__tl_c").orderBy("__tl_slice", _T).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = chained.withColumn("__tl_end", F.last("__tl_to").over(chain)).filter(~F.col("__tl_on"))
    settled = ended.withColumn("__tl_to", F.coalesce("__tl_end", F.lead(_T).over(line))).select(*versions.columns)
    return inner.unionByName(settled)
