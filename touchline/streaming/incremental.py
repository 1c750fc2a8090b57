"""Structured Streaming forms of the incremental loads."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline import files
from touchline.operators.exactly_once import BLOCK_BITS, SEEN, accept_batch, identifier_parts
from touchline.operators.upsert import dedupe_last_wins, replace_keys
from touchline.session import shuffle_parts

_BUCKET = "__tl_bucket"


def file_stream(spark: SparkSession, path: str, ddl: str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(ddl).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


@dataclass(frozen=True)
class KeyedState:
    """Rows below ``root`` in buckets by a hash of ``key``; a batch reads and rewrites the buckets it touches.

    The file ``STATE`` names the batch in force and, for each bucket, the batch that wrote it. It is
    replaced in one step and lies with the data, so any driver goes on from it, a batch that was
    written but not put in force is written again, and one delivered twice is applied once. Files
    of a bucket that a later batch rewrote are removed one batch later.
    """

    spark: SparkSession
    root: str
    ddl: str
    key: list[str]

    def _state(self) -> dict:
        text = files.read_text(self.spark, f"{self.root}/STATE")
        return json.loads(text) if text else {"batch": -1, "buckets": {}, "of": shuffle_parts(self.spark), "old": []}

    def seen(self, batch_id: int) -> bool:
        return batch_id <= self._state()["batch"]

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self._state()["of"])).cast("int")
        return sorted(r[0] for r in keys.select(bucket).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows in force, of all buckets or of those named."""
        held = self._state()["buckets"]
        paths = [f"{self.root}/b{at}/{_BUCKET}={b}" for b, at in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.ddl)

    def replace(self, batch_id: int, rows: DataFrame, buckets: list[int]) -> None:
        """Put ``rows`` in the place of what ``buckets`` held and the batch in force."""
        state = self._state()
        path, of = f"{self.root}/b{batch_id}", state["of"]
        names = T.StructType.fromDDL(self.ddl).names
        placed = rows.select(*names, F.pmod(F.xxhash64(*self.key), F.lit(of)).cast("int").alias(_BUCKET))
        placed.repartition(max(1, min(of, len(buckets))), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        written = {int(n.partition("=")[2]) for n in files.children(self.spark, path) if n.startswith(f"{_BUCKET}=")}
        replaced = [f"{self.root}/b{at}/{_BUCKET}={b}" for b, at in state["buckets"].items() if int(b) in buckets and at != batch_id]
        now = {b: at for b, at in state["buckets"].items() if int(b) not in buckets} | {str(b): batch_id for b in sorted(written)}
        files.write_text(self.spark, f"{self.root}/STATE", json.dumps({"batch": batch_id, "buckets": now, "of": of, "old": replaced}))
        for folder in state["old"]:
            files.delete(self.spark, folder)


def upsert_stream(stream: DataFrame, root: str, ddl: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Keep the last row of each key in ``KeyedState`` at ``root`` as batches arrive, until the source is read through.

    A late row with an older ``order`` than what is kept does not replace it.
    """
    state = KeyedState(stream.sparkSession, root, ddl, key)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if state.seen(batch_id):
            return
        buckets = state.touched(batch)
        held = state.read(buckets)
        meet = held.join(batch.select(*key).distinct(), key, "left_semi")
        state.replace(batch_id, replace_keys(held, dedupe_last_wins(batch.unionByName(meet), key, order), key), buckets)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def exactly_once_stream(stream: DataFrame, root: str, id_col: str, newest: list[str]) -> StreamingQuery:
    """Write each message once, to ``root``/out, holding ranges of numbers seen between batches.

    Ranges lie in buckets by producer and block, so a batch touches those of the numbers it brings.
    Output goes to a folder of its batch's own number, so a batch that runs again replaces what it
    wrote; the state is put in force only after that.
    """
    state = KeyedState(stream.sparkSession, f"{root}/seen", SEEN, ["producer", "block", "exact"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        if state.seen(batch_id):
            return
        producer, seq, exact = identifier_parts(batch, id_col)
        buckets = state.touched(batch.select(producer.alias("producer"), F.shiftright(seq, BLOCK_BITS).alias("block"), exact.alias("exact")))
        accepted, seen = accept_batch(batch, state.read(buckets), id_col, newest)
        accepted.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        state.replace(batch_id, seen, buckets)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def distinct_events(stream: DataFrame, key: list[str], at: str, delay: str = "2 hours") -> DataFrame:
    """A stream without copies that come within ``delay`` of each other; state is dropped after it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def counts_by_window(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows per window of event time and value of ``by``; windows close when the watermark passes."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
