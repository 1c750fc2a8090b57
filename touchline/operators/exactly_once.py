"""Problem 3: messages delivered more than once, exactly one copy kept of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import shuffle_parts

_PRODUCER, _SEQ, _EXACT, _DUP, _ROW = "__tl_producer", "__tl_seq", "__tl_exact", "__tl_dup", "__tl_row"
#: Numbers of one producer that share a task; larger producers spread over many tasks.
BLOCK_BITS = 14


class SeenRanges:
    """Disjoint, sorted ranges of the numbers seen so far; every number is accepted once."""

    def __init__(self) -> None:
        self.lo = np.empty(0, np.int64)
        self.hi = np.empty(0, np.int64)

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        """Positions of the first occurrence of each number that no range covers yet."""
        distinct, first = np.unique(numbers, return_index=True)
        if self.lo.size:
            at = np.searchsorted(self.lo, distinct, side="right") - 1
            fresh = (at < 0) | (self.hi[at] < distinct)
            distinct, first = distinct[fresh], first[fresh]
        if distinct.size:
            self._merge(distinct)
        return first

    def _merge(self, numbers: np.ndarray) -> None:
        """Add sorted uncovered numbers and join ranges that touch."""
        cut = np.flatnonzero(np.diff(numbers) != 1)
        lo = np.concatenate((self.lo, numbers[np.r_[0, cut + 1]]))
        hi = np.concatenate((self.hi, numbers[np.r_[cut, numbers.size - 1]]))
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        starts = np.flatnonzero(np.r_[True, lo[1:] != hi[:-1] + 1])
        self.lo, self.hi = lo[starts], hi[np.r_[starts[1:] - 1, hi.size - 1]]


class _Gate:
    """What one task has seen where it stands: the ranges of the block of numbers it is in, and the last exact key.

    Rows come sorted by producer, block and exact key, so nothing before has to be kept.
    """

    def __init__(self) -> None:
        self.ranges = SeenRanges()
        self.block: tuple | None = None
        self.exact: str | None = None

    def numbered(self, producer: pa.Array, seq: np.ndarray) -> np.ndarray:
        """Positions of the accepted numbers."""
        block = seq >> BLOCK_BITS
        change = np.r_[True, np.asarray(pc.not_equal(producer.slice(1), producer.slice(0, len(producer) - 1))) | (np.diff(block) != 0)]
        part = np.cumsum(change) - 1
        end = (producer[-1].as_py(), int(block[-1]))
        begin = int(np.searchsorted(part, 1)) if (producer[0].as_py(), int(block[0])) == self.block else 0
        goes_on = self.ranges.accept(seq[:begin])
        _, first = np.unique(part[begin:] << BLOCK_BITS | (seq[begin:] & ((1 << BLOCK_BITS) - 1)), return_index=True)
        if begin < seq.size:
            self.ranges, self.block = SeenRanges(), end
            self.ranges.accept(seq[part == part[-1]])
        return np.concatenate((goes_on, first + begin))

    def named(self, exact: pa.Array) -> np.ndarray:
        """Whether each exact key, in order, differs from the one before it."""
        other = np.asarray(pc.not_equal(exact.slice(1), exact.slice(0, len(exact) - 1)))
        fresh = np.r_[exact[0].as_py() != self.exact, other]
        self.exact = exact[-1].as_py()
        return fresh

    def accepted(self, producer: pa.Array, seq: pa.Array, exact: pa.Array, skip: np.ndarray) -> np.ndarray:
        has_seq, has_exact = np.asarray(pc.is_valid(seq)), np.asarray(pc.is_valid(exact))
        out = ~has_seq & ~has_exact
        at = np.flatnonzero(has_seq & ~skip)
        if at.size:
            where = pa.array(at)
            out[at[self.numbered(producer.take(where), np.asarray(seq.take(where)))]] = True
        at = np.flatnonzero(has_exact & ~skip)
        if at.size:
            out[at] = self.named(exact.take(pa.array(at)))
        return out


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gate = _Gate()
    for batch in batches:
        column = batch.schema.get_field_index
        earlier = np.asarray(batch.column(column(_DUP)))
        fresh = gate.accepted(*(batch.column(column(c)) for c in (_PRODUCER, _SEQ, _EXACT)), earlier)
        yield batch.set_column(column(_DUP), _DUP, pa.array(earlier | ~fresh))


def identifier_parts(df: DataFrame, id_col: str) -> tuple[Column, Column, Column]:
    """Producer, sequence number and exact key of an identifier column.

    Whole non-negative numbers are the sequence of one nameless producer. Strings are a producer
    followed by a decimal number of up to 18 digits without leading zeros. All other identifiers
    are malformed: their text is their key. A null identifier has none of the three.
    """
    c = F.col(id_col)
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        fine = c >= 0
        return F.when(fine, F.lit("")), F.when(fine, c.cast("long")), F.when(~fine, c.cast("string"))
    text = c.cast("string")
    shape = r"^(|.*[^0-9])(0|[1-9][0-9]{0,17})$"
    fine = text.rlike(shape)
    return (
        F.when(fine, F.regexp_extract(text, shape, 1)),
        F.when(fine, F.regexp_extract(text, shape, 2).cast("long")),
        F.when(~fine, text),
    )


def exactly_once(df: DataFrame, id_col: str, newest: list[str], carry: list[str] | None = None, flag: str = "is_kept") -> DataFrame:
    """Mark one copy of each message: ``carry`` columns plus the boolean ``flag``.

    The kept copy is the first in descending order of the ``newest`` columns (nulls last); rows
    equal in all of these are ordered by a hash of the carried columns, so that repeated rows keep
    exactly one copy, and the same one when a lost task runs again.

    Rows of a producer's block of 2^14 numbers come newest first and meet the disjoint ranges of
    numbers seen so far: an uncovered number is accepted and merged into the ranges, a covered one
    is a copy. Ranges are dropped where their block ends, so a task holds those of one block. This
    runs twice. Each input partition first gates its own rows, without a shuffle, so an identifier
    that a third of all rows carry leaves a partition as one candidate. Candidates then meet in the
    task of their block; rows already known as copies are spread evenly by their hash and only pass
    through. Malformed identifiers come sorted by their exact text and are looked up in the text
    before, in whole arrays. Rows with a null identifier have no copies and are all kept. An empty
    input gives an empty result. Columns other than those named are not read; names of the input
    can't clash, as only carried columns stay.
    """
    carry = list(carry or df.columns)
    producer, seq, exact = identifier_parts(df, id_col)
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    newest_first = [F.desc_nulls_last(f"__tl_o{i}") for i in range(len(newest))] + [F.asc(_ROW)]
    order = [F.col(_DUP), F.col(_PRODUCER), F.shiftright(_SEQ, BLOCK_BITS), F.col(_EXACT), *newest_first]
    gated = df.select(
        *carry,
        *[F.col(c).alias(f"__tl_o{i}") for i, c in enumerate(newest)],
        F.xxhash64(*carry).alias(_ROW),
        producer.alias(_PRODUCER),
        seq.alias(_SEQ),
        exact.alias(_EXACT),
        F.lit(False).alias(_DUP),
    )
    first = gated.sortWithinPartitions(*order).mapInArrow(_pass, gated.schema)
    home = F.xxhash64(_PRODUCER, F.shiftright(_SEQ, BLOCK_BITS), _EXACT)
    spread = first.withColumn("__tl_home", F.when(F.col(_DUP) | (F.col(_SEQ).isNull() & F.col(_EXACT).isNull()), F.col(_ROW)).otherwise(home))
    second = spread.repartition(parts, "__tl_home").drop("__tl_home").sortWithinPartitions(*order)
    return second.mapInArrow(_pass, gated.schema).select(*carry, (~F.col(_DUP)).alias(flag))


#: The state between batches: ranges within one block of numbers, or one malformed identifier.
SEEN = "producer string, block bigint, lo bigint, hi bigint, exact string"


def accept_batch(batch: DataFrame, seen: DataFrame, id_col: str, newest: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, new state) of one batch of a stream of deliveries.

    A row is accepted if its number is in no range of ``seen`` (schema ``SEEN``) and it is the
    newest of its batch; what an earlier batch accepted stays. Numbers meet only the ranges of
    their own block, at most 2^13 of them. Malformed identifiers are looked up by their text; rows
    without an identifier are all accepted. The state has a row for each range, not each number.
    """
    producer, seq, exact = identifier_parts(batch, id_col)
    tagged = batch.withColumns({_PRODUCER: producer, _SEQ: seq, _EXACT: exact, "__tl_block": F.shiftright(seq, BLOCK_BITS), _ROW: F.xxhash64(*batch.columns)})
    order = [F.desc_nulls_last(c) for c in newest] + [F.asc(_ROW)]
    nameless = tagged.filter(F.col(_SEQ).isNull() & F.col(_EXACT).isNull())
    named = tagged.filter(F.col(_SEQ).isNotNull() | F.col(_EXACT).isNotNull())
    first = named.withColumn("__tl_rn", F.row_number().over(Window.partitionBy(_PRODUCER, _SEQ, _EXACT).orderBy(*order))).filter("__tl_rn = 1")
    s = seen.select(*[F.col(c).alias(f"s_{c}") for c in ("producer", "block", "lo", "hi", "exact")])
    numbered = first.filter(F.col(_SEQ).isNotNull()).join(
        s.filter("s_lo is not null"),
        (F.col(_PRODUCER) == F.col("s_producer")) & (F.col("__tl_block") == F.col("s_block")) & F.col(_SEQ).between(F.col("s_lo"), F.col("s_hi")),
        "left_anti",
    )
    odd = first.filter(F.col(_SEQ).isNull()).join(s.filter("s_exact is not null"), F.col(_EXACT) == F.col("s_exact"), "left_anti")
    accepted = numbered.unionByName(odd).drop("__tl_rn")
    points = accepted.select(F.col(_PRODUCER).alias("producer"), F.col("__tl_block").alias("block"), F.col(_SEQ).alias("lo"), F.col(_SEQ).alias("hi"), F.col(_EXACT).alias("exact"))
    every = seen.unionByName(points)
    line = Window.partitionBy("producer", "block").orderBy("lo")
    ranges = every.filter("lo is not null").withColumn("new", F.when(F.col("lo") <= F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1))
    merged = (
        ranges.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("producer", "block", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("producer", "block", "lo", "hi", F.lit(None).cast("string").alias("exact"))
    )
    return accepted.unionByName(nameless).select(*batch.columns), merged.unionByName(every.filter("exact is not null"))


def seen_ranges(df: DataFrame, id_col: str) -> DataFrame:
    """The disjoint ranges of numbers seen: (producer string, lo, hi, n_numbers longs).

    Islands are found in blocks of 2^14 numbers, then joined in blocks of 2^28, 2^42, 2^56 and all:
    at each level only ranges that touch the edge of a smaller block can meet another, at most two
    for each of these, so no task has more than 2^15 ranges to join however many a producer has;
    all others are spread evenly. Malformed and null identifiers are in no range.
    """
    producer, seq, _ = identifier_parts(df, id_col)
    numbers = df.select(producer.alias("producer"), seq.alias("seq")).filter(F.col("seq").isNotNull()).distinct()
    block = Window.partitionBy("producer", F.shiftright("seq", BLOCK_BITS)).orderBy("seq")
    ranges = (
        numbers.withColumn("island", F.col("seq") - F.row_number().over(block))
        .groupBy("producer", F.shiftright("seq", BLOCK_BITS).alias("block"), "island")
        .agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .select("producer", "lo", "hi")
    )
    for bits in range(BLOCK_BITS, 64, BLOCK_BITS):
        below = F.lit((1 << bits) - 1)
        edge = (F.col("lo").bitwiseAND(below) == 0) | (F.col("hi").bitwiseAND(below) == below)
        wider = F.shiftright("lo", bits + BLOCK_BITS) if bits + BLOCK_BITS < 63 else F.lit(0).cast("long")
        # a range away from every edge has a group of its own
        placed = ranges.withColumns({"block": wider, "own": F.when(edge, -1).otherwise(F.col("lo"))})
        line = Window.partitionBy("producer", "block", "own").orderBy("lo")
        opens = F.when(F.lag("hi").over(line) + 1 == F.col("lo"), 0).otherwise(1)
        runs = placed.withColumn("new", opens).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        ranges = runs.groupBy("producer", "block", "own", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("producer", "lo", "hi")
    return ranges.withColumn("n_numbers", F.col("hi") - F.col("lo") + 1)
