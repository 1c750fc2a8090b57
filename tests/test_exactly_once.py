import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from touchline.operators.exactly_once import SEEN, SeenRanges, accept_batch, exactly_once, seen_ranges

T0 = datetime(2024, 1, 1)


def _newest(rows):
    best = {}
    for i, r in enumerate(rows):
        if r[0] is None:
            continue
        key = (r[1] is not None, r[1] or T0, r[2])
        if r[0] not in best or key > best[r[0]][0]:
            best[r[0]] = (key, r)
    return best


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_keeps_the_newest_of_each(spark, kind):
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        number = 5 if rnd.random() < 0.35 else rnd.randrange(-3, 300) + rnd.choice([0, 1 << 33])
        ident = number if kind == "bigint" else rnd.choice([f"p{number}", f"q-{number}", f"0{number}", "??", "", f"{number}", "9" * 40])
        rows.append((ident, T0 + timedelta(hours=rnd.randrange(50)), i, "x" * rnd.choice([0, 1, 500]), True))
    rows += [(None, T0, -1, None, None), (None, T0, -1, None, None), (rows[0][0], None, 99_999, None, None)]
    df = spark.createDataFrame(rows, f"id {kind}, updated timestamp, fid bigint, text string, __tl_dup boolean").drop("__tl_dup").repartition(6)
    marked = exactly_once(df, "id", ["updated", "fid"]).collect()
    assert len(marked) == len(rows)
    kept = [r for r in marked if r.is_kept]
    want = _newest(rows)
    assert {(r.id, r.fid) for r in kept if r.id is not None} == {(k, v[1][2]) for k, v in want.items()}
    assert sum(r.id is None for r in kept) == 2


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(7, T0, 1, "same")] * 200, "id bigint, updated timestamp, fid bigint, text string").repartition(5)
    marked = exactly_once(df, "id", ["updated", "fid"]).collect()
    assert sum(r.is_kept for r in marked) == 1 and len(marked) == 200


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, updated timestamp")
    assert exactly_once(df, "id", ["updated"]).count() == 0
    assert seen_ranges(df, "id").count() == 0


def test_ranges_stay_disjoint_and_sorted():
    rnd, seen, ranges = np.random.default_rng(2), set(), SeenRanges()
    for _ in range(60):
        numbers = rnd.integers(0, 900, rnd.integers(1, 40))
        got = {int(numbers[i]) for i in ranges.accept(numbers)}
        assert got == set(map(int, numbers)) - seen
        seen |= set(map(int, numbers))
        assert (ranges.lo[1:] > ranges.hi[:-1] + 1).all()
        assert set().union(*(range(a, b + 1) for a, b in zip(ranges.lo, ranges.hi))) == seen


def test_seen_ranges_join_across_blocks(spark):
    ids = list(range(16_380, 16_390)) + [20_000, 20_001, 40_000, -5]
    df = spark.createDataFrame([(i,) for i in ids * 2], "id bigint")
    assert sorted((r.lo, r.hi, r.n_numbers) for r in seen_ranges(df, "id").collect()) == [(16_380, 16_389, 10), (20_000, 20_001, 2), (40_000, 40_000, 1)]


def test_seen_ranges_join_at_every_level(spark):
    ids = [b + d for b in (1 << 14, 1 << 28, 1 << 42, 1 << 56, 3 << 56, 1 << 62) for d in (-2, -1, 0, 1)] + [7, (1 << 63) - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    want = [(b - 2, b + 1) for b in (1 << 14, 1 << 28, 1 << 42, 1 << 56, 3 << 56, 1 << 62)] + [(7, 7), ((1 << 63) - 1,) * 2]
    assert sorted((r.lo, r.hi) for r in seen_ranges(df, "id").collect()) == sorted(want)
    whole = spark.range(5, 70_000).withColumnRenamed("id", "n").selectExpr("concat('p', n) AS id")
    assert [tuple(r) for r in seen_ranges(whole, "id").collect()] == [("p", 5, 69_999, 69_995)]


def test_batches_accept_once(spark):
    rnd = random.Random(8)
    seen, accepted, every = spark.createDataFrame([], SEEN), [], set()
    for b in range(3):
        rows = [(rnd.choice([f"p{rnd.randrange(60)}", "bad", None]), T0, b * 1000 + i) for i in range(150)]
        every |= {r[0] for r in rows if r[0]}
        took, seen = accept_batch(spark.createDataFrame(rows, "id string, at timestamp, n int"), seen, "id", ["at", "n"])
        seen = spark.createDataFrame(seen.collect(), SEEN)
        accepted += [r.id for r in took.collect()]
    named = [a for a in accepted if a]
    assert sorted(named) == sorted(every)
    ranges = [r for r in seen.collect() if r.lo is not None]
    assert sum(r.hi - r.lo + 1 for r in ranges) == len(every) - 1


def test_scattered_numbers_leave_nothing_behind():
    """A task holds the ranges of one block, so the work is in proportion to the rows."""
    import pyarrow as pa

    from touchline.operators.exactly_once import _Gate

    rng = np.random.default_rng(2)
    seq = np.sort(rng.integers(0, 1 << 60, 400_000))
    seq[1::4] = seq[::4]
    gate, kept = _Gate(), 0
    for a in range(0, seq.size, 10_000):
        part = pa.array(seq[a : a + 10_000])
        kept += int(gate.accepted(pa.array([""] * len(part)), part, pa.nulls(len(part), pa.string()), np.zeros(len(part), bool)).sum())
        assert gate.ranges.lo.size <= 2
    assert kept == np.unique(seq).size


def test_only_malformed_identifiers(spark):
    import uuid

    rnd = random.Random(3)
    ids = [f"{uuid.UUID(int=rnd.getrandbits(128))}x" for _ in range(300)]
    rows = [(rnd.choice(ids), i) for i in range(2000)]
    marked = exactly_once(spark.createDataFrame(rows, "id string, at int").repartition(5), "id", ["at"]).collect()
    newest = {}
    for k, at in rows:
        newest[k] = max(at, newest.get(k, -1))
    assert {(r.id, r.at) for r in marked if r.is_kept} == set(newest.items())
    assert len(marked) == len(rows) and sum(r.is_kept for r in marked) == len(newest)
