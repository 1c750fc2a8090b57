import random
from datetime import datetime, timedelta
from itertools import groupby

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm.runs import collapse_runs, to_symbols

T0 = datetime(2024, 1, 1)
DDL = "e int, at timestamp, id bigint, event string, chain string, slice string"


def _brute(rows, least=2):
    out = set()
    by = {}
    for e, at, i, event, *_ in rows:
        if e is not None and at is not None and event is not None:
            by.setdefault(e, []).append((at, i, event))
    for e, seq in by.items():
        for event, run in groupby(sorted(seq), key=lambda x: x[2]):
            run = list(run)
            if len(run) >= least:
                out.add((e, event, run[0][1], run[-1][1], run[0][0], run[-1][0], len(run), (run[-1][0] - run[0][0]).total_seconds()))
    return out


def _rows(n, hot, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e = 7 if rnd.random() < hot else rnd.choice([1, 2, 3, None, *range(20, 60)])
        rows.append((e, rnd.choice([T0, None]) if i % 50 == 0 else T0 + timedelta(minutes=rnd.randrange(n)), i, rnd.choice(["win", "win", "win", "draw", None, "a" * 3000]), "x", "y"))
    return rows


@pytest.mark.parametrize("hot, min_hot, chunk", [(0.1, 20_000, 1 << 18), (0.6, 60, 1 << 18), (0.6, 20_000, 50), (0.7, 80, 30)])
def test_runs_match_brute_force(spark, hot, min_hot, chunk):
    rows = _rows(900, hot)
    found = collapse_runs(spark.createDataFrame(rows, DDL), "e", "at", "id", "event", min_hot_rows=min_hot, chunk=chunk).collect()
    got = {(r.e, r.event, r.first_id, r.last_id, r.first_at, r.last_at, r.n_events, r.duration_s) for r in found}
    assert len(got) == len(found)
    assert got == _brute(rows)


@pytest.mark.parametrize("hot, min_hot, chunk", [(0.1, 20_000, 1 << 18), (0.6, 60, 40)])
def test_single_events_are_kept_where_asked(spark, hot, min_hot, chunk):
    rows = _rows(700, hot, 5)
    for least in (1, 3):
        found = collapse_runs(spark.createDataFrame(rows, DDL), "e", "at", "id", "event", least, min_hot, chunk).collect()
        got = {(r.e, r.event, r.first_id, r.last_id, r.first_at, r.last_at, r.n_events, r.duration_s) for r in found}
        assert len(got) == len(found) and got == _brute(rows, least)


@pytest.mark.parametrize("min_hot, chunk", [(50, 40), (20_000, 40), (50, 1 << 18)])
def test_one_run_over_all_cuts(spark, min_hot, chunk):
    rows = [(7, T0 + timedelta(hours=i), i, "win", "", "") for i in range(500)]
    found = collapse_runs(spark.createDataFrame(rows, DDL), "e", "at", "id", "event", min_hot_rows=min_hot, chunk=chunk).collect()
    assert [(r.first_id, r.last_id, r.n_events) for r in found] == [(0, 499, 500)]


def test_equal_times_ties_and_empty(spark):
    rows = [(1, T0, i, "draw", "", "") for i in range(30)] + [(1, T0, 30, "win", "", "")]
    found = collapse_runs(spark.createDataFrame(rows, DDL), "e", "at", "id", "event", min_hot_rows=5, chunk=8).collect()
    assert [(r.first_id, r.n_events) for r in found] == [(0, 30)]
    assert collapse_runs(spark.createDataFrame([], DDL), "e", "at", "id", "event").count() == 0


@pytest.mark.parametrize("tie", ["bigint", "string"])
def test_an_instant_that_most_rows_share(spark, tie):
    rnd = random.Random(2)
    rows = [(7, T0 + timedelta(hours=rnd.choice([0, 1, 1, 1, 1, 1, 2])), i, "win" if i % 40 else "draw", "", "") for i in range(900)]
    rows += [(rnd.choice([1, 2]), T0 + timedelta(hours=i % 9), 1000 + i, "win", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, DDL)
    if tie == "string":
        df = df.withColumn("id", F.lpad(F.col("id").cast("string"), 6, "0"))
    found = collapse_runs(df, "e", "at", "id", "event", 1, min_hot_rows=60).collect()
    got = {(r.e, r.event, int(r.first_id), int(r.last_id), r.first_at, r.last_at, r.n_events, r.duration_s) for r in found}
    assert len(got) == len(found) and got == _brute(rows, 1)


def test_many_kinds_of_event_have_symbols_of_their_own():
    n = 60_000
    symbols = to_symbols(pa.array([f"e{i}" for i in range(n)]))
    assert len(set(symbols.tolist())) == n
    assert not ((symbols >= 0xD800) & (symbols < 0xE000)).any()
