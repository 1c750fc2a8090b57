import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from touchline.operators.history import SnapshotRuns, close_versions, entity_history, merge_runs

T0 = datetime(2024, 1, 1)
DDL = "e int, f string, at timestamp, created timestamp, rank int, form string, valid_from string, __x int"


def _brute(rows):
    best = {}
    for e, f, at, created, rank, form, *_ in rows:
        if at is None:
            continue
        key, new = (e, f, at), (created or datetime.min, rank, form)
        if key not in best or new[0] > best[key][0]:
            best[key] = new
    out, last = set(), {}
    for (e, f, at), (_, rank, form) in sorted(best.items(), key=lambda x: (str(x[0][:2]), x[0][2])):
        if last.get((e, f), "none") != (rank, form):
            out.add((e, f, at, rank, form))
        last[e, f] = (rank, form)
    ends = {}
    for e, f, at, *_ in sorted(out, key=lambda x: x[2], reverse=True):
        ends.setdefault((e, f), []).append(at)
    result = set()
    for e, f, at, rank, form in out:
        later = [t for t in ends[e, f] if t > at]
        result.add((e, f, rank, form, at, min(later) if later else None))
    return result


def _rows(n, seed, hot=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e = 1 if rnd.random() < hot else rnd.choice([1, 2, 3, 44, None])
        at = T0 + timedelta(hours=rnd.randrange(n // 2 + 1))
        created = at + timedelta(days=rnd.choice([0, 1, 400, 900]), seconds=i)
        rows.append((e, rnd.choice(["a", "b"]) if not hot else "a", at, created, rnd.choice([1, 1, 2, None]), rnd.choice(["W", "W", "", None]), "x", i))
    return rows


@pytest.mark.parametrize("hot, min_hot", [(0, 20_000), (0.6, 40), (0.9, 25)])
def test_versions_match_brute_force(spark, hot, min_hot):
    rows = _rows(600, 3, hot) + [(9, "z", None, T0, 1, "W", "x", 0), (8, "z", T0, None, 1, "W", "x", 0), (8, "z", T0, T0, 2, "W", "x", 0)]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, DDL)
    found = entity_history(df, ["e", "f"], "at", "created", ["rank", "form"], min_hot_rows=min_hot).collect()
    got = {(r.e, r.f, r.rank, r.form, r.valid_from, r.valid_to) for r in found}
    assert len(got) == len(found)
    assert got == _brute(rows)
    assert all(r.is_current == (r.valid_to is None) for r in found)


def test_one_state_over_many_slices(spark):
    rows = [(1, "a", T0 + timedelta(hours=i), T0 + timedelta(hours=i), 5, "W" * 10_000, "x", i) for i in range(400)]
    found = entity_history(spark.createDataFrame(rows, DDL), ["e", "f"], "at", "created", ["rank", "form"], min_hot_rows=30).collect()
    assert [(r.valid_from, r.valid_to) for r in found] == [(T0, None)]


def test_many_copies_of_one_instant(spark):
    rows = [(1, "a", T0, T0 + timedelta(hours=i % 7), i % 7, "W", "x", i) for i in range(500)] + _rows(200, 5)
    found = entity_history(spark.createDataFrame(rows, DDL), ["e", "f"], "at", "created", ["rank", "form"], min_hot_rows=40).collect()
    got = {(r.e, r.f, r.rank, r.form, r.valid_from, r.valid_to) for r in found}
    assert got == _brute(rows) and len(got) == len(found)


def test_keys_that_join_to_the_same_text_stay_apart(spark):
    odd = ["a\u0001b", "c", "a", "b\u0001c", "\u0002", None, "", "1:a", "-", "a\u0003"]
    rows = [(a, b, T0, T0, 1, "W") for a in odd for b in odd]
    df = spark.createDataFrame(rows, "e string, f string, at timestamp, created timestamp, rank int, form string")
    assert {(r.e, r.f) for r in entity_history(df, ["e", "f"], "at", "created", ["rank", "form"]).collect()} == {(a, b) for a in odd for b in odd}


@pytest.mark.parametrize("min_hot", [20_000, 60])
def test_a_new_run_joins_the_old_ones(spark, tmp_path, min_hot):
    first, second = _rows(500, 6, 0.5), _rows(300, 7, 0.5)
    runs = SnapshotRuns(spark, f"file://{tmp_path}/h", ["e", "f"], "at", "created", ["rank", "form"])
    runs.add(spark.createDataFrame(first, DDL), F.year("created"), min_hot)

    def written():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "h" / "runs").rglob("*.parquet")}

    def found():
        rows = runs.history().collect()
        got = {(r.e, r.f, r.rank, r.form, r.valid_from, r.valid_to) for r in rows}
        assert len(got) == len(rows)
        return got

    assert found() == _brute(first)
    old = written()
    runs.add(spark.createDataFrame(second, DDL), F.lit("second"))
    assert old.items() <= written().items() and len(written()) > len(old)
    assert found() == _brute(first + second)
    runs.add(spark.createDataFrame(second, DDL), F.lit("second"))  # a run written again takes its own place
    assert found() == _brute(first + second)


def test_files_are_replaced_in_one_step(spark, tmp_path):
    from touchline import files

    path = f"file://{tmp_path}/a/marker"
    assert files.read_text(spark, path) is None and files.children(spark, f"file://{tmp_path}/a") == []
    files.write_text(spark, path, "one é")
    files.write_text(spark, path, "two")
    assert files.read_text(spark, path) == "two" and files.exists(spark, path)
    assert files.children(spark, f"file://{tmp_path}/a") == ["marker"]
    assert abs(files.modified_at(spark, path) - __import__("time").time()) < 60
    files.delete(spark, path)
    assert not files.exists(spark, path)


def test_empty(spark):
    assert entity_history(spark.createDataFrame([], DDL), ["e", "f"], "at", "created", ["rank", "form"]).count() == 0


def _batch(rows):
    seg, t = [r[0] for r in rows], [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(seg, pa.string()), pa.array(t, pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["__tl_seg", "__tl_t", "__tl_d", "__tl_h", "v"])


def test_merge_keeps_one_batch_of_each_run():
    rnd = random.Random(1)
    opened, runs, everything = [], [], []
    for _ in range(5):
        rows = sorted((rnd.choice("abcdef"), rnd.randrange(50), None) for _ in range(rnd.randrange(200)))
        everything += rows

        def run(rows=rows):
            for i in range(0, len(rows), 7):
                opened.append(1)
                yield _batch(rows[i : i + 7])

        runs.append(run())
    seen, most = [], 0
    for table in merge_runs(runs):
        most = max(most, table.num_rows)
        seen += list(zip(table["__tl_seg"].to_pylist(), table["__tl_t"].to_pylist()))
    assert seen == sorted((a, b) for a, b, _ in everything)
    assert most <= 5 * 7


def test_nan_equals_nan():
    rows = [("a", 1, float("nan")), ("a", 2, float("nan")), ("a", 3, None), ("a", 4, None), ("a", 5, 1.0)]
    out = pa.concat_tables(close_versions(iter([pa.Table.from_batches([_batch(rows)])]), ["v"]))
    assert out["__tl_t"].to_pylist() == [1, 3, 5]
    assert out["__tl_to"].to_pylist() == [3, 5, None]
