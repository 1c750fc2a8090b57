from collections import Counter
from datetime import datetime, timedelta

from touchline.operators.references import Parent, Reference, dangling_references, reference_report

T0 = datetime(2024, 1, 31, 12)
CHILD = "k int, at timestamp, created_at timestamp, parent string, key string, n int"
PARENT = "id int, created_at timestamp, k string"


def _frames(spark, rows, parents):
    child = spark.createDataFrame(rows, CHILD)
    parent = spark.createDataFrame(parents, PARENT)
    return [Reference(child, "c", "k", "p", "at")], [Parent(parent, "p", "id")]


def _brute(rows, parents):
    born = {}
    for k, at, _ in parents:
        if k is not None:
            born[k] = min(filter(None, [born.get(k), at]), default=None)
    counts = Counter()
    for k, at, created, *_ in rows:
        if k is None:
            continue
        period = at.strftime("%Y-%m") if at else None
        if k not in born:
            counts[k, period, "missing"] += 1
        elif created and born[k] and created < born[k]:
            counts[k, period, "late"] += 1
    return counts


def test_missing_late_ties_nulls_and_a_hot_key(spark):
    rows = [(1, T0, T0, "x", "y", 1), (2, T0, T0, None, None, None), (None, T0, T0, "", "", 0), (3, None, T0, "", "", 0), (4, T0, None, "", "", 0)]
    rows += [(7, T0 + timedelta(days=i % 90), T0 + timedelta(hours=i), "h", "h", i) for i in range(300)]  # a third and more of all
    rows += rows[:2]
    parents = [(1, T0, "a"), (1, T0 + timedelta(days=9), "a"), (2, T0 + timedelta(days=1), "b"), (4, T0, None), (None, T0, None), (7, T0 + timedelta(hours=100), "h")]
    refs, pars = _frames(spark, rows, parents)
    want = _brute(rows, parents)
    found = {(r.ref_key, r.period, r.kind) for r in dangling_references(refs, pars).collect()}
    assert found == set(want)
    report = {(r.period, r.kind): (r.n_keys, r.n_rows) for r in reference_report(refs, pars).collect()}
    by = {}
    for (k, period, kind), n in want.items():
        keys, total = by.get((period, kind), (0, 0))
        by[period, kind] = (keys + 1, total + n)
    assert report == by


def test_empty_tables(spark):
    refs, pars = _frames(spark, [], [])
    assert dangling_references(refs, pars).count() == 0
    assert reference_report(refs, pars).count() == 0
    refs, pars = _frames(spark, [(5, T0, T0, "", "", 1)], [])
    assert [r.kind for r in dangling_references(refs, pars).collect()] == ["missing"]


def test_keys_of_other_types(spark):
    child = spark.createDataFrame([("a-1", T0, T0), ("b", T0, T0), ("7", T0, T0), (None, T0, T0)], "k string, at timestamp, created_at timestamp")
    text = spark.createDataFrame([("b", T0), ("c", T0)], "id string, created_at timestamp")
    whole = spark.createDataFrame([(7, T0 + timedelta(days=1))], "id int, created_at timestamp")
    refs = [Reference(child, "c", "k", p, "at") for p in ("text", "whole")]
    found = dangling_references([refs[0]], [Parent(text, "text", "id")])
    assert found.schema["ref_key"].dataType.simpleString() == "string"
    assert {(r.ref_key, r.kind) for r in found.collect()} == {("a-1", "missing"), ("7", "missing")}
    parents = [Parent(text, "text", "id"), Parent(whole, "whole", "id")]
    kinds = {r.ref_key: r.kind for r in dangling_references([refs[1]], parents).collect()}
    assert kinds == {"a-1": "missing", "b": "missing", "7": "late"}
    assert {(r.kind, r.n_keys) for r in reference_report([refs[1]], parents).collect()} == {("missing", 2), ("late", 1)}
