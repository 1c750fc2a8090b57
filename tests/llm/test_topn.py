import random

import pytest
from pyspark.sql import functions as F

from touchline.llm.topn import latest_of_key, top_n

DDL = "g int, item string, score double, streak int, __tl_rn int, rank string"


def _order():
    return [F.desc("score"), F.desc_nulls_last("streak"), F.asc("item")]


def _brute(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    key = lambda r: (0 if r[2] is None else 1, r[2] if r[2] is not None else 0)
    out = set()
    for g, rs in groups.items():
        rs = sorted(rs, key=lambda r: r[1])
        rs = sorted(rs, key=lambda r: (r[3] is not None, r[3] or 0), reverse=True)
        rs = sorted(rs, key=key, reverse=True)
        out |= {(g, r[1]) for r in rs[:n]}
    return out


@pytest.mark.parametrize("heavy", [20_000, 50])
@pytest.mark.parametrize("ties", [True, False])
def test_split_matches_one_sort(spark, heavy, ties):
    rnd = random.Random(4)
    rows = []
    for i in range(1200):
        g = 1 if i % 3 == 0 else rnd.choice([2, 3, None, *range(10, 60)])
        rows.append((g, f"i{i:05d}", 0.5 if ties else rnd.choice([None, round(rnd.random(), 2)]), rnd.choice([None, 1, 2, 9]), 0, "x"))
    df = spark.createDataFrame(rows, DDL).drop("__tl_rn", "rank")
    found = top_n(df, "g", "score", _order(), 7, "rank", heavy_rows=heavy).collect()
    assert {(r.g, r.item) for r in found} == _brute(rows, 7)
    assert len(found) == len(_brute(rows, 7))
    ranks = sorted(r["rank"] for r in found if r.g == 1)
    assert ranks == list(range(1, 8))


def test_latest_of_key_and_empty(spark):
    ddl = "k int, at int, v double"
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 2, None), (2, None, 1.0), (None, 3, 2.0)], ddl)
    assert {tuple(r) for r in latest_of_key(df, ["k"], "at", ["v"]).collect()} == {(1, None), (2, 1.0), (None, 2.0)}
    empty = spark.createDataFrame([], DDL).drop("__tl_rn", "rank")
    assert top_n(empty, "g", "score", _order(), 3).count() == 0
    assert top_n(spark.createDataFrame([(1, "a", 1.0, 1, 0, "")], DDL).drop("__tl_rn", "rank"), "g", "score", _order(), 0).count() == 0


def test_heavy_groups_of_every_kind_of_score(spark):
    nan, inf = float("nan"), float("inf")
    scores = [nan, inf, -inf, 1e305, -1e305, 0.0, -0.0, 1e-9, -1e-9, -5.25, None, 3.0, 3.0000001, 17.0]
    rnd = random.Random(8)
    rows = [(g, f"i{i:05d}", rnd.choice(scores), rnd.choice([None, 1, 2])) for i, g in enumerate(rnd.choices([1, 2, None, 4], [5, 3, 3, 0.2], k=900))]
    df = spark.createDataFrame(rows, "g int, item string, score double, streak int")
    for nulls, order in ((F.desc("score"), 0), (F.desc_nulls_first("score"), 1)):
        for n in (1, 9, 400):
            got = {(r.g, r.item) for r in top_n(df, "g", "score", [nulls, F.desc_nulls_last("streak"), F.asc("item")], n, heavy_rows=60).collect()}
            want = set()
            for g in {r[0] for r in rows}:
                key = lambda r: ((order if r[2] is None else 1 - order), r[2] != r[2], 0 if r[2] is None or r[2] != r[2] else r[2] + 0.0, r[3] is not None, r[3] or 0)
                mine = sorted(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), key=key, reverse=True)
                want |= {(g, r[1]) for r in mine[:n]}
            assert got == want, (n, order)


def test_plan_does_not_grow_with_heavy_groups(spark):
    rows = [(g, i) for g in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, score int").repartition(3)
    few, many = (len(top_n(df, "g", "score", [F.desc("score")], 3, heavy_rows=h)._jdf.queryExecution().optimizedPlan().toString()) for h in (10**6, 30))
    assert abs(few - many) < 200
    assert top_n(df, "g", "score", [F.desc("score")], 3, heavy_rows=30).count() == 36
