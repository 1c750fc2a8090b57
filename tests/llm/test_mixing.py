import random

import pytest

from touchline.llm.mixing import mix, mixing_rates, mixing_report

TARGETS = "source string, target_share double, max_repeats int, rate double"
SIZES = "doc_id bigint, source string, n_tokens int, copy int"


def _data(spark, targets):
    rnd = random.Random(6)
    rows = [(i, rnd.choices(["big", "mid", "small", "other", None], [60, 30, 6, 3, 1])[0], rnd.randrange(1, 400), 0) for i in range(6000)]
    rows += [(9000 + i, "big", None, 0) for i in range(3)] + [(9100, "big", 0, 0)]
    return rows, spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS)


def test_shares_are_met_within_the_repeats(spark):
    targets = [("big", 0.4, 1, 0.0), ("mid", 0.4, 2, 0.0), ("small", 0.2, 4, 0.0), ("absent", 0.1, 3, 0.0), (None, 0.5, 1, 0.0), ("big", 0.4, 1, 0.0)]
    rows, sizes, table = _data(spark, targets)
    sizes = sizes.filter("n_tokens is not null")
    rates = mixing_rates(sizes, table)
    got = mix(sizes, rates, "doc_id").collect()
    assert {(r.doc_id, r.copy) for r in got} == {(r.doc_id, r.copy) for r in mix(sizes.repartition(7), rates, "doc_id").collect()}
    most = {}
    for r in got:
        most[r.source] = max(most.get(r.source, 0), r.copy)
    assert set(most) == {"big", "mid", "small"}
    assert most["big"] <= 1 and most["mid"] <= 2 and most["small"] <= 4
    total = sum(r.n_tokens for r in got)
    for source, share in (("big", 0.4), ("mid", 0.4), ("small", 0.2)):
        assert sum(r.n_tokens for r in got if r.source == source) / total == pytest.approx(share, abs=0.02)
    report = {r.source: r for r in mixing_report(mix(sizes, rates, "doc_id"), rates).collect()}
    assert report["absent"].rate == 0 and report["absent"].actual_share == 0
    assert report["small"].rate == 4.0 or max(r.rate / r.max_repeats for r in report.values()) == pytest.approx(1)
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_fixed_total_caps_small_sources(spark):
    rows, sizes, table = _data(spark, [("big", 0.5, 1, 0.0), ("small", 0.5, 2, 0.0)])
    have = sum(n or 0 for _, s, n, _ in rows if s in ("big", "small"))
    rates = {r.source: r.rate for r in mixing_rates(sizes, table, total_tokens=have).collect()}
    assert rates["small"] == 2.0 and 0.4 < rates["big"] < 1


def test_nulls_and_empty(spark):
    _, sizes, table = _data(spark, [("big", None, 1, 0.0), ("mid", 0.3, None, 0.0)])
    assert mix(sizes, mixing_rates(sizes, table), "doc_id").count() == 0
    empty = spark.createDataFrame([], SIZES)
    rates = mixing_rates(empty, table)
    assert mix(empty, rates, "doc_id").count() == 0
    assert {r.actual_share for r in mixing_report(mix(empty, rates, "doc_id"), rates).collect()} == {0.0}
    assert mixing_rates(sizes, spark.createDataFrame([], TARGETS)).count() == 0
