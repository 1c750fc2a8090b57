from datetime import datetime

import pytest
from pyspark.sql import functions as F

from touchline.operators import quality, upsert
from touchline.operators.search import similar, trigrams

T0, T1 = datetime(2024, 1, 1), datetime(2024, 6, 1)
DDL = "id bigint, k int, v string, w int, updated_at timestamp"


def _now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_coalesce_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a", 1, T0), (2, 2, "b", None, T0), (3, 3, "c", 3, T0)], DDL)
    new = spark.createDataFrame([(9, 1, None, 7, T0), (9, 2, "x", None, T0), (4, 4, None, 4, T0)], DDL)
    assert _rows(upsert.coalesce_upsert(old, new, ["k"], ["v", "w"], _now())) == [(1, 1, "a", 7, T1), (2, 2, "x", None, T1), (3, 3, "c", 3, T0), (4, 4, None, 4, T0)]
    assert _rows(upsert.coalesce_upsert(old.limit(0), new.limit(0), ["k"], ["v"], _now())) == []


def test_update_if_changed_and_null_safe(spark):
    old = spark.createDataFrame([(1, 1, "a", 1, T0), (2, 2, None, 1, T0), (3, 3, "c", 1, T0)], DDL)
    new = spark.createDataFrame([(None, 1, "a", 5, None), (None, 2, "b", 5, None), (None, 3, "d", 5, None), (None, 4, "e", 5, None)], DDL)
    plain = {r.k: (r.v, r.updated_at) for r in upsert.update_if_changed(old, new, ["k"], ["v"], _now()).collect()}
    assert plain == {1: ("a", T0), 2: (None, T0), 3: ("d", T1), 4: ("e", T1)}
    safe = {r.k: (r.v, r.updated_at) for r in upsert.update_if_changed(old, new, ["k"], ["v"], _now(), null_safe=True).collect()}
    assert safe[2] == ("b", T1)


def test_insert_absent_numbers_new_keys(spark):
    old = spark.createDataFrame([(10, 1, "a", 1, T0)], DDL)
    new = spark.createDataFrame([(None, 3, "c", 1, T0), (None, 1, "z", 1, T0), (None, 2, "b", 1, T0), (None, 2, "b", 1, T0), (None, None, "n", 1, T0)], DDL)
    assert [(r.id, r.k) for r in upsert.insert_absent(old, new, ["k"], "id").orderBy("id").collect()] == [(10, 1), (11, 2), (12, 3)]


def test_numbered_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS x").repartition(9)
    rows = upsert.numbered(df, ["x"], "n", 5).collect()
    assert sorted((r.x, r.n) for r in rows) == [(i, i + 6) for i in range(1000)]
    assert upsert.numbered(df.limit(0), ["x"], "n").count() == 0


def test_dedupe(spark):
    rows = [(1, 1, "a", None, T0), (2, 1, None, 5, T1), (3, 2, "b", 1, T0), (4, None, "n", 1, T0), (5, None, "n", 1, T0)]
    df = spark.createDataFrame(rows, DDL)
    assert (2, 1, "a", 5, T1) in {tuple(r) for r in upsert.dedupe_last_non_null(df, ["k"], ["updated_at"]).collect()}
    assert upsert.dedupe_last_non_null(df, ["k"], ["updated_at"]).count() == 4
    assert (2, 1, None, 5, T1) in {tuple(r) for r in upsert.dedupe_last_wins(df, ["k"], ["updated_at"]).collect()}
    assert [tuple(r) for r in upsert.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="ambiguous"):
        upsert.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        upsert.attach_keys(spark.createDataFrame([(None, 1)], "id bigint, k int"), df, "k", "id")


def test_replace_watermark_point_and_flag(spark):
    old = spark.createDataFrame([(1, 1, "a", 1, T0), (2, None, "b", 1, T0)], DDL)
    new = spark.createDataFrame([(3, 1, "x", 1, T1, 5), (4, None, "y", 1, T1, 6)], DDL + ", extra int")
    out = upsert.replace_keys(old, new, ["k"])
    assert {r.id for r in out.collect()} == {2, 3, 4} and "extra" in out.columns
    assert upsert.newer_than(new, old, "updated_at").count() == 2 and upsert.newer_than(old, old, "updated_at").count() == 0
    assert upsert.newer_than(old, old.limit(0), "updated_at").count() == 2
    assert upsert.newer_than(old, old.limit(0), "updated_at", empty_loads_all=False).count() == 0
    moved = upsert.point_update(old, spark.createDataFrame([(1, "q")], "k int, v string"), ["k"], "v", _now())
    assert {(r.id, r.v, r.updated_at) for r in moved.collect()} == {(1, "q", T1), (2, "b", T0)}
    flags = spark.createDataFrame([(1, False, None), (2, True, T0)], "k int, done boolean, at timestamp")
    marked = upsert.mark_done(flags, flags.filter("k = 1").unionByName(flags.filter("k = 1")), ["k"], "done", "at", _now())
    assert {tuple(r) for r in marked.collect()} == {(1, True, T1), (2, True, T0)}


def test_moved_kickoffs(spark):
    ddl = "k int, at timestamp, s string"
    api = spark.createDataFrame([(1, T1, ""), (2, T1, ""), (3, T0, ""), (4, None, ""), (9, T0, ""), (5, T1, "")], ddl)
    held = spark.createDataFrame([(1, T0, "NS"), (2, T0, "FT"), (3, T0, "NS"), (4, T0, "NS"), (5, None, "NS")], ddl)
    assert {(r.k, r.new_kickoff_utc) for r in upsert.moved_kickoffs(api, held, "k", "at", "s").collect()} == {(1, T1), (4, None)}


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", T0), (1, "b", T0), (None, None, T1)], "k int, v string, at timestamp")
    parent = spark.createDataFrame([(2,)], "k int")
    assert quality.not_null(df, "k").count() == 1 and quality.unique(df, "k").first().n_rows == 2
    assert quality.accepted_values(df, "v", ["a"]).count() == 1
    assert quality.relationships(df, "k", parent, "k").count() == 2
    state = lambda hours: quality.freshness(df, "at", F.lit(T1) + F.expr(f"interval {hours} hours")).first().state
    assert [state(h) for h in (24, 25, 48, 49)] == ["pass", "warn", "warn", "error"]
    assert quality.freshness(df.limit(0), "at", _now()).first().state == "error"
    checks = [quality.Check("t", "k", "not_null"), quality.Check("t", "v", "accepted_values", ["a"]), quality.Check("t", "k", "unique"), quality.Check("t", "k", "relationships", parent="p", parent_column="k")]
    assert {(r.kind, r.violations) for r in quality.run_checks({"t": df, "p": parent}, checks).collect()} == {("not_null", 1), ("accepted_values", 1), ("unique", 1), ("relationships", 2)}


def test_trigram_search(spark):
    names = spark.createDataFrame([(1, "Real Madrid"), (2, "Réal Mad"), (3, None), (4, ""), (5, "Other")], "id int, name string")
    index = trigrams(names, ["id"], "name")
    assert {r.trigram for r in index.filter("id = 5").collect()} == {"  o", " ot", "oth", "the", "her", "er "}
    best = similar(index, ["id"], "real madrid").orderBy(F.desc("similarity")).collect()
    assert best[0].id == 1 and best[0].similarity == 1.0


def test_search_trigrams_hold_teams_and_leagues(spark):
    from touchline.plans.operator_queries import QUERIES
    from touchline.plans.models import Warehouse

    root = "/root/testdata/sf0.001"
    index = QUERIES["o_search_trigrams"](spark, root)
    assert {r.entity_type for r in index.select("entity_type").distinct().collect()} == {"team", "league"}
    league = Warehouse(spark, root).ref("mart_dim_search").filter("entity_type = 'league'").orderBy("entity_id").first()
    found = similar(index, ["entity_type", "entity_id"], league.name).filter("similarity = 1").collect()
    assert ("league", league.entity_id) in {(r.entity_type, r.entity_id) for r in found}
