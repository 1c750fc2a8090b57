import os
import random
from bisect import bisect_left, insort

import numpy as np
import pytest

from touchline.llm.packing import combine_texts, configurations, containers, pack, pack_documents, packing_report, text_key
from touchline.llm.tokens import VOCABULARY, token_count, token_sizes


@pytest.mark.parametrize("capacity", [100, 512, 8192, 50_000])
@pytest.mark.parametrize("shape", ["even", "large", "small", "equal"])
def test_nothing_overflows_and_little_is_unused(capacity, shape):
    rnd = np.random.default_rng(3)
    n = 20_000
    sizes = {
        "even": rnd.integers(0, capacity + 1, n),
        "large": rnd.integers(capacity // 2 + 1, capacity + 1, n),
        "small": rnd.integers(0, max(2, capacity // 20), n),
        "equal": np.full(n, capacity // 3),
    }[shape]
    place = pack(sizes, capacity)
    assert (place >= 0).all()
    fill = np.bincount(place, weights=sizes)
    assert fill.max() <= capacity
    used = np.unique(place).size
    # best-fit decreasing, item by item, is the plain measure
    rooms = []
    for s in sorted(sizes.tolist(), reverse=True):
        at = bisect_left(rooms, s)
        left = rooms.pop(at) - s if at < len(rooms) else capacity - s
        insort(rooms, left)
    opened = len(rooms)
    assert used <= opened * 1.015 + 2


def test_configurations_meet_the_demand():
    size, demand = np.array([130, 240, 380, 490]), np.array([100, 80, 77, 3])
    chosen = configurations(size, demand, 1000)
    assert (sum(c * t for c, t in chosen) == demand).all()
    assert all((c * size).sum() <= 1000 for c, _ in chosen)
    assert sum(t for _, t in chosen) <= np.ceil((size * demand).sum() / 1000) * 1.06


DDL = "doc_id bigint, n_tokens int, profile string, shard int"
LIMITS = [("s", 64), ("m", 500), ("none", None), (None, 5), ("zero", 0)]


def test_documents_come_out_whole(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 20, 63, 64, 65, 128, 300, 5000, None]), "x", 1) for i in range(700)]
    rows += [(1, 30, "x", 1)] * 300  # one id holds a third of all rows
    packed = pack_documents(spark.createDataFrame(rows, DDL), "doc_id", "n_tokens", LIMITS, shard_rows=200)
    got = packed.collect()
    for profile, capacity in LIMITS[:2]:
        mine = [r for r in got if r.profile == profile]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n, *_ in rows)
        held = {}
        pieces = {}
        for r in mine:
            held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.token_from, r.token_to))
        assert max(held.values()) <= capacity
        for i, n, *_ in rows:
            if n is None or i == 1:
                continue
            parts = sorted(pieces[i])
            assert len(parts) == max(1, -(-n // capacity))
            assert parts[0][1] == 0 and parts[-1][2] == n
            assert all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    assert {r.profile for r in got} == {"s", "m"}
    report = {r.profile: r for r in packing_report(packed).collect()}
    assert report["m"].used_share > 0.97 and report["m"].n_containers >= report["m"].least_containers
    assert containers(packed, "doc_id").filter("unused < 0").count() == 0


def test_empty(spark):
    empty = spark.createDataFrame([], DDL)
    assert pack_documents(empty, "doc_id", "n_tokens", LIMITS).count() == 0
    assert pack_documents(empty, "doc_id", "n_tokens", []).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_texts_come_back_whole(spark):
    texts = ["one two three", "", None, "Καλημέρα κόσμε " * 60, "日本語のとても長い文 😀" * 40, "x y" * 5]
    df = spark.createDataFrame([(i, t, "l", 0) for i, t in enumerate(texts)], "doc_id bigint, t string, l string, piece int")
    sizes = df.select("doc_id", token_count("t").alias("n_tokens"))
    packed = pack_documents(sizes, "doc_id", "n_tokens", [("s", 50), ("m", 300)])
    rows = combine_texts(packed, df, "doc_id", "t", between="\0").collect()
    parts = packed.collect()
    for profile in ("s", "m"):
        held = {r.container_id: r.text.split("\0") for r in rows if r.profile == profile}
        pieces = {}
        for c, listed in held.items():
            order = sorted((r.doc_id, r.piece) for r in parts if r.profile == profile and r.container_id == c)
            assert len(order) == len(listed)
            pieces |= dict(zip(order, listed))
        for i, t in enumerate(texts):
            if t is not None:
                assert "".join(pieces[k] for k in sorted(pieces) if k[0] == i) == t


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_combined_texts_fit_the_capacity(spark):
    rnd = random.Random(5)
    words = ["one", "two ", "Καλημέρα", "日本語", "😀", "𓀀𓁐", "\r\n", "\n\n", "42", "--", "…"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 8, 20, 90])))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, t string")
    sizes = df.select("doc_id", token_sizes("t").alias("s")).select("doc_id", "s.*")
    assert sizes.select("n_tokens").collect() == df.select(token_count("t").alias("n_tokens")).collect()
    packed = pack_documents(sizes, "doc_id", "n_tokens", [("s", 25), ("m", 120)], inside="inside")
    combined = combine_texts(packed, df, "doc_id", "t").withColumn("real", token_count("text")).collect()
    assert all(r.real <= r.capacity for r in combined)
    for profile in ("s", "m"):
        held = sorted(x for r in combined if r.profile == profile for x in r.text.replace("\n", ""))
        assert held == sorted(x for _, t in rows for x in t.replace("\n", ""))
    unused = {(r.profile, r.container_id): r.unused for r in containers(packed, "doc_id").collect()}
    assert all(unused[r.profile, r.container_id] == r.capacity - r.n_tokens - (r.n_texts - 1) >= 0 for r in combined)
    assert all(r.text_share < r.used_share <= 1 and r.n_containers >= r.least_containers for r in packing_report(packed).collect())


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_repeated_and_null_ids_keep_their_texts(spark):
    rows = [(1, "short"), (1, "日本語のとても長い文 😀" * 30), (1, "word " * 200), (1, "short"), (None, "no id"), (None, "other " * 100), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, t string")
    sizes = df.select("doc_id", text_key("t").alias("k"), token_sizes("t").alias("s")).select("doc_id", "k", "s.*")
    packed = pack_documents(sizes, "doc_id", "n_tokens", [("s", 40), ("l", 2000)], inside="inside", key="k")
    combined = combine_texts(packed, df, "doc_id", "t", key="k").withColumn("real", token_count("text")).collect()
    for profile in ("s", "l"):
        mine = [r for r in combined if r.profile == profile]
        assert sorted(x for r in mine for x in r.text.replace("\n", "")) == sorted(x for _, t in rows for x in t)
        assert all(r.real <= r.capacity for r in mine)
    whole = [t for r in combined if r.profile == "l" for t in r.text.split("\n")]
    assert sorted(whole) == sorted(t for _, t in rows)
    without = pack_documents(sizes, "doc_id", "n_tokens", [("l", 2000)])
    with pytest.raises(Exception, match="different texts of one doc_id"):
        combine_texts(without, df, "doc_id", "t").collect()


def test_the_same_rows_in_any_order_and_split(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 900)) for i in range(3000)] + [(5, 77)] * 2500 + [(None, 40)] * 3
    results = []
    for parts, seed in ((1, 1), (7, 2), (3, 3)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "id int, n int").repartition(parts)
        results.append(sorted(map(str, pack_documents(df, "id", "n", [("a", 500), ("b", 2048)], shard_rows=800).collect())))
    assert results[0] == results[1] == results[2]
    assert len({r.container_id >> 32 for r in pack_documents(df, "id", "n", [("a", 500)], shard_rows=800).collect()}) == 7
