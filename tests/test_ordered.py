"""Hot groups by slices, the arrival change gate and greedy dedupe against plain sequential loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.operators import dedupe, history
from listwright.operators.skew import ranked, ranked_within, with_previous

T0 = dt.datetime(2026, 1, 1)


def _rows(seed, n=600, keys=5):
    """A third and more of the rows in one key."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.5 else rng.randrange(1, keys), i, T0 + dt.timedelta(hours=rng.randrange(200)), float(rng.randrange(3)), None if rng.random() < 0.5 else 1.0) for i in range(n)]


SCHEMA = "k long, arrival long, at timestamp, selling_price double, mrp double"


def test_positions_and_previous_rows_by_slices(spark):
    df = spark.createDataFrame(_rows(1), SCHEMA)
    order = [F.col("at").desc(), F.col("arrival")]
    plain = df.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert {(r.arrival, r.n) for r in ranked(df, order, "n", rows_per_slice=70).collect()} == {(r.arrival, r.n) for r in plain.collect()}
    within = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    for limit in (40, 10_000):
        assert {(r.arrival, r.n) for r in ranked_within(df, ["k"], order, "n", limit).collect()} == {(r.arrival, r.n) for r in within.collect()}
    lagged = df.withColumn("p", F.lag("selling_price").over(Window.partitionBy("k").orderBy("at", "arrival")))
    for limit in (40, 10_000):
        got = with_previous(df, ["k"], ["at", "arrival"], "selling_price", "p", limit)
        assert {(r.arrival, r.p) for r in got.collect()} == {(r.arrival, r.p) for r in lagged.collect()}


def _loop(rows, on_file):
    state, kept = dict(on_file), set()
    for k, arrival, at, price, mrp in sorted(rows, key=lambda r: r[1]):
        if k not in state or state[k][1:] != (price, mrp):
            kept.add(arrival)
            if k not in state or at >= state[k][0]:
                state[k] = (at, price, mrp)
    return kept


@pytest.mark.parametrize("seed,limit", [(2, 10_000), (3, 25), (4, 7)])
def test_change_gate_on_arrival(spark, seed, limit):
    rows = _rows(seed, n=300)
    on_file = {0: (T0 + dt.timedelta(hours=50), 1.0, None), 2: (T0, 2.0, 1.0)}
    stored = spark.createDataFrame([(k, *v) for k, v in on_file.items()], "k long, at timestamp, selling_price double, mrp double")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = history.changed_on_arrival(df, "k", "arrival", "at", history.PRICE_FIELDS, stored, limit)
    assert {r.arrival for r in got.collect()} == _loop(rows, {k: v for k, v in on_file.items()})


def test_change_gate_in_order_equals_the_loop(spark):
    rows = sorted(_rows(5), key=lambda r: (r[2], r[1]))
    rows = [(k, i, at, p, m) for i, (k, _, at, p, m) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (30, 10_000):
        got = history.changed_in_order(df, "k", ["at", "arrival"], history.PRICE_FIELDS, limit)
        assert {r.arrival for r in got.collect()} == _loop(rows, {})


def _greedy(rows):
    seen, kept = set(), set()
    for no, identity, name in sorted(rows):
        if identity not in seen and name not in seen:
            seen |= {identity, name}
            kept.add(no)
    return kept


@pytest.mark.parametrize("seed,rounds", [(1, 50), (2, 1), (3, 2), (4, 0)])
def test_dedupe_equals_the_loop(spark, seed, rounds):
    rng = random.Random(seed)
    rows = [(i, f"id{rng.randrange(60)}", "n0" if rng.random() < 0.4 else f"n{rng.randrange(50)}") for i in range(200)]
    df = spark.createDataFrame(rows, "record_no long, identity_key string, name_key string").repartition(3)
    assert {r.record_no for r in dedupe.keep_first(df, rounds).collect()} == _greedy(rows)


def test_dropped_rows_do_not_register_their_keys(spark):
    rows = [(1, "id1", "n1"), (2, "id1", "n2"), (3, "id2", "n2")]
    df = spark.createDataFrame(rows, "record_no long, identity_key string, name_key string")
    assert {r.record_no for r in dedupe.keep_first(df).collect()} == {1, 3}


def test_long_chains_and_a_hot_name(spark):
    chain = [(2 * i + k, f"id{i + k}", f"n{i}") for i in range(5_000) for k in (0, 1)]
    hot = [(20_000 + i, f"h{i % 700}", "hot" if i % 3 else f"m{i % 900}") for i in range(3_000)]
    df = spark.createDataFrame(chain + hot, "record_no long, identity_key string, name_key string").repartition(4)
    assert {r.record_no for r in dedupe.keep_first(df).collect()} == _greedy(chain + hot)


def test_positions_with_many_slices(spark, monkeypatch):
    from listwright.operators import skew

    monkeypatch.setattr(skew, "SLICE_GROUP", 3)
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"))
    assert all(r.n == r.v + 1 for r in ranked(df, [F.col("v")], "n", rows_per_slice=20).collect())
