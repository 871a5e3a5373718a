"""The bucketed store: layers, commits, compaction, the key index and newest rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from listwright import config, schemas
from listwright.operators import history, resolve
from listwright.plans import imports
from listwright.sources import tables
from listwright.sources.tables import Conflict, Store, bucket_of
from test_imports import GOLDEN, _import, _n, _raw


@pytest.fixture
def now():
    return lambda: F.to_timestamp(F.lit("2026-10-01 00:00:00"))


def _points(spark, rows):
    return spark.createDataFrame(rows, "product_id string, type string, theme string")


def _held(store):
    return sorted((r.product_id, r.theme) for r in store.read_snapshot("pain_points", schemas.PAIN_POINTS).collect())


def test_a_layer_touches_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.begin("base") as run:
        run.write_snapshot("pain_points", _points(spark, [(f"p{i}", "complaint", t) for i in range(300) for t in "ab"]))
    before = store.manifest("pain_points")
    with store.begin("more") as run:
        run.upsert("pain_points", _points(spark, [("p1", "complaint", "c"), ("p2", "complaint", "d"), ("p2", "complaint", "e"), ("new", "positive", "f")]))
    after = store.manifest("pain_points")
    ids = _points(spark, [(p, "", "") for p in ("p1", "p2", "new")])
    touched = store.touched("pain_points", ids)
    assert 1 <= len(touched) <= 3 and [b for b in range(64) if before["live"][b] != after["live"][b]] == touched
    expected = sorted([(f"p{i}", t) for i in range(300) for t in "ab" if i not in (1, 2)] + [("p1", "c"), ("p2", "d"), ("p2", "e"), ("new", "f")])
    assert _held(store) == expected
    some = store.read_snapshot("pain_points", schemas.PAIN_POINTS, touched)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in some.inputFiles()} == set(touched)
    assert sorted((r.product_id, r.theme) for r in some.where("product_id IN ('p1', 'p2', 'new')").collect()) == [("new", "f"), ("p1", "c"), ("p2", "d"), ("p2", "e")]


def test_compaction_writes_full_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    with store.begin("base") as run:
        run.write_snapshot("pain_points", _points(spark, [(f"p{i}", "complaint", "0") for i in range(40)]))
    for k in range(1, 4):
        with store.begin(f"r{k}") as run:
            run.upsert("pain_points", _points(spark, [("p1", "complaint", str(k)), ("p7", "complaint", str(k))]))
    held, layers = _held(store), store.manifest("pain_points")
    full = [b for b, own in enumerate(layers["live"]) if len(own) == 4]
    assert store.compact(layers=3) == {"pain_points": len(full)} and store.compact(layers=3) == {}
    after = store.manifest("pain_points")
    assert _held(store) == held and all(len(after["live"][b]) == 1 for b in full)
    name = lambda m, b: [m["layers"][x][0] for x in m["live"][b]]
    assert all(name(after, b) == name(layers, b) for b in range(8) if b not in full)
    folders = lambda: {f for f in os.listdir(tmp_path / "pain_points") if f.startswith("at=")}
    assert store.vacuum(hours=1) == 0 and len(folders()) == 5
    assert store.vacuum(hours=-1) == 3 and len(folders()) == 2 and _held(store) == held


def test_a_driver_lost_at_any_step_blocks_nobody(spark, tmp_path, monkeypatch):
    class Lost(BaseException):
        pass

    steps = {"n": 0, "stop": 0}

    def counted(method):
        def call(self, *args, **kwargs):
            steps["n"] += 1
            if steps["n"] == steps["stop"]:
                raise Lost
            return method(self, *args, **kwargs)

        return call

    for owner, name in [(Store, "_write_text"), (Store, "_rename_new"), (tables.Run, "_layer")]:
        monkeypatch.setattr(owner, name, counted(getattr(owner, name)))

    def run(store, run_id, theme):
        if not store.is_committed(run_id):
            with store.begin(run_id) as r:
                r.upsert("pain_points", _points(spark, [("p", "complaint", theme)]))
                r.append("log", spark.createDataFrame([(run_id,)], "k string"))

    for stop in range(1, 8):
        store = Store(spark, str(tmp_path / str(stop)))
        steps.update(n=0, stop=0)
        run(store, "first", "1")
        steps.update(n=0, stop=stop)
        with pytest.raises(Lost):
            run(store, "lost", "2")
        steps.update(stop=0)
        assert _held(store) == [("p", "1")]
        run(store, "other", "3")
        assert _held(store) == [("p", "3")]
        run(store, "lost", "4")
        run(store, "lost", "5")
        assert _held(store) == [("p", "4")] and [r for _, r in store.commits()] == ["first", "other", "lost"]
        assert sorted(r.k for r in store.read_history("log", "k string").collect()) == ["first", "lost", "other"]


def test_an_import_that_meets_another_commit_is_repeated(spark, now, tmp_path, monkeypatch):
    store, real, met = Store(spark, str(tmp_path)), imports._write, []

    def crossed(*args):
        real(*args)
        if not met:
            met.append(1)
            with store.begin("other") as run:
                run.append("log", spark.createDataFrame([("x",)], "k string"))

    monkeypatch.setattr(imports, "_write", crossed)
    assert len(_import(spark, store, [GOLDEN], "mine", now)) == 1
    assert [r for _, r in store.commits()] == ["other", "mine"] and _n(store, "prices", schemas.PRICES) == 1
    with pytest.raises(Conflict), store.begin("late"):
        store.append("log", spark.createDataFrame([("y",)], "k string"), "earlier")


def test_withdrawn_keys_are_not_found(spark, now, tmp_path):
    store = Store(spark, str(tmp_path))
    moved = {**GOLDEN, "product_url": "https://shop.in/new", "product_name": "Renamed"}
    (product,) = _import(spark, store, [GOLDEN], "r1", now)
    assert _import(spark, store, [moved], "r2", now).keys() == {product}
    entries = store.read_snapshot("product_keys", schemas.PRODUCT_KEYS)
    assert {(r.kind, r.key) for r in entries.where("live").collect()} == {("external_id", "B0ABCDEFGH"), ("url", "https://shop.in/new"), ("normalized_name", "renamed")}
    assert {(r.kind, r.key) for r in entries.where("NOT live").collect()} == {("url", "https://amazon.in/dp/B0ABCDEFGH"), ("normalized_name", "leakproof bottle")}
    by_old_url = {**GOLDEN, "product_id": None, "product_name": "Something else"}
    assert len(_import(spark, store, [by_old_url], "r3", now)) == 2


def test_a_small_batch_opens_few_files(spark, now, tmp_path):
    store = Store(spark, str(tmp_path), buckets=32)
    products = spark.range(500).selectExpr("concat('p', id) AS product_id", "'amazon_in' AS marketplace", "concat('x', id) AS external_id", "concat('https://s.in/', id) AS url",
                                           "concat('name ', id) AS normalized_name", "'UNVERIFIED' AS dataset_status")
    with store.begin("base") as run:
        imports.load_products(run, products)
    rows = spark.createDataFrame([(1, "amazon_in", "x7", "https://s.in/none", "name 9"), (2, "amazon_in", None, "https://s.in/8", "n"), (3, "meesho", "x7", "", "")],
                                 "record_no long, marketplace string, external_id string, url string, normalized_name string")
    found = imports.by_index(store)(rows, False)
    assert {r.record_no: r.existing_id for r in found.collect()} == {1: "p7", 2: "p8", 3: None}
    opened = [f for f in found.inputFiles() if "/product_keys/" in f]
    assert 0 < len(opened) <= 7 and not any("/products/" in f for f in found.inputFiles())
    plain = resolve.match(rows, products)
    assert {tuple(r) for r in plain.select("record_no", "existing_id").collect()} == {(1, "p7"), (2, "p8"), (3, None)}


def test_newest_rows_follow_the_histories(spark, now, tmp_path):
    store = Store(spark, str(tmp_path))
    at = lambda price, day: {**GOLDEN, "observed_price": price, "observed_at": f"2026-09-{day}"}
    for k, row in enumerate([at("10", 10), at("12", 20), at("11", 15), at("12", 20), at("13", 20)]):
        _import(spark, store, [row], f"r{k}", now)
    rows = store.read_history("prices", schemas.PRICES)
    assert sorted(r.selling_price for r in rows.collect()) == [10, 11, 12, 13]
    (newest,) = store.read_snapshot("newest_prices", schemas.NEWEST_PRICES).collect()
    assert (newest.selling_price, newest.run_id, newest.collected_at) == (13, "r4", dt.datetime(2026, 9, 20))
    (cost,) = store.read_snapshot("newest_costs", schemas.NEWEST_COSTS).collect()
    assert cost.product_cost == 420 and cost.run_id == "r4"


def test_staged_copies_go_with_the_run(spark, now, tmp_path):
    from listwright.session import scratch_root

    listed = lambda: set(os.listdir(f"{scratch_root(spark)}/listwright")) if os.path.isdir(f"{scratch_root(spark)}/listwright") else set()
    raw, before = _raw(spark, [GOLDEN]), listed()
    imports.write_import(Store(spark, str(tmp_path)), raw, "r", now(), config.marketplaces(spark), True)
    assert listed() == before


def test_dimensions_are_stored_once(spark, now, tmp_path):
    store = Store(spark, str(tmp_path))
    seed = lambda run: tables.seed_dimensions(store, run, config.marketplaces(spark), config.fees(spark, [("nowhere", "default", "fixed_inr", 1.0, "x", "2026-01-01")]))
    assert [r.marketplace for r in seed("one").collect()] == ["nowhere"]
    places, fees = tables.dimension(store, "marketplaces").count(), tables.dimension(store, "fees").count()
    assert places == config.marketplaces(spark).count() and fees == config.fees(spark).count()
    seed("two")
    assert (tables.dimension(store, "marketplaces").count(), tables.dimension(store, "fees").count()) == (places, fees)
    imports.write_import(store, _raw(spark, [GOLDEN]), "r", now(), None, True)
    assert store.read_snapshot("products", schemas.PRODUCTS).count() == 1


def test_prompt_keys_need_no_replay(spark, monkeypatch):
    monkeypatch.setattr(history, "_replay", lambda *_: 1 / 0)
    t = lambda h: dt.datetime(2026, 1, 1, h)
    rows = spark.createDataFrame([(1, i, t(i), float(i // 3), None) for i in range(12)] + [(2, 20, t(3), 1.0, None)], "k long, arrival long, at timestamp, selling_price double, mrp double")
    on_file = spark.createDataFrame([(1, t(0), 0.0, None)], "k long, at timestamp, selling_price double, mrp double")
    got = history.changed_on_arrival(rows, "k", "arrival", "at", history.PRICE_FIELDS, on_file, limit=5)
    assert sorted(r.arrival for r in got.collect()) == [3, 6, 9, 20]
    with pytest.raises(ZeroDivisionError):
        history.changed_on_arrival(rows, "k", "arrival", "at", history.PRICE_FIELDS, on_file.withColumn("at", F.lit(t(9))))


def test_buckets_spread_keys(spark):
    counts = spark.range(6400).groupBy(bucket_of(F.col("id").cast("string"), 64)).count().collect()
    assert len(counts) == 64 and max(r["count"] for r in counts) < 200
