"""Streams against plain sequential loops."""

import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from listwright import config, schemas
from listwright.operators.history import PRICE_FIELDS
from listwright.sources import landing
from listwright.sources.tables import Store
from listwright.streaming import state
from listwright.streaming.imports import continuous_import, json_submissions
from test_imports import GOLDEN
from test_ordered import SCHEMA, T0, _loop, _rows


def test_change_gate_begins_with_stored_rows_and_goes_on(spark, tmp_path):
    rows = _rows(7, n=120)
    on_file = {0: (T0 + dt.timedelta(hours=50), 1.0, None), 2: (T0, 2.0, 1.0)}
    stored = spark.createDataFrame([(k, *v) for k, v in on_file.items()], "k long, at timestamp, selling_price double, mrp double")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        kept = state.changed(spark.readStream.schema(SCHEMA).parquet(source), "k", "arrival", "at", PRICE_FIELDS, stored)
        state.to_table(kept, out, checkpoint).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(out).collect()
    assert {r.arrival for r in got} == _loop(rows, on_file) and len(got) == len({r.arrival for r in got})


def test_state_runs_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, T0, 1.0, None), (1, 2, T0, 1.0, None)], SCHEMA).write.parquet(source)
    kept = state.changed(spark.readStream.schema(SCHEMA).parquet(source), "k", "arrival", "at", PRICE_FIELDS, ttl="1 second")
    query = state.to_table(kept, out, str(tmp_path / "state"), once=False)
    try:
        arrivals = lambda: [r.arrival for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(out).collect()] if os.path.isdir(out) else []
        _until(lambda: arrivals() == [1])
        time.sleep(2)
        spark.createDataFrame([(1, 3, T0, 1.0, None)], SCHEMA).write.mode("append").parquet(source)
        _until(lambda: sorted(arrivals()) == [1, 3])
    finally:
        query.stop()


def _until(done, seconds=60):
    end = time.monotonic() + seconds
    while not done():
        assert time.monotonic() < end
        time.sleep(1)


def test_json_submissions_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    camel = {landing._camel(k): v for k, v in GOLDEN.items()} | {"complaints": ["lids leak:40", {"theme": "thin", "mentionCount": 3}, "a"]}
    (tmp_path / "in" / "1.json").write_text(json.dumps({"records": [camel, {**camel, "productId": "OTHER", "productUrl": "https://shop.in/2", "productName": "Second"}]}))
    store, now = Store(spark, str(tmp_path / "store")), F.to_timestamp(F.lit("2026-10-01 00:00:00"))
    feed = lambda: continuous_import(json_submissions(spark, str(tmp_path / "in")), store, str(tmp_path / "state"), now, config.marketplaces(spark), True, first=1).awaitTermination()
    feed()
    feed()
    products = {r.name: r for r in store.read_snapshot("products", schemas.PRODUCTS).collect()}
    assert products.keys() == {"Leakproof Bottle", "Second"} and len(store.commits()) == 1
    points = store.read_snapshot("pain_points", schemas.PAIN_POINTS).where(F.col("product_id") == products["Second"].product_id)
    assert sorted((r.theme, r.mention_count) for r in points.collect()) == [("a", None), ("lids leak", 40), ("thin", 3)]


def test_lists_in_json_submissions(spark, tmp_path):
    entries = [{"complaints": ["lids leak", "weak hinge:7"], "features": [], "brand": "[x]"}, {"complaints": "a|b:2"}, {"complaints": [None, " "], "colors": ["red", 3]}, {"complaints": "[not json"}]
    (tmp_path / "a.json").write_text(json.dumps(entries))
    rows = {r.record_no: r for r in landing.read_research_json(spark, str(tmp_path / "a.json")).collect()}
    assert [rows[i].complaints for i in range(1, 5)] == ["lids leak|weak hinge:7", "a|b:2", " ", "[not json"]
    assert rows[1].features is None and rows[1].brand == "[x]" and rows[3].colors == "red|3"
