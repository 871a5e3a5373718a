"""Imports end to end on small submissions."""

import pytest
from pyspark.sql import functions as F

from listwright import config, schemas
from listwright.operators import standardize
from listwright.plans import imports
from listwright.sources import landing
from listwright.sources.tables import Store, insert_if_absent, last_completed_run
from listwright.streaming.imports import continuous_import, submissions

GOLDEN = dict(
    product_name="Leakproof  Bottle", marketplace="Amazon_IN", product_url="https://www.amazon.in/dp/B0ABCDEFGH?ref=x", observed_price="₹1249", observed_at="2026-09-28T11:00:00+05:30",
    source_url="https://www.amazon.in/dp/B0ABCDEFGH", source_name="IndiaMART desk", product_id="B0ABCDEFGH", category="home-organization", brand="Acme Home", rating="4.1", review_count="860",
    supplier_cost="420", shipping_cost="95", marketplace_fee="180", product_dimensions="30x20x25", competition_signal="34", mrp="2199", complaints="lids leak:40|thin", confidence_score="0.9",
    cost_source_name="Supplier quote 12", verification_requested="yes",
)


def _raw(spark, rows):
    fields = sorted({k for r in rows for k in r})
    schema = "record_no long, " + ", ".join(f"{f} string" for f in fields)
    return spark.createDataFrame([(i, *[r.get(f) for f in fields]) for i, r in enumerate(rows, 2)], schema)


@pytest.fixture
def now():
    return lambda: F.to_timestamp(F.lit("2026-10-01 00:00:00"))


def test_golden_research_row(spark):
    row = standardize.research(_raw(spark, [GOLDEN])).first()
    assert row.selling_price == 1249 and row.url == "https://amazon.in/dp/B0ABCDEFGH" and row.costs.marketplace_fee_override == 180 and row.name == "Leakproof Bottle"
    assert tuple(row.dimensions) == (30, 20, 25) and row.pain_points[0].theme == "lids leak" and row.pain_points[0].mention_count == 40 and row.pain_points[1].mention_count is None
    assert row.discount_percentage == 43.2 and row.dataset_status == "UNVERIFIED" and row.verification_requested and row.malformed is None
    assert {o.field_name: o.numeric_value for o in row.observations}["observed_price"] == 1249


def _codes(spark, now, *changes):
    checked = imports.check_research(_raw(spark, [{**GOLDEN, **c} for c in changes]), now())
    found = {r.record_no: (r.code, r.errors) for r in checked.rejections.collect()}
    return [found.get(i) for i in range(2, 2 + len(changes))]


def test_first_failing_rule_gives_the_code(spark, now):
    got = _codes(
        spark, now, {}, {"source_name": "sample_data", "observed_price": None}, {"dataset_status": "sample"}, {"source_url": None, "observed_price": "", "observed_at": " - "},
        {"product_url": "https://example.com/x", "source_name": "manual_csv"}, {"source_name": "manual_csv", "rating": "9"}, {"rating": "9", "observed_price": "-1", "category": "toys"},
        {"category": "toys"}, {"category": None}, {"observed_price": "soon"}, {"observed_at": "yesterday"}, {"observed_at": "2026-10-05"},
    )
    assert [g and g[0] for g in got] == [
        None, "SEED_DATA_SOURCE", "SAMPLE_STATUS_NOT_ALLOWED", "MISSING_REQUIRED_FIELD", "PLACEHOLDER_URL", "SEED_DATA_SOURCE", "INVALID_VALUE", "UNKNOWN_CATEGORY", "UNKNOWN_CATEGORY",
        "MALFORMED_RECORD", "MALFORMED_RECORD", "INVALID_VALUE",
    ]
    assert [e.split()[0] for e in got[3][1]] == ["observed_price", "observed_at", "source_url"]
    assert got[6][1] == ["observed_price must be greater than zero, got -1", "rating must be between 0 and 5, got 9"]


def _import(spark, store, rows, run, now, research=True):
    imports.write_import(store, _raw(spark, rows), run, now(), config.marketplaces(spark), research)
    return {r.product_id: r for r in store.read_snapshot("products", schemas.PRODUCTS).collect()}


def _n(store, name, schema):
    return store.read_history(name, schema).count()


def test_import_reimport_and_changes(spark, now, tmp_path):
    store = Store(spark, str(tmp_path))
    other = {**GOLDEN, "product_id": None, "product_url": "https://shop.in/p/2/", "product_name": "Second one", "verification_requested": "no"}
    first = _import(spark, store, [GOLDEN, other, {**GOLDEN, "product_name": "same id again"}, {**other, "product_url": "https://shop.in/p/3"}], "run-1", now)
    assert sorted(p.dataset_status for p in first.values()) == ["UNVERIFIED", "VERIFIED"]
    report = {r.measure: r.n for r in store.read_history("reports", schemas.REPORTS).collect()}
    (logged,) = store.read_history("runs", schemas.RUNS).collect()
    assert (logged.run_id, logged.status, logged.received, logged.created, logged.updated, logged.rejected, logged.duplicates) == ("run-1", "completed", 4, 2, 0, 2, 2)
    noticed = store.read_history("findings", schemas.FINDINGS)
    assert {r.kind: r["count"] for r in noticed.groupBy("kind").count().collect()}["duplicate"] == 2
    assert report["submitted"] == 4 and report["created"] == 2 and report["duplicates_in_file"] == 2 and report["rejected"] == 2 and report["updated"] == 0
    assert _n(store, "prices", schemas.PRICES) == 2 and _n(store, "ledger", schemas.LEDGER) > 30

    again = _import(spark, store, [GOLDEN, other], "run-2", now)
    assert again.keys() == first.keys()
    assert _n(store, "prices", schemas.PRICES) == 2 and _n(store, "metrics", schemas.METRICS) == 2 and _n(store, "costs", schemas.COSTS) == 4

    changed = {**GOLDEN, "observed_price": "1199", "seller_count": "7", "complaints": None, "brand": None, "observed_at": "2026-09-29"}
    after = _import(spark, store, [changed], "run-3", now)
    (product,) = [p for p in after.values() if p.external_id == "B0ABCDEFGH"]
    assert product.brand is None and _n(store, "prices", schemas.PRICES) == 3 and _n(store, "metrics", schemas.METRICS) == 2
    assert store.read_snapshot("pain_points", schemas.PAIN_POINTS).where(F.col("product_id") == product.product_id).count() == 2

    commits = store.commits()
    replay = _import(spark, store, [changed], "run-3", now)
    assert replay == after and _n(store, "prices", schemas.PRICES) == 3 and store.commits() == commits


def test_a_failed_run_leaves_the_tables_and_is_logged(spark, now, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    before = _import(spark, store, [GOLDEN], "run-1", now)
    monkeypatch.setattr(imports.resolve, "snapshot", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        _import(spark, store, [{**GOLDEN, "observed_price": "5"}], "run-2", now)
    monkeypatch.undo()
    assert {r.product_id: r for r in store.read_snapshot("products", schemas.PRODUCTS).collect()} == before and _n(store, "prices", schemas.PRICES) == 1
    runs = {r.run_id: r for r in store.read_history("runs", schemas.RUNS).collect()}
    assert runs["run-2"].status == "failed" and "division" in runs["run-2"].error
    _import(spark, store, [{**GOLDEN, "observed_price": "5"}], "run-2", now)
    assert _n(store, "prices", schemas.PRICES) == 2 and last_completed_run(store.read_history("runs", schemas.RUNS), config.literal_table(spark, [(1, "x")], ["data_source_id", "name"])).first().run_id == "run-2"


def test_two_runs_from_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = store.begin("one"), store.begin("two")
    rows = spark.createDataFrame([("a",)], "k string")
    for run in (one, two):
        run.append("t", rows)
    one.commit()
    with pytest.raises(RuntimeError, match="repeat run two"):
        two.commit()
    assert store.read_history("t", "k string").count() == 1
    with store.begin("two") as again:
        again.append("t", rows)
    assert store.read_history("t", "k string").count() == 2


def test_several_files_are_one_submission(spark, now, tmp_path):
    head = "name,url,marketplace,category,selling_price,collected_at,product_cost\n"
    row = lambda i: f"Thing number {i},https://shop.in/{i},meesho,home-organization,{100 + i},2026-09-0{i},{i}\n"
    (tmp_path / "a.csv").write_text(head + row(1) + row(2))
    (tmp_path / "b.csv").write_text(head + row(3) + row(4) + row(4))
    raw = landing.read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted((r.record_no, r.line_no) for r in raw.collect()) == [(2, 2), (3, 3), (4, 2), (5, 3), (6, 4)]
    assert sorted(r.record_no for r in landing.read_csv(spark, str(tmp_path / "*.csv"), line_breaks=False).collect()) == [2, 3, 4, 5, 6]
    store = Store(spark, str(tmp_path / "store"))
    imports.write_import(store, raw, "r", now(), config.marketplaces(spark), False)
    report = {r.measure: r.n for r in store.read_history("reports", schemas.REPORTS).collect()}
    assert (report["received"], report["created"], report["skipped_duplicate"]) == (5, 4, 1) and _n(store, "costs", schemas.COSTS) == 4


def test_streams_on_a_used_store(spark, now, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    _import(spark, store, [GOLDEN], "run-1", now)
    head = "name,url,marketplace,category,selling_price,collected_at,product_cost\n"
    fields = head.strip().split(",")
    row = lambda i, price: f"Thing number {i},https://shop.in/{i},meesho,home-organization,{price},2026-09-0{i},1\n"

    def feed(name, *files):
        (tmp_path / name).mkdir(exist_ok=True)
        for file, text in files:
            (tmp_path / name / file).write_text(text)
        rows = submissions(spark, str(tmp_path / name), fields, max_files=1)
        continuous_import(rows, store, str(tmp_path / f"{name}-state"), now(), config.marketplaces(spark), False).awaitTermination()

    feed("first", ("1.csv", head + row(1, 10)), ("2.csv", head + row(2, 20)), ("3.csv", head + row(1, 11)))
    feed("second", ("1.csv", head + row(3, 30)))
    names = {r.name for r in store.read_snapshot("products", schemas.PRODUCTS).collect()}
    assert names == {"Leakproof Bottle", "Thing number 1", "Thing number 2", "Thing number 3"} and _n(store, "prices", schemas.PRICES) == 5
    commits = store.commits()
    feed("second")
    assert store.commits() == commits
    with pytest.raises(Exception):
        feed("third", ("1.csv", "url,name,marketplace,category,selling_price,collected_at,product_cost\nhttps://shop.in/9,Nine,meesho,home-organization,1,2026-09-01,1\n"))


def test_sample_products_are_never_matched_by_research(spark, now, tmp_path):
    store = Store(spark, str(tmp_path))
    demo = dict(name="Leakproof Bottle", url="https://amazon.in/dp/B0ABCDEFGH", marketplace="amazon_in", external_id="B0ABCDEFGH", category="home-organization", selling_price="999",
                collected_at="2026-09-01", source_name="seed_demo_data", is_sample_data="true")
    before = _import(spark, store, [demo], "demo", now, research=False)
    assert [p.dataset_status for p in before.values()] == ["SAMPLE"]
    after = _import(spark, store, [{**GOLDEN, "product_id": "OTHER"}], "real", now)
    assert len(after) == 2 and sorted(p.dataset_status for p in after.values()) == ["SAMPLE", "VERIFIED"]


def test_rows_of_a_batch_meet_by_url_and_conflicts_are_rejected(spark, now, tmp_path):
    store = Store(spark, str(tmp_path))
    at = lambda url, name, ext: {**GOLDEN, "product_url": url, "product_name": name, "product_id": ext}
    first = _import(spark, store, [at("https://shop.in/a", "one", "A"), at("https://shop.in/a", "two", "B"), at("https://shop.in/c", "three", "C")], "r1", now)
    assert len(first) == 2 and {p.name for p in first.values()} == {"two", "three"}
    _import(spark, store, [at("https://shop.in/a", "moved", "C")], "r2", now)
    assert [r.code for r in store.read_history("rejections", schemas.REJECTIONS).collect()] == ["CONFLICTING_URL"]


def test_listing_csv_scan(spark, now, tmp_path):
    text = (
        ' Name ,URL,Marketplace,category,selling_price,complaints\r\n"Box, ""large""",https://shop.in/1,meesho,home-organization,"₹1,200",thin|\r\n\r\n'
        '  ,https://shop.in/2,meesho,home-organization,5\r\nTwo part "x",https://shop.in/3,meesho,home-organization,free,a,extra\r\n'
    )
    (tmp_path / "s.csv").write_text(text, encoding="utf-8")
    rows = standardize.listings(landing.read_csv(spark, str(tmp_path / "s.csv")), now()).orderBy("record_no").collect()
    assert [(r.record_no, r.malformed) for r in rows] == [(2, None), (3, "name is empty"), (4, "selling_price 'free' is not a number")]
    assert rows[0].name == 'Box, "large"' and rows[0].selling_price == 1200 and rows[0].source_name == "manual_csv" and rows[0].source_url == "https://shop.in/1"


def test_research_json_shapes(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("{}")
    with pytest.raises(Exception, match="JSON payload must be an array"):
        landing.read_research_json(spark, str(tmp_path / "bad.txt")).count()
    (tmp_path / "a.json").write_text('[{"productName":"One","observedPrice":12.5,"productDimensions":{"lengthCm":1,"widthCm":2,"heightCm":3}}, null, {"product_name":"Two"}]')
    (tmp_path / "b.json").write_text('{"products":[{"productName":"Three","competition_signal":7}]}')
    rows = landing.read_research_json(spark, str(tmp_path / "*.json"))
    assert sorted(r.record_no for r in rows.collect()) == [1, 2, 3, 4]
    got = {(r.file[-6], r.line_no): r for r in rows.collect()}
    assert {k: v.product_name for k, v in got.items() if v.product_name} == {("a", 1): "One", ("a", 3): "Two", ("b", 1): "Three"}
    one = standardize.research(rows.where("product_name = 'One'")).first()
    assert one.selling_price == 12.5 and tuple(one.dimensions) == (1, 2, 3)


def test_insert_if_absent(spark):
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    incoming = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in insert_if_absent(stored, incoming, ["k"]).collect()] == [("b", 2)]


def test_scores_of_the_store(spark, now, tmp_path):
    import datetime as dt

    from listwright.plans import rescore

    store = Store(spark, str(tmp_path))
    other = {**GOLDEN, "product_id": "OTHER", "product_url": "https://shop.in/p/2/", "product_name": "Second one", "supplier_cost": None}
    _import(spark, store, [GOLDEN, other], "run-1", now)
    sources = config.literal_table(spark, [(1, "real_data_import")], ["data_source_id", "name"])
    cat = rescore.stored_catalog(store, config.fees(spark), config.marketplaces(spark), sources)
    rescore.write_scores(store, cat, dt.date(2026, 10, 1), "rescore-1", dt.datetime(2026, 10, 1))
    rows = {r.product_id: r for r in store.read_snapshot("scores", schemas.SCORES).collect()}
    assert len(rows) == 2 and {r.score_status for r in rows.values()} == {"COMPLETE", "INCOMPLETE"}
    assert all('"subScores"' in r.score_breakdown and r.computed_at == dt.datetime(2026, 10, 1) for r in rows.values())
    assert len(store.read_snapshot("products", schemas.PRODUCTS).collect()) == 2
