"""Golden scores and economics on a handful of products."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listwright import config
from listwright.fixed import COMPONENTS
from listwright.operators import scoring
from listwright.operators.economics import with_economics, with_fees

BASE = dict(
    product_id="p", category="home-organization", marketplace="amazon_in", selling_price=1000.0, product_cost=300.0, shipping_cost=70.0, packaging_cost=30.0,
    marketplace_fee_override=150.0, payment_fee=20.0, advertising_cost=100.0, return_allowance=30.0, other_costs=10.0, source_name="desk", source_url="https://a.in",
    collected_at=dt.datetime(2026, 1, 1), weight_kg=0.3, length_cm=10.0, width_cm=10.0, height_cm=5.0, fragile=False, return_risk="none", regulatory_complexity="none",
    brand_ip_risk=False, seasonal_demand=False, established_brand_dominance=False, bundle_potential_score=None, review_count=1000, average_rating=4.0, competitor_count=50,
    pain_rows=4, complaint_count=4, opportunity_count=2, log_reviews_min=4.61512051684126, log_reviews_max=9.210440366976517, competitors_min=10, competitors_max=210,
    cohort_size=5, cohort_label="category:home-organization", dataset_status="VERIFIED",
)
TYPES = ", ".join(
    f"{k} " + ("timestamp" if k == "collected_at" else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string" if isinstance(v, str) else "double") for k, v in BASE.items()
)
EMPTY_FEES = "fee_id long, marketplace string, category string, fee_type string, fee_value double, source string, effective_date date"


@pytest.fixture(scope="module")
def score(spark):
    def run(*changes, fees=None):
        rows = [{**BASE, "product_id": str(i), **change} for i, change in enumerate(changes)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], TYPES)
        fees = spark.createDataFrame([], EMPTY_FEES) if fees is None else fees
        out = scoring.with_scores(with_economics(with_fees(df, fees, dt.date(2026, 6, 30))), config.scoring())
        return {r["product_id"]: r for r in out.collect()}

    return run


def test_economics(score):
    got = score({}, {"selling_price": 0.0}, dict(selling_price=300.0, product_cost=400.0, shipping_cost=50.0, **dict.fromkeys(
        ["packaging_cost", "marketplace_fee_override", "payment_fee", "advertising_cost", "return_allowance", "other_costs"])),
        dict(selling_price=500.0, product_cost=0.0, advertising_cost=100.0, **dict.fromkeys(["shipping_cost", "packaging_cost", "marketplace_fee_override", "payment_fee", "return_allowance", "other_costs"])))
    full = got["0"]
    assert (full["total_cost"], full["profit"], full["margin_pct"], full["landed_cost"], full["roi_pct"]) == (710, 290, 29, 400, 72.5)
    assert full["missing_costs"] == [] and full["is_reliable"]
    assert got["1"]["profit"] is None and got["1"]["is_reliable"] is None
    assert (got["2"]["profit"], got["2"]["margin_pct"], got["2"]["roi_pct"]) == (-150, -50, -33.33)
    assert len(got["2"]["missing_costs"]) == 6 and "No marketplace fee schedule" in got["2"]["economics_notes"][-1]
    assert got["3"]["profit"] == 400 and got["3"]["roi_pct"] is None


def test_fee_rules(score, spark):
    day = dt.date
    rows = [
        (1, "amazon_in", "default", "referral_percentage", 15.0, "a", day(2026, 1, 1)), (2, "amazon_in", "default", "referral_percentage", 18.0, "future", day(2026, 12, 1)),
        (3, "amazon_in", "home-organization", "referral_percentage", 12.0, "older but specific", day(2025, 1, 1)), (4, "amazon_in", "default", "fixed_inr", 20.0, "b", day(2026, 1, 1)),
        (5, "amazon_in", "default", "payment_gateway_percentage", 2.0, "gateway", day(2026, 1, 1)), (6, "meesho", "default", "fixed_inr", 9.0, "c", day(2026, 1, 1)),
    ]
    fees = spark.createDataFrame(rows, EMPTY_FEES)
    got = score({"marketplace_fee_override": None, "payment_fee": None}, {"category": "storage-products", "marketplace_fee_override": None}, {"marketplace": "own_store", "marketplace_fee_override": None, "payment_fee": None}, fees=fees)
    assert (got["0"]["marketplace_fee"], got["0"]["payment_fee"]) == (140, 20)
    assert [f["fee_type"] for f in got["0"]["fees"]] == ["fixed_inr", "payment_gateway_percentage", "referral_percentage"]
    assert (got["1"]["marketplace_fee"], got["1"]["payment_fee"]) == (170, 20)
    assert got["2"]["marketplace_fee"] is None and got["2"]["payment_fee"] is None


def test_sub_scores(score):
    got = score({}, {"competitor_count": 10}, {"competitor_count": 210}, {"opportunity_count": 99}, {"pain_rows": None, "opportunity_count": None, "complaint_count": None},
                {"opportunity_count": 0, "complaint_count": 0}, {"weight_kg": 8.0}, {"fragile": True}, {"weight_kg": None}, {"category": "misc"}, {"bundle_potential_score": 140.0},
                {"log_reviews_min": None, "log_reviews_max": None}, {"length_cm": None, "width_cm": None, "height_cm": None})
    assert got["0"]["competition_opportunity"] == 80 and got["1"]["competition_opportunity"] == 100 and got["2"]["competition_opportunity"] == 0
    assert got["0"]["differentiation"] == 40 and got["0"]["customer_pain_opportunity"] == 60 and got["3"]["differentiation"] == 100
    assert got["4"]["differentiation"] is None and got["5"]["differentiation"] == 0
    assert [got[i]["shipping_simplicity"] for i in "0678"] == [100, 30, 75, None]
    assert got["9"]["bundle_expansion"] is None and got["10"]["bundle_expansion"] == 100 and got["0"]["bundle_expansion"] == 75
    assert got["11"]["demand"] == 0.7 * 50 + 0.3 * 80 and got["12"]["shipping_simplicity"] == 100
    assert got["0"]["profitability"] == 58


def test_critical_fields_withhold_the_score(score):
    got = score({}, {"product_cost": None}, {"review_count": None}, {"competitor_count": 0, "product_cost": 0.0}, {"source_url": ""}, {"marketplace": ""}, {"collected_at": None})
    assert got["0"]["score_status"] == "COMPLETE" and got["0"]["final_score"] is not None
    assert got["1"]["missing_critical_fields"] == ["product_cost"] and got["1"]["final_score"] is None and got["1"]["classification"] is None
    assert got["2"]["missing_critical_fields"] == ["demand_signal"] and got["3"]["score_status"] == "COMPLETE"
    assert got["4"]["missing_critical_fields"] == ["source"] and got["5"]["missing_critical_fields"] == ["marketplace"] and got["6"]["missing_critical_fields"] == ["collected_at"]
    assert got["1"]["data_completeness"] == 0.8 and got["1"]["effective_weights"] == {}


def _fixed(spark, changes):
    golden = dict(zip([c for c, _ in COMPONENTS], [80.0, 60.0, 70.0, 50.0, 90.0, 30.0, 65.0]))
    rows = [{**golden, "score_status": "COMPLETE", **c} for c in changes]
    schema = ", ".join(f"{c} double" for c, _ in COMPONENTS) + ", score_status string"
    return scoring.with_final_score(spark.createDataFrame([tuple(r.values()) for r in rows], schema), config.scoring()).collect()


def test_final_score(spark):
    full, partial, withheld = _fixed(spark, [{}, {"bundle_expansion": None}, {"score_status": "INCOMPLETE"}])
    assert full["final_score"] == 67.0 and full["data_completeness"] == 1.0 and abs(sum(full["contributions"].values()) - 67.0) < 0.01
    assert partial["data_completeness"] == 0.9 and "bundleExpansion" not in partial["effective_weights"]
    assert withheld["final_score"] is None and withheld["contributions"] == {}


def test_classes(spark):
    pairs = [(75.0, 30.0), (75.0, 50.0), (55.0, 20.0), (40.0, 20.0), (95.0, 75.0), (None, 10.0)]
    df = spark.createDataFrame(pairs, "final_score double, risk_score double")
    assert [r[2] for r in scoring.with_class(df, config.scoring()).collect()] == ["A", "B", "B", "C", "C", None]


def test_risk(score):
    worst = dict(fragile=True, weight_kg=9.0, selling_price=720.0, competitor_count=210, established_brand_dominance=True, return_risk="high", regulatory_complexity="high", brand_ip_risk=True, seasonal_demand=True)
    got = score({}, worst, {"product_cost": None})
    assert got["0"]["risk_score"] == 0 and got["0"]["risk_reasons"] == []
    assert got["1"]["risk_score"] == 100 and len(got["1"]["risk_reasons"]) == 9 and got["1"]["risk_reasons"][2] == "Low margin (1.39% < 10%)"
    assert got["2"]["risk_score"] == 0 and got["2"]["risk_reasons"] == ["Quality uncertainty: no verified cost data"]


def test_cohorts_below_three_use_all_products(spark):
    rows = [("a", 1, 5), ("a", 99, 7), ("b", 3, None), ("b", 4, 2), ("b", None, 9)]
    df = spark.createDataFrame(rows, "category string, review_count long, competitor_count long").withColumn("dataset_status", F.lit("VERIFIED"))
    got = {r["category"]: r for r in scoring.cohorts(df).collect()}
    assert got["a"]["cohort_size"] == 5 and (got["a"]["competitors_min"], got["a"]["competitors_max"]) == (2, 9)
    assert got["b"]["cohort_label"] == "category:b" and (got["b"]["competitors_min"], got["b"]["competitors_max"]) == (2, 9)
    assert abs(got["b"]["log_reviews_max"] - 1.6094379124341003) < 1e-12


def test_bad_configuration_is_refused():
    cfg = config.scoring()
    with pytest.raises(ValueError):
        config.check_scoring({**cfg, "finalScoreWeights": {**cfg["finalScoreWeights"], "demand": 0.5}})
    with pytest.raises(ValueError):
        config.check_scoring({**cfg, "profitabilityScore": {"marginFloorPct": 5, "marginCeilingPct": 5}})
