"""Schemas of the stored tables."""

from __future__ import annotations

_DIMENSIONS = "struct<length_cm:double,width_cm:double,height_cm:double>"
_ORIGIN = "source_name string, source_url string, collected_at timestamp, confidence_score double"

PRODUCTS = f"""product_id string, name string, normalized_name string, url string, marketplace string, external_id string, brand string,
  category string, subcategory string, description string, features array<string>, variants array<string>, sizes array<string>,
  colors array<string>, image_urls array<string>, weight_kg double, dimensions {_DIMENSIONS}, fragile boolean, return_risk string,
  regulatory_complexity string, brand_ip_risk boolean, seasonal_demand boolean, established_brand_dominance boolean,
  bundle_potential_score double, {_ORIGIN}, dataset_status string, verification_notes array<string>"""
PRICES = f"product_id string, record_no bigint, selling_price double, mrp double, discount_percentage double, currency string, {_ORIGIN}, run_id string"
METRICS = f"""product_id string, record_no bigint, review_count bigint, average_rating double, competitor_count bigint, seller_count bigint,
  best_seller_rank bigint, search_term string, {_ORIGIN}, run_id string"""
COSTS = """product_id string, product_cost double, shipping_cost double, packaging_cost double, marketplace_fee_override double,
  payment_fee double, advertising_cost double, return_allowance double, other_costs double, cost_source_name string, cost_source_url string,
  effective_date date, collected_at timestamp, confidence_score double, run_id string"""
PAIN_POINTS = """product_id string, type string, theme string, detail string, mention_count bigint, source_name string, source_url string,
  confidence_score double, collected_at timestamp"""
LEDGER = """product_id string, record_no bigint, field_name string, raw_value string, numeric_value double, source_name string,
  source_url string, observed_at timestamp, confidence_score double, run_id string"""
REJECTIONS = "record_no bigint, identifier string, code string, errors array<string>"
#: Duplicates, warnings, downgrades and missing critical fields of a run.
FINDINGS = "run_id string, kind string, record_no bigint, identifier string, details array<string>"
REPORTS = "run_id string, measure string, n bigint"
RUNS = """run_id string, data_source_id bigint, status string, created_at timestamp, finished_at timestamp, received bigint, created bigint,
  updated bigint, rejected bigint, duplicates bigint, error string"""
SCORES = """product_id string, selling_price double, final_score double, score_status string, risk_score double, classification string,
  data_completeness double, computed_at timestamp, score_breakdown string"""

#: Where a product is found: live entries of external ids, URLs and names, and entries that were withdrawn.
PRODUCT_KEYS = "slot bigint, marketplace string, kind string, key string, product_id string, sample boolean, live boolean"
#: The newest row of each product's history, and the number of the commit that brought it.
NEWEST_PRICES, NEWEST_METRICS = f"{PRICES}, run_no bigint", f"{METRICS}, run_no bigint"
NEWEST_COSTS = f"{COSTS}, record_no bigint, run_no bigint"
MARKETPLACES = "slug string, marketplace_name string, website_url string"
FEES = "fee_id bigint, marketplace string, category string, fee_type string, fee_value double, source string, effective_date date"
SOURCES = "data_source_id bigint, name string"

TABLES = {
    "products": PRODUCTS, "product_keys": PRODUCT_KEYS, "prices": PRICES, "metrics": METRICS, "costs": COSTS, "newest_prices": NEWEST_PRICES,
    "newest_metrics": NEWEST_METRICS, "newest_costs": NEWEST_COSTS, "pain_points": PAIN_POINTS, "ledger": LEDGER, "rejections": REJECTIONS,
    "findings": FINDINGS, "reports": REPORTS, "runs": RUNS, "scores": SCORES, "marketplaces": MARKETPLACES, "fees": FEES, "sources": SOURCES,
}
#: Key columns of the tables in buckets; the first one decides about the bucket.
KEYS = {name: ["product_id"] for name in ("products", "prices", "metrics", "costs", "newest_prices", "newest_metrics", "newest_costs", "pain_points", "ledger", "scores")}
KEYS["product_keys"] = ["slot", "marketplace", "kind", "key", "product_id"]
#: Tables of which the newest layer's rows of a key are in force; the others are histories.
SNAPSHOTS = ["products", "product_keys", "newest_prices", "newest_metrics", "newest_costs", "pain_points", "scores"]
#: Columns whose files carry a Bloom filter.
LOOKUPS = {"product_keys": ["slot"]}
