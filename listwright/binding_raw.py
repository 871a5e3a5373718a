"""Raw submissions derived from the ``part`` table: every cell a string, as a researcher might type it.

The expressions are plain SQL that Spark and DuckDB read alike; they only make up the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import binding
from listwright.operators.skew import spread

NOW = "2026-10-01 00:00:00"

_TYPE = (
    "CASE p_type WHEN 'ECONOMY' THEN 'Car-Accessories' WHEN 'STANDARD' THEN 'home-organization' WHEN 'PROMO' THEN 'mobile-accessories' "
    "WHEN 'SMALL' THEN 'desk-office-organization' WHEN 'MEDIUM' THEN 'kitchen-organization' ELSE 'storage-products' END"
)
_MARKET = "CASE p_partkey % 4 WHEN 0 THEN 'amazon_in' WHEN 1 THEN 'Flipkart' WHEN 2 THEN 'meesho' ELSE 'own_store' END"
_DATE = (
    "CASE WHEN p_partkey % 37 = 0 THEN 'last week' WHEN p_partkey % 41 = 0 THEN '2027-01-05T00:00:00Z' WHEN p_partkey % 43 = 0 THEN '' "
    "WHEN p_partkey % 2 = 0 THEN '2026-09-' || (10 + p_partkey % 20) || 'T10:00:00+05:30' ELSE '2026-09-' || (10 + p_partkey % 20) END"
)
_PRICE = (
    "CASE WHEN p_partkey % 67 = 0 THEN 'abc' WHEN p_partkey % 61 = 0 THEN '-5' WHEN p_partkey % 59 = 0 THEN 'n/a' "
    "WHEN p_partkey % 4 = 0 THEN '₹1,' || (100 + p_partkey % 900) || '.50' WHEN p_partkey % 4 = 1 THEN 'Rs. ' || (200 + p_partkey % 700) "
    "WHEN p_partkey % 4 = 2 THEN ' ' || (300 + p_partkey % 500) || '.999 ' ELSE (150 + p_partkey % 800) || ' INR' END"
)
_NAME = (
    "CASE WHEN p_partkey % 97 = 0 THEN 'N/A' WHEN p_partkey % 89 = 0 THEN 'ab' "
    "WHEN p_partkey % 2 = 0 THEN upper(p_name) || ', ' || (p_partkey % 5) ELSE '  ' || p_name || '   ' || (p_partkey % 5) || ' !' END"
)
_URL = (
    "CASE WHEN p_partkey % 83 = 0 THEN '' WHEN p_partkey % 79 = 0 THEN 'not a url' WHEN p_partkey % 73 = 0 THEN 'ftp://files.shop.in/x' "
    "WHEN p_partkey % 71 = 0 THEN 'https://example.com/demo/' || p_partkey "
    "ELSE 'https://www.Shop' || (p_partkey % 7) || '.in:443/dp/' || (p_partkey - p_partkey % 3) || '/?ref=' || p_partkey END"
)
_SOURCE = (
    "CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'seed_demo_data' WHEN 2 THEN 'demo_source_2' WHEN 3 THEN 'keepa' "
    "WHEN 4 THEN 'Sample-Research' ELSE 'Field Notes' END"
)
_FLAG = "CASE (p_partkey + {n}) % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN '1' WHEN 3 THEN 'FALSE' WHEN 4 THEN 'maybe' ELSE '' END"
_RISK = "CASE (p_partkey + {n}) % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'Low' WHEN 2 THEN 'medium' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'extreme' ELSE '-' END"
_COMPLAINTS = "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'lids leak:' || (p_partkey % 90) || '| weak hinge |' ELSE 'odd:x:9||too small' END"
_POSITIVES = "CASE WHEN p_partkey % 5 = 0 THEN 'good value:' || (p_partkey % 40) ELSE 'none' END"
_OPPORTUNITIES = "CASE WHEN p_partkey % 2 = 0 THEN 'use thicker board|add size chart:2.6' ELSE NULL END"
_EXTERNAL = "CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE 'X' || (p_partkey - p_partkey % 8) END"
_REVIEWS = "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 47 = 0 THEN '-3' WHEN p_partkey % 2 = 0 THEN '1,' || (100 + p_partkey % 900) ELSE (p_partkey % 900) || '.5' END"
_RATING = "CASE WHEN p_partkey % 12 = 0 THEN 'unknown' WHEN p_partkey % 53 = 0 THEN '7.5' ELSE '4.' || (p_partkey % 10) || ' out of 5' END"
_MRP = "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE (500 + p_partkey % 1500) || '' END"
_COST = "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE (50 + p_partkey % 300) || '.25' END"
_CONFIDENCE = "CASE WHEN p_partkey % 57 = 0 THEN '1.5' WHEN p_partkey % 9 = 0 THEN '' ELSE '0.' || (p_partkey % 10) END"
_STATUS = "CASE p_partkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'SAMPLE' WHEN 2 THEN 'PROVISIONAL' WHEN 3 THEN 'Verified' ELSE '' END"
_WEIGHT = "CASE WHEN p_size % 6 = 0 THEN '' WHEN p_partkey % 49 = 0 THEN '0' ELSE '0.' || p_size || ' kg' END"

LISTING = {
    "name": _NAME, "url": _URL, "marketplace": f"CASE WHEN p_partkey % 77 = 0 THEN 'ebay' ELSE {_MARKET} END", "external_id": _EXTERNAL,
    "brand": "CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand END",
    "category": f"CASE WHEN p_size % 25 = 0 THEN 'toys' WHEN p_size % 27 = 0 THEN '' ELSE {_TYPE} END",
    "features": "CASE WHEN p_partkey % 4 = 0 THEN 'black|blue| red |' END", "weight_kg": _WEIGHT, "length_cm": "'30'",
    "width_cm": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '12.5cm' END", "height_cm": "p_size || ''", "selling_price": _PRICE, "mrp": _MRP,
    "currency": "CASE WHEN p_partkey % 31 = 0 THEN 'usd' WHEN p_partkey % 3 = 0 THEN '' ELSE 'inr' END", "review_count": _REVIEWS,
    "average_rating": _RATING, "competitor_count": "CASE WHEN p_partkey % 10 = 0 THEN 'none' ELSE (p_partkey % 200) || '' END",
    "seller_count": "(p_partkey % 9) || ''", "best_seller_rank": "'#' || p_partkey", "product_cost": _COST,
    "shipping_cost": "CASE WHEN p_partkey % 14 = 0 THEN '' ELSE '₹ 45' END", "cost_source": "CASE WHEN p_partkey % 4 = 0 THEN 'Quote desk' END",
    "cost_source_url": "CASE WHEN p_partkey % 8 = 4 THEN 'https://demo-store.in/q' WHEN p_partkey % 8 = 0 THEN 'https://quotes.in/q' END",
    "fragile": _FLAG.format(n=0), "return_risk": _RISK.format(n=1), "regulatory_complexity": _RISK.format(n=2), "brand_ip_risk": _FLAG.format(n=3),
    "complaints": _COMPLAINTS, "positives": _POSITIVES, "opportunities": _OPPORTUNITIES,
    "source_url": "CASE WHEN p_partkey % 29 = 0 THEN 'https://acme.com/x' WHEN p_partkey % 23 = 0 THEN '' ELSE 'https://notes.in/n/' || p_partkey END",
    "collected_at": _DATE, "confidence_score": _CONFIDENCE, "source_name": _SOURCE, "dataset_status": _STATUS,
    "is_sample_data": "CASE WHEN p_partkey % 6 = 2 THEN 'true' ELSE 'false' END",
}
RESEARCH = {
    "product_name": _NAME, "product_url": _URL, "product_id": _EXTERNAL,
    "marketplace": f"CASE WHEN p_partkey % 77 = 0 THEN 'ebay' WHEN p_partkey % 33 = 0 THEN '' ELSE {_MARKET} END",
    "source": "CASE WHEN p_partkey % 66 = 0 THEN 'meesho' END", "observed_price": _PRICE, "observed_at": _DATE,
    "source_url": LISTING["source_url"], "source_name": "CASE WHEN p_partkey % 16 = 5 THEN 'demo_data' WHEN p_partkey % 16 = 6 THEN 'tbd' WHEN p_partkey % 16 = 7 THEN '' WHEN p_partkey % 16 = 8 THEN 'keepa' ELSE 'Field Notes' END",
    "category": LISTING["category"], "brand": LISTING["brand"], "rating": _RATING, "review_count": _REVIEWS, "demand_signal": "(p_partkey % 500) || ''",
    "competition_signal": LISTING["competitor_count"], "supplier_cost": _COST, "shipping_cost": LISTING["shipping_cost"],
    "cost_source_name": LISTING["cost_source"], "cost_source_url": LISTING["cost_source_url"], "product_weight": _WEIGHT,
    "product_dimensions": "CASE p_partkey % 4 WHEN 0 THEN '30 x 20 X ' || p_size || ' cm' WHEN 1 THEN '30×' || p_size WHEN 2 THEN '300mm*20*5' ELSE '' END",
    "mrp": _MRP, "currency": LISTING["currency"], "confidence_score": _CONFIDENCE, "fragile": LISTING["fragile"],
    "complaints": _COMPLAINTS, "positives": _POSITIVES, "opportunities": _OPPORTUNITIES,
    "dataset_status": "CASE WHEN p_partkey % 18 = 4 THEN 'sample' WHEN p_partkey % 5 = 0 THEN 'verified' ELSE '' END",
    "verification_requested": _FLAG.format(n=4),
}
#: Products on file before the import: every part, one of seven under the keys its rows carry, the others under keys no row has.
STORED = {
    "product_id": "'S' || p_partkey", "marketplace": f"lower({_MARKET})",
    "external_id": "CASE WHEN p_partkey % 4 < 2 THEN 'X' || (p_partkey - p_partkey % 8) || CASE WHEN p_partkey % 8 = 4 THEN 'b' ELSE '' END || CASE WHEN p_partkey % 7 = 3 THEN '' ELSE 'z' END END",
    "url": "'https://shop' || (p_partkey % 7) || '.in/dp/' || (p_partkey - p_partkey % 3) || CASE WHEN p_partkey % 7 <> 3 THEN '/off/' || p_partkey WHEN p_partkey % 10 = 0 THEN '' ELSE '/old' END",
    "normalized_name": "lower(p_name) || ' ' || (p_partkey % 5) || CASE WHEN p_partkey % 7 = 3 THEN '' ELSE ' off list' END",
    "dataset_status": "CASE p_partkey % 3 WHEN 0 THEN 'SAMPLE' WHEN 1 THEN 'UNVERIFIED' ELSE 'VERIFIED' END",
    "name": "p_name", "brand": "p_brand", "source_name": "'Field Notes'",
}


def raw(spark: SparkSession, sf_dir: str, cells: dict[str, str]) -> DataFrame:
    part = spread(binding.table(spark, sf_dir, "part"))
    return part.select(F.col("p_partkey").alias("record_no"), *[F.expr(e).cast("string").alias(c) for c, e in cells.items()])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(binding.table(spark, sf_dir, "part")).select(*[F.expr(e).alias(c) for c, e in STORED.items()])


def sql(cells: dict[str, str]) -> str:
    return "SELECT p_partkey AS record_no, " + ", ".join(f"CAST({e} AS VARCHAR) AS {c}" for c, e in cells.items()) + " FROM part"


def stored_sql() -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in STORED.items()) + " FROM part"
