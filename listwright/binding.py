"""The driver's TPC-H-like tables read as catalog tables.

A part is a product, a line item is a price, metrics and cost observation of its part, and groups
of line items are pain points. Only whole-table expressions on keys, no subsets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import config
from listwright.functions.numbers import half_up
from listwright.plans.rescore import Catalog

AS_OF = dt.date(2026, 6, 30)

EXTRA_FEES = [
    ("amazon_in", "default", "referral_percentage", 18.0, "next rate card", "2026-12-01"),
    ("amazon_in", "car-accessories", "referral_percentage", 12.0, "category rate card", "2025-06-01"),
    ("amazon_in", "car-accessories", "referral_percentage", 11.0, "category rate card", "2024-06-01"),
    ("flipkart", "default", "commission_percentage", 16.5, "mid-year rate card", "2026-03-01"),
    ("flipkart", "storage-products", "fixed_inr", 12.35, "handling", "2026-02-01"),
    ("meesho", "misc", "payment_gateway_percentage", 1.75, "gateway", "2026-02-01"),
]

CATEGORY = """
  CASE WHEN p_size % 10 = 0 THEN 'misc'
       WHEN p_type = 'ECONOMY' THEN 'car-accessories'
       WHEN p_type = 'STANDARD' THEN 'home-organization'
       WHEN p_type = 'PROMO' THEN 'mobile-accessories'
       WHEN p_type = 'SMALL' THEN 'desk-office-organization'
       WHEN p_type = 'MEDIUM' THEN 'kitchen-organization'
       ELSE 'storage-products' END"""
MARKETPLACE = "CASE p_partkey % 4 WHEN 0 THEN 'amazon_in' WHEN 1 THEN 'flipkart' WHEN 2 THEN 'meesho' ELSE 'own_store' END"
SOURCE = """
  CASE p_partkey % 6 WHEN 0 THEN 'field notes' WHEN 1 THEN 'seed_demo_data' WHEN 2 THEN 'supplier visit'
       WHEN 3 THEN 'keepa' WHEN 4 THEN 'sample-research' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "product_id": "concat('P', p_partkey)",
        "name": "concat(p_name, ' ', p_partkey)",
        "brand": "p_brand",
        "url": "concat('https://shop', p_partkey % 7, '.in/dp/', p_partkey)",
        "marketplace": MARKETPLACE,
        "external_id": "CASE WHEN p_partkey % 5 <> 0 THEN concat('X', p_partkey) END",
        "category": CATEGORY,
        "weight_kg": "CASE WHEN p_partkey % 17 <> 0 THEN p_size / 10.0D END",
        "length_cm": "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END",
        "width_cm": "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 40 + 1 AS DOUBLE) END",
        "height_cm": "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 25 + 1 AS DOUBLE) END",
        "fragile": "CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 8 = 1 END",
        "return_risk": "CASE p_partkey % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' END",
        "regulatory_complexity": "CASE p_partkey % 6 WHEN 1 THEN 'none' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' END",
        "brand_ip_risk": "CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 10 = 3 END",
        "seasonal_demand": "CASE WHEN p_partkey % 12 <> 0 THEN p_partkey % 12 = 5 END",
        "established_brand_dominance": "CASE WHEN p_partkey % 14 <> 0 THEN p_partkey % 7 = 2 END",
        "bundle_potential_score": "CASE WHEN p_partkey % 15 = 0 THEN CAST(p_partkey % 120 AS DOUBLE) END",
        "data_source_id": "p_partkey % 4",
        "source_name": SOURCE,
        "source_url": "CASE WHEN p_partkey % 19 <> 0 THEN concat('https://', CASE WHEN p_partkey % 6 = 1 THEN 'example.com' ELSE 'supplier.in' END, '/q/', p_partkey) END",
        "collected_at": "CASE WHEN p_partkey % 23 <> 0 THEN timestamp_micros(1704067200000000 + p_partkey * 60000000) END",
        "confidence_score": "(p_partkey % 11) / 10.0D",
        "dataset_status": "CASE p_partkey % 3 WHEN 0 THEN 'SAMPLE' WHEN 1 THEN 'UNVERIFIED' ELSE 'VERIFIED' END",
        "verification_notes": "CASE WHEN p_partkey % 21 = 1 THEN array('claim refused') END",
    }
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations; (collected_at, row_id) is a total order within a product."""
    price = half_up(F.col("l_extendedprice") / F.col("l_quantity"))
    base = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("product_id"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("row_id"),
        F.col("l_shipdate").cast("timestamp").alias("collected_at"),
        price.alias("selling_price"),
        F.when(F.col("l_orderkey") % 10 != 0, half_up(price * (1 + F.col("l_discount")))).alias("mrp"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
    )
    return base.withColumns({
        "source_name": F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'field notes' WHEN 1 THEN 'price desk' ELSE 'supplier visit' END"),
        "source_url": F.expr("concat('https://supplier.in/o/', l_orderkey)"),
        "confidence_score": F.expr("(l_orderkey % 11) / 10.0D"),
    })


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumns({
        "review_count": F.expr("CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_quantity AS BIGINT) * 37 + l_orderkey % 1000 END"),
        "average_rating": F.when(F.expr("l_orderkey % 29 <> 0"), half_up(5.0 - 10.0 * F.col("l_discount"))),
        "competitor_count": F.expr("CASE WHEN l_orderkey % 13 <> 0 THEN l_suppkey END"),
        "seller_count": F.col("l_linenumber").cast("long"),
        "best_seller_rank": F.col("l_orderkey"),
    })


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda e: F.expr(e).cast("double")
    return observations(spark, sf_dir).withColumns({
        "product_cost": F.when(F.expr("l_partkey % 7 <> 0"), half_up(F.col("selling_price") * 0.4)),
        "shipping_cost": number("CASE WHEN l_partkey % 9 <> 4 THEN 30 + l_partkey % 50 END"),
        "packaging_cost": number("l_partkey % 20"),
        "marketplace_fee_override": F.expr("CASE WHEN l_partkey % 21 = 0 THEN 55.5D END"),
        "payment_fee": number("CASE WHEN l_partkey % 22 = 0 THEN 12 END"),
        "advertising_cost": F.expr("(l_partkey % 13) * 2.25D"),
        "return_allowance": number("CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 30 END"),
        "other_costs": F.expr("CASE WHEN l_partkey % 4 <> 0 THEN (l_partkey % 6) * 1.125D END"),
    })


def pain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(
        "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber"
    ).agg(F.count(F.lit(1)).alias("mention_count"))
    return grouped.select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("product_id"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'complaint' WHEN 'A' THEN 'positive' ELSE 'opportunity' END").alias("type"),
        F.expr("concat(l_returnflag, l_linestatus, l_linenumber)").alias("theme"),
        "mention_count",
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'field notes' ELSE 'review desk' END").alias("source_name"),
        F.expr("concat('https://reviews.in/', l_partkey)").alias("source_url"),
        F.expr("timestamp_micros(1704067200000000 + l_partkey * 1000000)").alias("collected_at"),
        F.expr("CAST(NULL AS DOUBLE)").alias("confidence_score"),
    )


def sources(spark: SparkSession) -> DataFrame:
    rows = [(0, "manual_csv"), (1, "real_data_import"), (2, "tracker")]
    return config.literal_table(spark, rows, ["data_source_id", "name"]).withColumn("data_source_id", F.col("data_source_id").cast("long"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(
        products=products(spark, sf_dir), prices=prices(spark, sf_dir), metrics=metrics(spark, sf_dir),
        costs=costs(spark, sf_dir), pain_points=pain_points(spark, sf_dir), fees=config.fees(spark, EXTRA_FEES),
        marketplaces=config.marketplaces(spark), sources=sources(spark),
    )
