"""A tracker dump through mapping, validation, the verification gate and economics, without writing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import config
from listwright.operators import tracker, validate
from listwright.operators.economics import with_economics, with_fees


def check(products: DataFrame, category: str, collected_at: Column, fees: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per product object: usable or not, validation code, what VERIFIED would get, profit if known."""
    mapped = tracker.map_dump(products, category, collected_at)
    judged = validate.check_research(tracker.as_research(mapped), config.category_slugs(), collected_at)
    gated = validate.gate(judged, F.lit("VERIFIED")).select("record_no", "code", "dataset_status", "downgraded", "verification_notes", "marketplace", "category", "selling_price", "costs")
    costs = gated.select("*", *[F.col(f"costs.{c}").alias(c) for c in ("product_cost", "shipping_cost", "packaging_cost", "marketplace_fee_override", "payment_fee", "advertising_cost", "return_allowance", "other_costs")])
    money = with_economics(with_fees(costs, fees, as_of)).select(
        "record_no", "code", F.col("dataset_status").alias("if_verified_requested"), "downgraded", "verification_notes", "is_reliable",
        F.when(F.col("is_reliable"), F.col("profit")).alias("profit"),
    )
    seen = lambda origin: F.size(F.filter("fields", lambda f: (f["origin"] == origin) & f["value"].isNotNull())).cast("long")
    return mapped.select(
        "record_no", "external_id", (F.size("unusable_reasons") == 0).alias("usable"), "unusable_reasons",
        seen("OBSERVED").alias("observed_fields"), seen("CALCULATED").alias("calculated_fields"), "notes",
    ).join(money, "record_no", "left")
