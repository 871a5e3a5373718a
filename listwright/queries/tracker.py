"""Price-tracker jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import binding, binding_tracker, config
from listwright.functions.text import iso
from listwright.operators import resolve, tracker
from listwright.plans import tracker_check as plan
from listwright.session import scratch_path
from listwright.sources.tracker import read_dump


def _complete(df: DataFrame) -> DataFrame:
    """Statistics the made-up objects leave out, as the scan would give them."""
    return df.withColumn("stats", F.col("stats").withField("salesRankDrops90", F.lit(None).cast("long")))


def _products(spark: SparkSession, sf: str) -> DataFrame:
    return _complete(binding_tracker.products(spark, sf))


def _at():
    return F.to_timestamp(F.lit(binding_tracker.AT))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return tracker.map_dump(_products(spark, sf), binding_tracker.CATEGORY, _at())


def tracker_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracker.history(_products(spark, sf).withColumn("asin", F.col("record_no").cast("string")))
    return rows.select("asin", "series", "position", iso(F.col("at")).alias("at"), "value")


def tracker_price_and_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracker.price_and_rank_series(_products(spark, sf).withColumn("asin", F.col("record_no").cast("string")))
    return rows.groupBy("asin", "series").agg(
        F.count(F.lit(1)).alias("points"), iso(F.min("at")).alias("first_at"), iso(F.max("at")).alias("last_at"), F.max_by("value", "position").alias("last_value")
    )


def tracker_dump_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The objects written as response envelopes and scanned again."""
    path = scratch_path(spark, "dump")
    objects = binding_tracker.products(spark, sf).withColumn("domainId", F.col("record_no").cast("int"))
    objects = objects.repartitionByRange(4, "domainId").sortWithinPartitions("domainId")
    objects.select(F.lit(1).alias("tokensLeft"), F.array(F.struct("*")).alias("products")).write.json(path)
    rows = read_dump(spark, path, multi_line=False)
    return rows.select(
        F.col("domainId").cast("long").alias("part"), "record_no", "position", "asin", "title", F.size("csv").cast("long").alias("series"), F.col("stats.buyBoxPrice").alias("buy_box"),
        F.col("stats.buyBoxIsFBA").alias("is_fba"), F.coalesce(F.size("images"), F.lit(-1)).cast("long").alias("images"), "packageLength",
    )


def tracker_listings(spark: SparkSession, sf: str) -> DataFrame:
    df = _mapped(spark, sf)
    return df.select(
        "record_no", "name", "url", "external_id", "brand", "subcategory", F.array_join("image_urls", "|").alias("image_urls"), F.array_join("sizes", "|").alias("sizes"),
        F.array_join("colors", "|").alias("colors"), F.array_join("variants", "|").alias("variants"), F.array_join("features", "|").alias("features"), "weight_kg",
        F.col("dimensions.length_cm").alias("length_cm"), F.col("dimensions.height_cm").alias("height_cm"), "selling_price", "mrp", "discount_percentage",
        "review_count", "average_rating", "competitor_count", "best_seller_rank", "source_url", F.size("notes").cast("long").alias("notes"),
    )


def tracker_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracker.field_rows(_mapped(spark, sf)).where("value IS NOT NULL")
    return rows.select("record_no", "field", "value", "numeric_value", "origin")


def tracker_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracker.as_research(_mapped(spark, sf)).withColumn("product_id", F.col("external_id"))
    return resolve.ledger_rows(rows, F.lit("pull-1")).groupBy("field_name").agg(F.count(F.lit(1)).alias("rows"), F.count("numeric_value").alias("numbers"))


def tracker_usable(spark: SparkSession, sf: str) -> DataFrame:
    return tracker.rejected(_mapped(spark, sf)).withColumn("errors", F.array_join("errors", "; "))


def tracker_check(spark: SparkSession, sf: str) -> DataFrame:
    df = plan.check(_products(spark, sf), binding_tracker.CATEGORY, _at(), config.fees(spark, binding.EXTRA_FEES), binding.AS_OF)
    return df.select(
        "record_no", "usable", "calculated_fields", "code", "if_verified_requested", "downgraded", F.size("verification_notes").cast("long").alias("refusals"), "is_reliable", "profit"
    )


QUERIES = {
    f.__name__: f
    for f in [
        tracker_history, tracker_price_and_rank, tracker_dump_scan, tracker_listings, tracker_fields, tracker_ledger, tracker_usable, tracker_check,
    ]
}
