"""Validation and verification: every rejection and downgrade carries its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed import AUTOMATED_SOURCE_NAMES, DATASET_STATUSES, SEED_SOURCE_NAMES
from listwright.functions.numbers import text
from listwright.functions.text import trimmed
from listwright.functions.urls import is_http_url, is_non_attributable, is_placeholder_url, parsed, placeholder_reasons


def _listed(*conditions: tuple[Column, Column | str]) -> Column:
    items = [F.when(F.coalesce(when, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for when, m in conditions]
    return F.filter(F.array(*items), lambda m: m.isNotNull())


def _said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _with_url_reasons(df: DataFrame) -> DataFrame:
    """``url_reasons`` and ``source_reasons``, each URL taken apart once."""
    apart = df.withColumns({"_u": parsed(F.col("url")), "_s": parsed(F.col("source_url"))})
    return apart.withColumns({
        "url_reasons": placeholder_reasons(F.col("url"), F.col("_u")), "source_reasons": placeholder_reasons(F.col("source_url"), F.col("_s")),
    }).drop("_u", "_s")


def _no_cost() -> Column:
    return F.col("costs.product_cost").isNull()


def _no_demand() -> Column:
    return F.col("review_count").isNull() | F.col("average_rating").isNull()


def _future(now: Column) -> Column:
    return F.col("collected_at") > now + F.expr("INTERVAL 24 HOURS")


def _outside(c: str, high: float) -> Column:
    return (F.col(c) < 0) | (F.col(c) > high)


def check_listings(listings: DataFrame, categories: list[str], now: Column) -> DataFrame:
    """Adds ``errors`` (all of them) and ``warnings``; a row is valid without errors."""
    c = F.col
    untraced = F.filter("pain_points", lambda p: ~is_http_url(p["source_url"]))
    errors = _listed(
        (F.coalesce(F.length(F.trim("name")), F.lit(0)) < 3, "name is required (min 3 characters)"),
        (~is_http_url(c("url")), _said("url is not a valid http(s) URL: '", F.coalesce(c("url"), F.lit("null")), "'")),
        (F.coalesce(c("marketplace"), F.lit("")) == "", "marketplace is required"),
        (F.coalesce(c("category"), F.lit("")) == "", "category is required"),
        ((c("category") != "") & ~c("category").isin(categories), _said("category '", c("category"), "' is not in config/categories.json — add it there first")),
        (c("selling_price").isNull(), "selling_price must be numeric"),
        (c("selling_price") <= 0, "selling_price must be greater than zero"),
        (c("currency") != "INR", _said("currency must be INR for this system, got '", c("currency"), "'")),
        (~is_http_url(c("source_url")), "source_url is required and must be a valid http(s) URL"),
        (F.coalesce(F.trim("source_name"), F.lit("")) == "", "source_name is required — every externally sourced value must name its source"),
        (~c("dataset_status").isin(DATASET_STATUSES), f"dataset_status must be one of {', '.join(DATASET_STATUSES)}"),
        (c("collected_at").isNull(), "collected_at is required and must be a valid timestamp"),
        (_future(now), "collected_at is in the future"),
        (_outside("average_rating", 5), _said("average_rating must be between 0 and 5, got ", text(c("average_rating")))),
        (c("review_count") < 0, "review_count cannot be negative"),
        (c("weight_kg") <= 0, "weight_kg must be greater than zero when supplied"),
        (_outside("confidence_score", 1), "confidence_score must be between 0 and 1"),
        (F.size(untraced) > 0, _said("pain point '", F.get(untraced, F.lit(0))["theme"], "' has no valid source URL — review observations must be traceable")),
    )
    warnings = _listed(
        (c("selling_price") > c("mrp"), _said("selling_price (", text(c("selling_price")), ") exceeds MRP (", text(c("mrp")), ") — verify the listing")),
        (_no_cost(), "No supplier/product cost supplied — profitability will be reported as unavailable"),
        (_no_demand(), "Missing review count or rating — demand score will be reported as unavailable"),
        (c("competitor_count").isNull(), "No competing-listing count — competition score and Final Score will be withheld"),
        ((c("dataset_status") == "VERIFIED") & (c("confidence_score") < 0.8), _said("Marked VERIFIED but confidence is only ", text(c("confidence_score")), " — confirm this is intentional")),
    )
    return listings.withColumns({"errors": errors, "warnings": warnings})


def check_research(records: DataFrame, categories: list[str], now: Column) -> DataFrame:
    """Adds ``code`` and ``errors`` of the first failing rule group (NULL when accepted) and ``warnings``."""
    c = F.col
    records = _with_url_reasons(records)
    low_source = F.lower(trimmed(c("source_name")))
    missing = _listed(*[
        (absent, f"{field} is required for a real record")
        for field, absent in [
            ("product_name", c("name") == ""), ("marketplace", c("marketplace") == ""), ("product_url", c("url") == ""),
            ("observed_price", c("selling_price").isNull()), ("observed_at", c("collected_at").isNull()),
            ("source_url", c("source_url") == ""), ("source_name", c("source_name") == ""),
        ]
    ])
    stand_in = lambda label, reasons: (F.size(reasons) > 0, _said(f"{label} is a placeholder/example URL: ", F.array_join(reasons, "; ")))
    untraced = F.filter("pain_points", lambda p: is_placeholder_url(p["source_url"]))
    invalid = _listed(
        (c("selling_price") <= 0, _said("observed_price must be greater than zero, got ", text(c("selling_price")))),
        (c("currency") != "INR", _said("currency must be INR for this system, got '", c("currency"), "'")),
        (_future(now), "observed_at is in the future"),
        (_outside("average_rating", 5), _said("rating must be between 0 and 5, got ", text(c("average_rating")))),
        (c("review_count") < 0, "review_count cannot be negative"),
        (c("weight_kg") <= 0, "product_weight must be greater than zero when supplied"),
        (_outside("confidence_score", 1), "confidence_score must be between 0 and 1"),
        (F.size(untraced) > 0, _said("review observation '", F.get(untraced, F.lit(0))["theme"], "' has no traceable source URL")),
    )
    groups = [
        ("SEED_DATA_SOURCE", _listed((low_source.isin(SEED_SOURCE_NAMES), _said("source_name '", c("source_name"), "' identifies seed/demo data, which cannot be imported as real data")))),
        ("SAMPLE_STATUS_NOT_ALLOWED", _listed((c("declared_status") == "SAMPLE", "dataset_status SAMPLE is reserved for seed data and cannot be submitted through the real-data pipeline"))),
        ("MISSING_REQUIRED_FIELD", missing),
        ("PLACEHOLDER_URL", _listed(stand_in("product_url", "url_reasons"), stand_in("source_url", "source_reasons"))),
        ("SEED_DATA_SOURCE", _listed((is_non_attributable(c("source_name")), _said("source_name '", c("source_name"), "' does not attribute the record to a real, traceable origin")))),
        ("INVALID_VALUE", invalid),
        ("UNKNOWN_CATEGORY", _listed(
            (c("category") == "", "category is required so the product can be scored against a peer cohort"),
            ((c("category") != "") & ~c("category").isin(categories), _said("category '", c("category"), "' is not in config/categories.json — add it there first")),
        )),
    ]
    df = records.withColumn("_groups", F.array(*[F.struct(F.lit(code).alias("code"), errors.alias("errors")) for code, errors in groups]))
    df = df.withColumn("_first", F.get(F.filter("_groups", lambda g: F.size(g["errors"]) > 0), F.lit(0)))
    warnings = _listed(
        (_no_cost(), "No supplier_cost supplied — profitability and the Final Score will be withheld"),
        (_no_demand(), "Missing rating or review_count — demand signal incomplete, Final Score will be withheld"),
        (c("competitor_count").isNull(), "No competition_signal supplied — Final Score will be withheld"),
        (c("selling_price") > c("mrp"), _said("observed_price (", text(c("selling_price")), ") exceeds MRP (", text(c("mrp")), ") — verify the listing")),
        (c("verification_requested"), "VERIFIED was requested; it is granted only if the record passes the verification gate"),
        (c("unit_not_converted"), "product_dimensions names a unit other than cm; the numbers are taken as centimetres"),
    )
    return df.withColumns({"code": c("_first.code"), "errors": c("_first.errors"), "warnings": warnings}).drop("_groups", "_first", "url_reasons", "source_reasons")


def unknown_marketplace(rows: DataFrame, marketplaces: DataFrame) -> DataFrame:
    """Adds ``known_marketplace``; the dimension is counted before it is broadcast."""
    known = marketplaces.select(F.col("slug").alias("marketplace")).distinct().withColumn("known_marketplace", F.lit(True))
    return rows.join(known, "marketplace", "left").withColumn("known_marketplace", F.coalesce("known_marketplace", F.lit(False)))


def unknown_marketplace_error() -> Column:
    return _said("unknown marketplace '", F.col("marketplace"), "' — add it to the marketplaces table first")


def gate(listings: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Settles ``dataset_status``: VERIFIED survives only where the record can be re-checked.

    Adds ``verification_notes`` (the reasons, NULL when none) and ``downgraded``.
    """
    c = F.col
    claim = claimed if claimed is not None else c("dataset_status")
    concrete = F.coalesce("brand", "description").isNotNull() | c("weight_kg").isNotNull() | c("dimensions").isNotNull() | (F.coalesce(F.size("features"), F.lit(0)) > 0)
    listings = _with_url_reasons(listings)
    source_reasons, url_reasons = c("source_reasons"), c("url_reasons")
    costed = c("costs.product_cost").isNotNull()
    reasons = _listed(
        (
            F.lower(trimmed(c("source_name"))).isin(AUTOMATED_SOURCE_NAMES),
            _said("source '", c("source_name"), "' is an automated collector — data arriving from it is not human-verified. VERIFIED requires a person to confirm the listing and a supplier quote."),
        ),
        (F.size(source_reasons) > 0, _said("source_url is not a real traceable URL: ", F.array_join(source_reasons, "; "))),
        (F.size(url_reasons) > 0, _said("product url is not a real traceable URL: ", F.array_join(url_reasons, "; "))),
        (
            is_non_attributable(c("source_name")),
            _said("source_name '", c("source_name"), "' does not attribute the record to a real, traceable origin (an adapter name or a demo/sample placeholder is not an attribution)"),
        ),
        (c("collected_at").isNull(), "collected_at is missing or unparseable"),
        (~concrete, "no actual product information on record (needs at least one of: brand, description, weight, dimensions, features)"),
        (c("selling_price").isNull() | (c("selling_price") <= 0), "no actual observed selling price"),
        (
            costed & is_non_attributable(c("costs.cost_source_name")),
            _said("a product cost is claimed but its cost_source '", c("costs.cost_source_name"), "' is not a real attributable supplier/quote"),
        ),
        (costed & (c("costs.cost_source_url") != "") & is_placeholder_url(c("costs.cost_source_url")), "cost_source_url is a placeholder URL"),
        (_no_demand(), "demand metrics (review count and average rating) are not both present"),
        (c("competitor_count").isNull(), "competition metric (count of comparable listings) is missing"),
    )
    df = listings.withColumn("_claim", claim).withColumn("_reasons", F.when(F.col("_claim") == "VERIFIED", reasons))
    refused = F.coalesce(F.size("_reasons") > 0, F.lit(False))
    status = F.when(F.col("_claim") == "SAMPLE", "SAMPLE").when((F.col("_claim") == "VERIFIED") & ~refused, "VERIFIED").otherwise("UNVERIFIED")
    return df.withColumns({
        "dataset_status": status, "downgraded": refused, "verification_notes": F.when(refused, F.col("_reasons")),
    }).drop("_claim", "_reasons", "url_reasons", "source_reasons")


def missing_for_score() -> Column:
    """Names, for the import report, of the critical inputs an accepted record lacks."""
    return _listed((_no_cost(), "supplier_cost"), (_no_demand(), "demand_signal (rating + review_count)"), (F.col("competitor_count").isNull(), "competition_signal"))
