"""Raw submitted rows -> canonical listings, with malformed rows set apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed import DATASET_STATUSES, LISTING_FIELDS, NUMERIC_FIELDS, OPTIONAL_FIELDS, PAIN_TYPES, REQUIRED_FIELDS, UNLISTED_FIELDS
from listwright.functions import text as t
from listwright.functions.numbers import discount_pct
from listwright.functions.urls import canonical_url, parsed

PAIN_TYPE = "array<struct<type:string,theme:string,detail:string,mention_count:bigint,source_name:string,source_url:string,confidence_score:double>>"


def with_fields(raw: DataFrame, fields: list[str]) -> DataFrame:
    """Headers lower-cased and trimmed, unknown columns left alone, absent ones added as NULL."""
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return named.withColumns({f: F.lit(None).cast("string") for f in fields if f not in named.columns})


_NUMBERS = [
    "selling_price", "mrp", "weight_kg", "length_cm", "width_cm", "height_cm", "review_count", "average_rating", "competitor_count",
    "product_cost", "marketplace_fee_override", "bundle_potential_score", *NUMERIC_FIELDS,
]


def cleaned(raw: DataFrame, fields: list[str], urls: list[str]) -> DataFrame:
    """Two narrow projections before the wide one: cells cleaned, then numbers and URLs read once each.

    ``raw_price`` keeps the text a message may quote.
    """
    df = with_fields(raw, fields)
    rest = [F.col(c) for c in df.columns if c not in fields]
    price = F.coalesce(F.col("selling_price"), F.lit("")).alias("raw_price") if "selling_price" in fields else F.lit(None).alias("raw_price")
    cells = df.select(*rest, price, *[t.cell(F.col(f)).alias(f) for f in fields])
    read = {f"n_{f}": t.numeric_prefix(F.col(f), True) for f in dict.fromkeys(_NUMBERS) if f in fields}
    return cells.withColumns({**read, **{f"u_{f}": parsed(F.col(f)) for f in urls}})


def _n(field: str) -> Column:
    return t.finite(F.col(f"n_{field}"))


def _whole(field: str) -> Column:
    return F.floor(_n(field) + 0.5).cast("long")


def pain_points(cells: dict[str, Column], source_name: Column, source_url: Column, confidence: Column) -> Column:
    """'theme:count|theme' cells, one per kind, as one array in the order of the kinds."""

    def one(kind: str) -> Column:
        def entry(item: Column) -> Column:
            parts = F.split(item, ":")
            return F.struct(
                F.lit(kind).alias("type"), t.trimmed(F.get(parts, F.lit(0))).alias("theme"), F.lit(None).cast("string").alias("detail"),
                t.integer(F.get(parts, F.lit(1))).alias("mention_count"),
                source_name.alias("source_name"), source_url.alias("source_url"), confidence.alias("confidence_score"),
            )

        return F.coalesce(F.transform(t.pipe_list(cells[kind], True), entry).cast(PAIN_TYPE), F.array().cast(PAIN_TYPE))

    return F.concat(*[one(kind) for kind in PAIN_TYPES])


def _cost_struct(cells: dict[str, str], source_name: Column, source_url: Column) -> Column:
    amounts = {name: _n(field) for name, field in cells.items()}
    some = reduce(lambda a, b: a | b, [a.isNotNull() for a in amounts.values()])
    return F.when(some, F.struct(*[a.alias(n) for n, a in amounts.items()], source_name.alias("cost_source_name"), source_url.alias("cost_source_url")))


def _shared(c, sub: dict[str, Column]) -> dict[str, Column]:
    """Columns both submission formats spell alike."""
    return {
        "subcategory": c("subcategory"), "description": c("description"),
        **{f: t.pipe_list(c(f), True) for f in ("features", "variants", "sizes", "colors", "image_urls")},
        "brand": c("brand"),
        "category": F.lower(F.coalesce(c("category"), F.lit(""))),
        "currency": F.upper(F.coalesce(c("currency"), F.lit("INR"))),
        "seller_count": _whole("seller_count"), "best_seller_rank": _whole("best_seller_rank"),
        "search_term": c("search_term"),
        **{f: t.flag(c(f), True) for f in ("fragile", "brand_ip_risk", "seasonal_demand", "established_brand_dominance")},
        **{f: t.risk_level(c(f), True) for f in ("return_risk", "regulatory_complexity")},
        "bundle_potential_score": _n("bundle_potential_score"),
        "confidence_score": _n("confidence_score"),
        **sub,
    }


LISTING_COLUMNS = [
    "record_no", "name", "normalized_name", "url", "marketplace", "external_id", "brand", "category", "subcategory", "description",
    "features", "variants", "sizes", "colors", "image_urls", "weight_kg", "dimensions", "selling_price", "mrp", "discount_percentage",
    "currency", "review_count", "average_rating", "competitor_count", "seller_count", "best_seller_rank", "search_term", "costs", "fragile",
    "return_risk", "regulatory_complexity", "brand_ip_risk", "seasonal_demand", "established_brand_dominance", "bundle_potential_score",
    "pain_points", "source_name", "source_url", "collected_at", "confidence_score", "dataset_status",
]


def dataset_status(explicit: Column, is_sample: Column) -> Column:
    """A valid explicit status wins, then the sample flag; VERIFIED is never assumed."""
    claimed = F.upper(explicit)
    return F.when(claimed.isin(DATASET_STATUSES), claimed).when(t.flag(is_sample, True), "SAMPLE").otherwise("UNVERIFIED")


def listings(raw: DataFrame, now: Column) -> DataFrame:
    """Demo/manual listing rows. ``malformed`` carries the first failing message, NULL for usable rows."""
    df = cleaned(raw, LISTING_FIELDS, ["url"])
    c = F.col
    name, url, price = c("name"), c("url"), _n("selling_price")
    source_url = F.coalesce(c("source_url"), url)
    source_name = F.coalesce(c("source_name"), F.lit("manual_csv"))
    sides = [_n(f"{s}_cm") for s in ("length", "width", "height")]
    costs = {f: f for f in ("product_cost", "shipping_cost", "packaging_cost", "marketplace_fee_override", "payment_fee", "advertising_cost", "return_allowance", "other_costs")}
    cells = {"complaint": c("complaints"), "positive": c("positives"), "opportunity": c("opportunities")}
    columns = {
        "name": t.display_name(name), "normalized_name": t.match_name(name), "url": canonical_url(url, c("u_url")),
        "marketplace": F.lower(F.coalesce(c("marketplace"), F.lit(""))), "external_id": c("external_id"),
        "weight_kg": _n("weight_kg"),
        "dimensions": F.when(
            reduce(lambda a, b: a & b, [s.isNotNull() for s in sides]),
            F.struct(sides[0].alias("length_cm"), sides[1].alias("width_cm"), sides[2].alias("height_cm")),
        ),
        "selling_price": price, "mrp": _n("mrp"), "discount_percentage": discount_pct(price, _n("mrp")),
        "review_count": _whole("review_count"), "average_rating": _n("average_rating"),
        "competitor_count": _whole("competitor_count"),
        "costs": _cost_struct(costs, F.coalesce(c("cost_source"), F.lit("manual entry")), c("cost_source_url")),
        "pain_points": pain_points(cells, source_name, source_url, _n("confidence_score")),
        "source_name": source_name, "source_url": source_url,
        "collected_at": F.coalesce(t.instant(c("collected_at"), True), now),
        "dataset_status": dataset_status(c("dataset_status"), c("is_sample_data")),
    }
    malformed = (
        F.when(name.isNull(), "name is empty").when(url.isNull(), "url is empty")
        .when(price.isNull(), F.concat(F.lit("selling_price '"), c("raw_price"), F.lit("' is not a number")))
    )
    out = _shared(c, columns)
    ready = {**out, "record_no": c("record_no")}
    return df.select(*[ready[n].alias(n) for n in LISTING_COLUMNS], malformed.alias("malformed"), F.coalesce(name, url).alias("identifier"))


def research(raw: DataFrame) -> DataFrame:
    """Research records. Absent required values stay NULL for the validator; unreadable ones are malformed."""
    df = cleaned(raw, REQUIRED_FIELDS + OPTIONAL_FIELDS + UNLISTED_FIELDS, ["product_url"])
    c = F.col
    read = lambda f: c(f)
    price, seen = _n("observed_price"), t.instant(c("observed_at"), True)
    source_name, source_url = F.coalesce(read("source_name"), F.lit("")), F.coalesce(read("source_url"), F.lit(""))
    costs = {
        "product_cost": "supplier_cost", "shipping_cost": "shipping_cost", "packaging_cost": "packaging_cost",
        "marketplace_fee_override": "marketplace_fee", "payment_fee": "payment_fee", "advertising_cost": "advertising_cost",
        "return_allowance": "return_allowance", "other_costs": "other_costs",
    }
    cells = {"complaint": c("complaints"), "positive": c("positives"), "opportunity": c("opportunities")}
    blank = lambda x: F.coalesce(x, F.lit(""))
    columns = {
        "name": blank(t.display_name(read("product_name"))), "normalized_name": blank(t.match_name(read("product_name"))),
        "url": blank(canonical_url(read("product_url"), c("u_product_url"))),
        "marketplace": F.lower(F.coalesce(read("marketplace"), read("source"), F.lit(""))), "external_id": read("product_id"),
        "weight_kg": _n("product_weight"), "dimensions": t.size_cm(c("product_dimensions"), True),
        "selling_price": price, "mrp": _n("mrp"), "discount_percentage": discount_pct(price, _n("mrp")),
        "review_count": F.when(read("review_count").isNotNull(), _whole("review_count")).otherwise(_whole("demand_signal")), "average_rating": _n("rating"),
        "competitor_count": _whole("competition_signal"),
        "costs": _cost_struct(costs, F.coalesce(read("cost_source_name"), source_name), read("cost_source_url")),
        "pain_points": pain_points(cells, source_name, source_url, _n("confidence_score")),
        "source_name": source_name, "source_url": source_url, "collected_at": seen, "dataset_status": F.lit("UNVERIFIED"),
    }
    declared = F.upper(F.coalesce(read("dataset_status"), F.lit("")))
    malformed = (
        F.when(read("observed_price").isNotNull() & price.isNull(), F.concat(F.lit("observed_price '"), read("observed_price"), F.lit("' is not a number")))
        .when(read("observed_at").isNotNull() & seen.isNull(), F.concat(F.lit("observed_at '"), read("observed_at"), F.lit("' is not a parseable timestamp")))
    )
    ready = {**_shared(c, columns), "record_no": c("record_no")}
    extra = [
        declared.alias("declared_status"),
        (F.coalesce(t.flag(c("verification_requested"), True), F.lit(False)) | (declared == "VERIFIED")).alias("verification_requested"),
        t.has_inch_or_mm(c("product_dimensions"), True).alias("unit_not_converted"),
        observations(read).alias("observations"),
        malformed.alias("malformed"),
        F.coalesce(read("product_name"), read("product_url")).alias("identifier"),
    ]
    return df.select(*[ready[n].alias(n) for n in LISTING_COLUMNS], *extra)


def observations(read) -> Column:
    """Every supplied field as (name, raw text, number where the field is numeric)."""
    entries = [
        F.struct(F.lit(f).alias("field_name"), read(f).alias("raw_value"), (_n(f) if f in NUMERIC_FIELDS else F.lit(None).cast("double")).alias("numeric_value"))
        for f in REQUIRED_FIELDS + OPTIONAL_FIELDS
    ]
    return F.filter(F.array(*entries), lambda e: e["raw_value"].isNotNull())


def malformed_rows(standardized: DataFrame, code: str = "MALFORMED_RECORD") -> DataFrame:
    bad = standardized.where(F.col("malformed").isNotNull())
    return bad.select("record_no", "identifier", F.lit(code).alias("code"), F.array("malformed").alias("errors"))


def usable_rows(standardized: DataFrame) -> DataFrame:
    return standardized.where(F.col("malformed").isNull()).drop("malformed", "identifier")
