"""Dashboards, details, comparisons, explanations and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed import DISCLAIMERS, EXPORT_COLUMNS, NEXT_STEPS, NO_RISKS, UNAVAILABLE
from listwright.functions.numbers import grouped, half_up, rupees, text
from listwright.functions.text import iso
from listwright.operators.history import newest

from listwright.operators.scoring import critical_labels


def disclaimer() -> Column:
    status = F.col("dataset_status")
    return (
        F.when(status == "SAMPLE", DISCLAIMERS["SAMPLE"])
        .when(F.col("score_status") == "INCOMPLETE", DISCLAIMERS["INCOMPLETE"])
        .when(status == "UNVERIFIED", DISCLAIMERS["UNVERIFIED"])
        .otherwise(DISCLAIMERS["VERIFIED"])
    )


def next_step() -> Column:
    return F.when(F.col("dataset_status") == "SAMPLE", NEXT_STEPS["SAMPLE"]).otherwise(NEXT_STEPS["OTHER"])


# --- summary ----------------------------------------------------------------------------------

def summary(products: DataFrame, scores: DataFrame) -> DataFrame:
    """Headline numbers in one row, from one partial aggregate over product and score."""
    c = F.col
    both = products.select("product_id", "dataset_status", "verification_notes").join(
        scores.withColumn("_scored", F.lit(True)), "product_id", "left"
    )
    n_if = lambda condition: F.count_if(condition)
    exact_avg = lambda x: F.sum(x.cast("decimal(18,2)")).cast("double")
    scored = F.coalesce(c("_scored"), F.lit(False))
    agg = both.agg(
        F.count(F.lit(1)).alias("total_products"),
        n_if(c("final_score").isNotNull()).alias("products_scored"),
        n_if(c("final_score") > 70).alias("products_above_70"),
        exact_avg(c("profit_margin_percentage")).alias("_margin"),
        F.count("profit_margin_percentage").alias("_margins"),
        n_if(c("risk_score") >= 60).alias("high_risk_products"),
        *[n_if(c("classification") == k).alias(f"class_{k.lower()}") for k in "ABC"],
        n_if(scored & c("classification").isNull()).alias("class_none"),
        exact_avg(F.when(scored, F.coalesce("data_completeness", F.lit(0.0)))).alias("_complete"),
        n_if(scored).alias("_scores"),
        *[n_if(c("dataset_status") == k).alias(f"status_{k.lower()}") for k in ("SAMPLE", "UNVERIFIED", "VERIFIED")],
        n_if(c("verification_notes").isNotNull()).alias("downgraded_claims"),
        *[n_if(c("score_status") == k).alias(f"score_{k.lower()}") for k in ("COMPLETE", "INCOMPLETE")],
        n_if((c("dataset_status") != "SAMPLE") & (c("score_status") == "COMPLETE") & c("final_score").isNotNull()).alias("verified_opportunities"),
    )
    ratio = lambda a, b: half_up(c(a) / F.nullif(c(b).cast("double"), F.lit(0.0)))
    return agg.withColumns({
        "products_unscored": c("total_products") - c("products_scored"),
        "average_margin": ratio("_margin", "_margins"),
        "margin_coverage": F.coalesce(ratio("_margins", "total_products"), F.lit(0.0)),
        "average_completeness": ratio("_complete", "_scores"),
        "real_verified_products": c("status_verified"),
    }).drop("_margin", "_margins", "_complete", "_scores")


def category_rollup(products: DataFrame, scores: DataFrame) -> DataFrame:
    both = products.select("product_id", "category").join(scores.select("product_id", "final_score"), "product_id", "left")
    total = F.sum(F.col("final_score").cast("decimal(18,2)")).cast("double")
    rows = both.groupBy("category").agg(F.count(F.lit(1)).alias("product_count"), (total / F.nullif(F.count("final_score").cast("double"), F.lit(0.0))).alias("_avg"))
    return rows.select("category", "product_count", half_up(F.col("_avg")).alias("average_score")).orderBy(
        F.col("average_score").desc_nulls_last(), "category"
    )


# --- pain points and provenance ---------------------------------------------------------------

def _mentions() -> Column:
    return F.coalesce(F.col("mention_count"), F.lit(0))


def main_pain_points(pain_points: DataFrame) -> DataFrame:
    """Per product: most mentioned complaint (ties by theme) and first opportunity (by theme)."""
    complaint = F.col("type") == "complaint"
    opportunity = F.col("type") == "opportunity"
    top = F.min(F.when(complaint, F.struct((-_mentions()).alias("m"), F.col("theme").alias("t"))))
    return pain_points.groupBy("product_id").agg(
        top["t"].alias("top_complaint"),
        F.min(F.when(opportunity, F.col("theme"))).alias("first_opportunity"),
    )


def pain_summary(pain_points: DataFrame) -> DataFrame:
    """Counts, main themes and theme lists per product, for products of a result page.

    A product's pain points come from three cells of one submitted record, which bounds the lists.
    """
    themes = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("theme"))))
    return pain_points.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("pain_rows"),
        themes("complaint").alias("complaints"),
        themes("opportunity").alias("opportunities"),
        F.min(F.when(F.col("type") == "complaint", F.struct((-_mentions()).alias("m"), F.col("theme").alias("t"))))["t"].alias("top_complaint"),
        F.collect_set("source_name").alias("pain_sources"),
    )


def data_sources(products: DataFrame, pain_points: DataFrame) -> DataFrame:
    """Distinct source names per product in long form: its own and those of its pain points."""
    own = products.select("product_id", "source_name")
    return own.unionByName(pain_points.select("product_id", "source_name")).where("source_name is not null").distinct()


def provenance(products: DataFrame, prices: DataFrame, metrics: DataFrame, costs: DataFrame, pain_points: DataFrame, order: list[str]) -> DataFrame:
    """Up to five entries per product: where each kind of value came from, when, how trusted."""
    fields = ["source_name", "source_url", "collected_at", "confidence_score"]
    parts = [(1, "Product record", products.select("product_id", *fields))]
    for i, (label, rows) in enumerate([("Selling price / MRP", prices), ("Demand & competition signals", metrics), ("Cost inputs", costs)], 2):
        parts.append((i, label, newest(rows, ["product_id"], order, fields)))
    first = pain_points.groupBy("product_id").agg(F.min_by(F.struct(*fields), F.struct("type", "theme")).alias("r")).select("product_id", "r.*")
    parts.append((5, "Review observations", first))
    status = products.select("product_id", "dataset_status")
    rows = None
    for position, label, part in parts:
        entry = part.select("product_id", F.lit(position).cast("long").alias("position"), F.lit(label).alias("field"), *fields)
        rows = entry if rows is None else rows.unionByName(entry)
    return rows.join(status, "product_id")


# --- detail and comparison --------------------------------------------------------------------

def requested(spark, ids: str) -> DataFrame:
    """Up to five ids of a comma-separated request, blanks dropped, in request order."""
    return spark.createDataFrame([(ids,)], "ids string").select(
        F.posexplode(F.slice(F.filter(F.transform(F.split("ids", ","), lambda i: F.trim(i)), lambda i: i != ""), 1, 5)).alias("position", "product_id")
    ).withColumn("position", F.col("position").cast("long") + 1)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a few requested products, before anything is aggregated.

    ``ids`` is a comparison (at most 5 rows) or a page (at most 500), which bounds the broadcast.
    """
    return rows.join(F.broadcast(ids.select("product_id").distinct()), "product_id", "left_semi")


# --- explanations -----------------------------------------------------------------------------

def explanations(top: DataFrame, details: DataFrame, pains: DataFrame) -> DataFrame:
    """Evidence sentences for the rows of ``top``, from stored values only.

    ``details`` has, per product, the newest price, mrp, discount, metrics, search term and costs
    with economics; ``pains`` is ``pain_summary``. Both are already limited to the ids of ``top``.
    """
    c = F.col
    na = F.lit(UNAVAILABLE)
    joined = top.join(details, "product_id", "left").join(pains, "product_id", "left")
    reviews = F.concat(
        grouped(c("review_count").cast("double")), F.lit(" reviews at "), text(c("average_rating")), F.lit("/5 on "), c("marketplace"),
        F.lit(" (review count is an indirect popularity signal, not a sales figure)."),
    )
    off = F.when(c("latest_discount") != 0, F.concat(F.lit(" ("), text(c("latest_discount"), 2), F.lit("% off)")))
    against = F.when(c("latest_mrp") != 0, F.concat(F.lit(" against an MRP of "), rupees(c("latest_mrp"), UNAVAILABLE)))
    pricing = F.concat(F.lit("Listed at "), rupees(c("latest_price"), UNAVAILABLE), F.coalesce(against, F.lit("")), F.coalesce(off, F.lit("")), F.lit("."))
    searched = F.when(c("search_term") != "", F.concat(F.lit(' for "'), c("search_term"), F.lit('"')))
    competition = F.concat(
        c("competitor_count").cast("string"), F.lit(" comparable listings counted"), F.coalesce(searched, F.lit("")),
        F.lit("; competition opportunity scores "), F.coalesce(text(c("competition_opportunity_score"), 2), na), F.lit("/100 (100 = least contested)."),
    )
    money = F.concat(
        rupees(c("selling_price"), UNAVAILABLE), F.lit(" selling price less "), rupees(c("total_cost"), UNAVAILABLE), F.lit(" total cost leaves "),
        rupees(c("profit_per_unit"), UNAVAILABLE), F.lit(" per unit ("), text(c("profit_margin_percentage"), 2), F.lit("% margin). "), F.array_join("economics_notes", " "),
    )
    n_complaints = F.coalesce(F.size("complaints"), F.lit(0))
    pain = (
        F.when(n_complaints > 0, F.concat(n_complaints.cast("string"), F.lit(" recurring complaint theme(s) recorded from listing reviews: "), F.array_join("complaints", ", "), F.lit(".")))
        .when(c("pain_rows") > 0, "Reviews were read and no recurring complaint theme was recorded.")
        .otherwise(na)
    )
    n_opportunities = F.coalesce(F.size("opportunities"), F.lit(0))
    return joined.select(
        "rank", "product_id", c("name").alias("product_name"), "category", "marketplace",
        c("selling_price").alias("current_price"), c("product_cost").alias("estimated_supplier_cost"), "estimated_landed_cost",
        "profit_per_unit", "profit_margin_percentage", "demand_score", "competition_opportunity_score", "differentiation_score",
        "risk_score", "final_score", "classification",
        c("top_complaint").alias("main_customer_pain_point"),
        F.when(n_opportunities > 0, F.get("opportunities", F.lit(0))).alias("differentiation_opportunity"),
        F.coalesce(F.when(c("average_rating").isNotNull(), reviews), na).alias("demand_evidence"),
        F.when(c("latest_price").isNotNull(), pricing).otherwise(na).alias("pricing_evidence"),
        F.coalesce(competition, na).alias("competition_evidence"),
        F.when(c("is_reliable"), money).otherwise(f"{UNAVAILABLE} — no supplier cost on record, so no profit figure is claimed.").alias("economics_evidence"),
        pain.alias("customer_pain_evidence"),
        F.when(n_opportunities > 0, F.concat(F.lit("Recorded opportunities: "), F.array_join("opportunities", ", "), F.lit("."))).otherwise(na).alias("differentiation_evidence"),
        F.when(F.size("risk_reasons") > 0, c("risk_reasons")).otherwise(F.array(F.lit(NO_RISKS))).alias("risks"),
        next_step().alias("suggested_validation_step"),
        F.array_distinct(F.concat(F.array("source_name"), F.coalesce(F.array_sort("pain_sources"), F.array().cast("array<string>")))).alias("data_sources"),
        "collected_at", "computed_at", "data_completeness", "dataset_status", "score_status",
        critical_labels(c("missing_critical_fields")).alias("missing_critical_fields"),
        disclaimer().alias("disclaimer"),
    )


# --- export -----------------------------------------------------------------------------------

def export_rows(ranked_rows: DataFrame) -> DataFrame:
    missing = F.when(F.size("missing_critical_fields") > 0, F.array_join("missing_critical_fields", "; ")).otherwise("None")
    source = {
        "product": F.col("name"), "price": F.col("selling_price"), "estimated_cost": F.col("estimated_landed_cost"),
        "estimated_profit": F.col("profit_per_unit"), "margin": F.col("profit_margin_percentage"),
        "missing_critical_fields": missing, "disclaimer": disclaimer(),
        "collected_at": iso(F.col("collected_at")), "score_computed_at": iso(F.col("computed_at")),
    }
    return ranked_rows.select(*[source.get(c, F.col(c)).alias(c) for c, _ in EXPORT_COLUMNS])
