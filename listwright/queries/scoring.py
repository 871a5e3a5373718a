"""Newest observations, economics, scores and what is served from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import binding, config
from listwright.fixed import COMPONENTS
from listwright.functions.numbers import half_up
from listwright.operators import history, scoring, serve
from listwright.operators.economics import fee_rows
from listwright.operators.ranked import ProductQuery, all_ranked, filtered, page, rank_base
from listwright.plans import detail, rescore

OBS_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey"]


def _joined(c: str, alias: str | None = None):
    return F.array_join(c, "; ").alias(alias or c)


def latest_price(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    df = history.newest(cat.prices, ["product_id"], cat.order(), ["selling_price", "mrp", *OBS_KEYS])
    return df.select("product_id", "selling_price", "mrp", "l_orderkey")


def latest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    return history.newest(cat.metrics, ["product_id"], cat.order(), history.METRIC_FIELDS)


def latest_cost(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    return history.newest(cat.costs, ["product_id"], cat.order(), rescore.COST_COLUMNS)


def price_change_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = binding.prices(spark, sf).withColumn("selling_price", F.floor(F.col("selling_price") / 500) * 500.0).withColumn("mrp", F.lit(None).cast("double"))
    kept = history.changed_in_order(rows, "product_id", ["collected_at", "row_id"], history.PRICE_FIELDS)
    return kept.select("product_id", "selling_price", *OBS_KEYS)


def metrics_change_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.with_any_metric(
        binding.metrics(spark, sf).withColumns({
            "review_count": F.expr("CASE WHEN review_count IS NOT NULL THEN review_count DIV 1000 END"),
            "average_rating": F.floor("average_rating").cast("double"),
            "competitor_count": F.expr("CASE WHEN competitor_count IS NOT NULL THEN 1 END").cast("long"),
        })
    )
    kept = history.changed_in_order(rows, "product_id", ["collected_at", "row_id"], history.METRIC_TRIGGERS)
    return kept.select("product_id", "review_count", "average_rating", "competitor_count", *OBS_KEYS)


def _late_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as price observations of a user that arrive by event id but were collected up to six days earlier."""
    return binding.table(spark, sf, "events").select(
        F.col("user_id").alias("product_id"), F.col("event_id").alias("arrival"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 7) * 86_400_000_000).alias("collected_at"),
        F.floor(F.col("value") / 100).cast("double").alias("selling_price"), F.lit(None).cast("double").alias("mrp"),
    )


def price_change_on_arrival(spark: SparkSession, sf: str) -> DataFrame:
    kept = history.changed_on_arrival(_late_arrivals(spark, sf), "product_id", "arrival", "collected_at", history.PRICE_FIELDS)
    return kept.select("product_id", "arrival", "selling_price")


def price_history_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    rows = history.newest_first(cat.prices, "product_id", cat.order())
    return rows.select("product_id", "position", "selling_price", "l_orderkey", "l_linenumber")


def fee_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = fee_rows(rescore.economics(binding.catalog(spark, sf), binding.AS_OF))
    return rows.select(
        "product_id", "fee_type", F.col("category").alias("fee_category"), "percentage", "amount",
        F.col("source").alias("fee_source"), F.col("effective_date").cast("string").alias("effective_date"),
    )


def unit_economics(spark: SparkSession, sf: str) -> DataFrame:
    return rescore.economics(binding.catalog(spark, sf), binding.AS_OF).select(
        "product_id", "selling_price", "marketplace_fee", "payment_fee", "total_cost", "landed_cost", "profit", "margin_pct", "roi_pct",
        "is_reliable", _joined("missing_costs"), _joined("economics_notes"),
    )


def cohort_stats(spark: SparkSession, sf: str) -> DataFrame:
    df = scoring.cohorts(rescore.signals(binding.catalog(spark, sf)))
    return df.select(
        "category", F.col("cohort_size").cast("long"), half_up(F.col("log_reviews_min")).alias("log_reviews_min"),
        half_up(F.col("log_reviews_max")).alias("log_reviews_max"), "competitors_min", "competitors_max", "cohort_label",
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return rescore.scored(binding.catalog(spark, sf), binding.AS_OF)


def sub_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("product_id", *[c for c, _ in COMPONENTS])


def score_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = scoring.evidence(_scored(spark, sf), config.scoring())
    sub = lambda key: F.col(f"score_breakdown.subScores.{key}.evidence")
    return e.select(
        "product_id", sub("demand")["ratingComponent"].alias("rating_component"),
        sub("demand")["cohort"].alias("cohort"), sub("demand")["cohortSize"].cast("long").alias("cohort_size"),
        sub("competitionOpportunity")["brandPenalty"].alias("brand_penalty"),
        sub("shippingSimplicity")["weightPenalty"].alias("weight_penalty"), sub("shippingSimplicity")["volumePenalty"].alias("volume_penalty"),
        sub("shippingSimplicity")["dimensionsAvailable"].alias("dimensions_available"),
        sub("bundleExpansion")["source"].alias("bundle_source"), sub("bundleExpansion")["unavailableReason"].alias("bundle_unavailable"),
        sub("differentiation")["opportunityCount"].alias("opportunity_count"),
        F.col("score_breakdown.risk")["regulatoryComplexity"].alias("regulatory_points"),
        F.array_join("score_breakdown.dataQuality.missing_critical_labels", "; ").alias("missing_labels"),
    )


def score_contributions(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    df = rescore.stored_scores(cat, binding.AS_OF).select("product_id", F.explode("contributions").alias("component", "contribution"), "effective_weights")
    return df.select("product_id", "component", "contribution", F.col("effective_weights")[F.col("component")].alias("effective_weight"))


def product_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = rescore.score_table(_scored(spark, sf))
    return t.drop("effective_weights", "contributions", "weights_snapshot", "computed_at").withColumns(
        {"missing_critical_fields": F.array_join("missing_critical_fields", "; "), "risk_reasons": F.array_join("risk_reasons", "; ")}
    )


def classification_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("classification", "score_status").agg(F.count(F.lit(1)).alias("products"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    return rank_base(cat.products, rescore.stored_scores(cat, binding.AS_OF), cat.marketplaces, cat.sources)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "rank", "product_id", "name", "marketplace", "category", "brand", "selling_price", "estimated_landed_cost", "profit_per_unit",
        "profit_margin_percentage", "demand_score", "risk_score", _joined("risk_reasons"), "final_score", "classification",
        "data_completeness", "dataset_status", "score_status", _joined("missing_critical_fields"), "source_name", "source_url",
    )


def ranked_products(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(page(_base(spark, sf), ProductQuery()))


#: One value for every kind of filter, with a page that starts past the first rows.
FILTERS = ProductQuery(
    category=("car-accessories", "home-organization", "storage-products", "kitchen-organization"), marketplace=("amazon_in", "flipkart", "meesho"),
    price_min=1000, price_max=90000, margin_min=5, demand_min=10, competition_opportunity_min=5, differentiation_min=20, risk_max=80,
    score_min=20, search="re", dataset_status=("UNVERIFIED", "VERIFIED", "SAMPLE"), exclude_sample_data=True, score_status="COMPLETE",
    sort_by="riskScore", sort_direction="ASC", limit=40, offset=3,
)


def ranked_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(page(_base(spark, sf), FILTERS))


def ranked_deep(spark: SparkSession, sf: str) -> DataFrame:
    """A page of 300 rows that begins behind the half of all rows, cut out by ranges."""
    base = _base(spark, sf)
    return _flat(page(base, ProductQuery(sort_by="riskScore", sort_direction="DESC", limit=300, offset=binding.table(spark, sf, "part").count() // 2), heap=100))


def ranked_total(spark: SparkSession, sf: str) -> DataFrame:
    from listwright.operators.ranked import total

    return total(_base(spark, sf), FILTERS)


def ranked_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(page(_base(spark, sf), ProductQuery(classification="B", verified_only=True, sort_by="no such column", limit=500)))


def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    return serve.export_rows(all_ranked(_base(spark, sf), ProductQuery()))


def _products_and_scores(spark: SparkSession, sf: str):
    cat = binding.catalog(spark, sf)
    return cat, rescore.stored_scores(cat, binding.AS_OF)


def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    cat, scores = _products_and_scores(spark, sf)
    return serve.summary(cat.products, scores)


def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    cat, scores = _products_and_scores(spark, sf)
    return serve.category_rollup(cat.products, scores)


def _explained(spark: SparkSession, sf: str, q: ProductQuery) -> DataFrame:
    cat = binding.catalog(spark, sf)
    top, details, pains = rescore.opportunity_inputs(cat, binding.AS_OF, q)
    return serve.explanations(top, details, pains).withColumns({
        "risks": F.array_join("risks", "; "), "data_sources": F.array_join("data_sources", "; "),
        "missing_critical_fields": F.array_join("missing_critical_fields", "; "),
    }).drop("collected_at", "computed_at")


def opportunity_explanations(spark: SparkSession, sf: str) -> DataFrame:
    return _explained(spark, sf, ProductQuery(limit=20))


def verified_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return _explained(spark, sf, ProductQuery(limit=20, verified_only=True))


def opportunities_all_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return _explained(spark, sf, ProductQuery(limit=500, score_status="INCOMPLETE"))


IDS = " P7, ,P3,P63,,P100 , P12,P5"


def compare_products(spark: SparkSession, sf: str) -> DataFrame:
    cat, scores = _products_and_scores(spark, sf)
    return detail.compare(cat, scores, serve.requested(spark, IDS), binding.AS_OF).select(
        "position", "product_id", "name", "category", "marketplace", "selling_price", "mrp", "review_count", "total_cost", "profit",
        "margin_pct", "roi_pct", "complaint_count", "opportunity_count", "score.final_score", "score.classification", "score.score_status", "score.risk_score",
    )


def product_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every part of the requested products' details: the score, and how much each other part holds."""
    cat, scores = _products_and_scores(spark, sf)
    parts = detail.product_detail(cat, scores, serve.requested(spark, IDS), binding.AS_OF)
    out = parts.product.select("product_id", "name", "brand", "profit", "score.final_score", "score.data_completeness", F.coalesce(F.size("fees"), F.lit(0)).cast("long").alias("fee_rows"))
    for name in ("provenance", "sources", "prices", "metrics", "costs", "pain_points"):
        out = out.join(getattr(parts, name).groupBy("product_id").agg(F.count(F.lit(1)).alias(f"{name}_rows")), "product_id", "left")
    return out


def product_detail_histories(spark: SparkSession, sf: str) -> DataFrame:
    """The three newest-first histories and the pain points of the requested products, in long form."""
    ids = serve.requested(spark, IDS)
    cat = rescore.restricted(binding.catalog(spark, sf), ids)
    rows = None
    for kind, table, value in [("price", cat.prices, "selling_price"), ("metrics", cat.metrics, "review_count"), ("cost", cat.costs, "product_cost")]:
        part = history.newest_first(table, "product_id", cat.order()).select(
            "product_id", F.lit(kind).alias("kind"), "position", F.col(value).cast("double").alias("value"), "source_name"
        )
        rows = part if rows is None else rows.unionByName(part)
    pains = cat.pain_points.select(
        "product_id", F.concat(F.lit("pain:"), F.col("theme")).alias("kind"), F.lit(0).cast("long").alias("position"), F.col("mention_count").cast("double").alias("value"), "source_name"
    )
    return rows.unionByName(pains)


def provenance_list(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    from listwright.functions.text import iso

    df = serve.provenance(cat.products, cat.prices, cat.metrics, cat.costs, cat.pain_points, cat.order())
    return df.withColumn("collected_at", iso(F.col("collected_at")))


def product_sources(spark: SparkSession, sf: str) -> DataFrame:
    cat = binding.catalog(spark, sf)
    return serve.data_sources(cat.products, cat.pain_points)


def pain_point_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rescore.pain_counts(binding.pain_points(spark, sf))


def main_pain_points(spark: SparkSession, sf: str) -> DataFrame:
    return serve.main_pain_points(binding.pain_points(spark, sf))


def cost_append(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with a cost struct, one cost row each."""
    listings = binding.costs(spark, sf).select(
        "product_id", F.when(F.expr("l_orderkey % 4 <> 0"), F.struct(*rescore.COST_COLUMNS)).alias("costs"), "collected_at", "confidence_score", *OBS_KEYS
    )
    rows = history.cost_rows(listings.withColumn("product_id", F.concat_ws("/", "product_id", *OBS_KEYS)))
    return rows.withColumn("effective_date", F.col("effective_date").cast("string")).drop("collected_at")


QUERIES = {
    f.__name__: f
    for f in [
        latest_price, latest_metrics, latest_cost, price_change_history, metrics_change_history, price_change_on_arrival,
        price_history_newest_first, cost_append, fee_asof, unit_economics, cohort_stats, sub_scores, score_evidence, score_contributions,
        product_scores, classification_counts, ranked_products, ranked_filtered, ranked_deep, ranked_total, ranked_by_class, export_rows, dashboard_summary,
        category_rollup, opportunity_explanations, verified_opportunities, opportunities_all_incomplete, compare_products, product_detail,
        product_detail_histories, provenance_list, product_sources, pain_point_counts, main_pain_points,
    ]
}
