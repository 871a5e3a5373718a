"""Seven sub-scores, the gated final score, risk and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed import COMPONENTS, CRITICAL_FIELDS
from listwright.functions.numbers import clamp, half_up, scaled_to_range, text
from listwright.session import stage

COHORT_MIN = 3
_ALL = "all products"
_SMALL = "all products (category cohort too small)"


def _ranges() -> list[Column]:
    reviews = F.log(F.col("review_count") + 1.0)
    return [
        F.count(F.lit(1)).alias("cohort_size"),
        F.min(reviews).alias("log_reviews_min"), F.max(reviews).alias("log_reviews_max"),
        F.min("competitor_count").alias("competitors_min"), F.max("competitor_count").alias("competitors_max"),
    ]


def cohorts(products: DataFrame, exclude_sample: bool = False) -> DataFrame:
    """One row per category: ranges of its own members, or of all products below three members.

    The overall row is folded from the category rows, so the products are read once.
    """
    members = products.where(F.col("dataset_status") != "SAMPLE") if exclude_sample else products
    by_category = members.groupBy("category").agg(*_ranges())
    overall = by_category.agg(
        F.sum("cohort_size").alias("cohort_size"),
        F.min("log_reviews_min").alias("log_reviews_min"), F.max("log_reviews_max").alias("log_reviews_max"),
        F.min("competitors_min").alias("competitors_min"), F.max("competitors_max").alias("competitors_max"),
    )
    stats = ["cohort_size", "log_reviews_min", "log_reviews_max", "competitors_min", "competitors_max"]
    everyone = overall.select(F.lit(1).alias("_one"), F.struct(*stats).alias("_all"))
    both = by_category.withColumn("_one", F.lit(1)).join(F.broadcast(everyone), "_one")  # one row
    own = F.col("cohort_size") >= COHORT_MIN
    return both.select(
        "category",
        *[F.when(own, F.col(s)).otherwise(F.col(f"_all.{s}")).alias(s) for s in stats],
        F.when(own, F.concat(F.lit("category:"), F.col("category"))).otherwise(F.lit(_SMALL)).alias("cohort_label"),
    )


def with_cohorts(products: DataFrame, cohort_rows: DataFrame) -> DataFrame:
    """The staged cohort table is broadcast by its size on disk; there is no hint to outgrow."""
    return products.join(stage(cohort_rows, "cohorts"), "category", "left")


def _band(x: Column, bands: list[dict], limit: str) -> Column:
    out = F.lit(0.0)
    for band in reversed(bands):
        hit = F.lit(True) if band[limit] is None else x <= F.lit(float(band[limit]))
        out = F.when(hit, F.lit(float(band["penalty"]))).otherwise(out)
    return out


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def with_sub_scores(products: DataFrame, cfg: dict) -> DataFrame:
    """Adds the seven sub-scores and the parts they are made of; NULL where an input is missing."""
    d, ship, prof = cfg["demandScore"], cfg["shippingSimplicityScore"], cfg["profitabilityScore"]
    brand_penalty = F.when(_yes("established_brand_dominance"), F.lit(float(cfg["competitionOpportunityScore"]["establishedBrandDominancePenalty"]))).otherwise(0.0)
    fragile_penalty = F.when(_yes("fragile"), F.lit(float(ship["fragilePenalty"]))).otherwise(0.0)
    volume = F.col("length_cm") * F.col("width_cm") * F.col("height_cm")
    baselines = cfg["bundleExpansionScore"]["categoryBaselines"]
    baseline = F.create_map(*[F.lit(x) for slug, points in baselines.items() for x in (slug, float(points))])[F.col("category")]

    df = products.withColumns({
        "log_reviews": F.log(F.col("review_count") + 1.0),
        "brand_penalty": brand_penalty,
        "fragile_penalty": fragile_penalty,
        "weight_penalty": F.when(F.col("weight_kg").isNotNull(), _band(F.col("weight_kg"), ship["weightPenaltyBandsKg"], "maxKg")),
        "volume_cm3": volume,
        "volume_penalty": F.when(volume.isNull(), 0.0).otherwise(_band(volume, ship["volumetricPenaltyBandsCm3"], "maxCm3")),
        "bundle_baseline": baseline,
        "rating_component": clamp(F.col("average_rating") / 5.0 * 100.0),
    })
    df = df.withColumns({
        "volume_component": F.when(F.col("review_count").isNotNull(), scaled_to_range(F.col("log_reviews"), F.col("log_reviews_min"), F.col("log_reviews_max"))),
        "competition_intensity": F.when(
            F.col("competitor_count").isNotNull(),
            scaled_to_range(F.col("competitor_count").cast("double"), F.col("competitors_min").cast("double"), F.col("competitors_max").cast("double")),
        ),
    })
    span = float(prof["marginCeilingPct"] - prof["marginFloorPct"])
    seen = F.coalesce(F.col("pain_rows"), F.lit(0)) > 0
    points = lambda n, per: F.when(seen, half_up(clamp(F.coalesce(F.col(n), F.lit(0)) * F.lit(float(per)))))
    return df.withColumns({
        "demand": half_up(F.col("volume_component") * float(d["reviewVolumeWeight"]) + F.col("rating_component") * float(d["ratingWeight"])),
        "profitability": F.when(F.col("is_reliable"), half_up(clamp((F.col("margin_pct") - float(prof["marginFloorPct"])) / span * 100.0))),
        "competition_opportunity": half_up(clamp(F.lit(100.0) - F.col("competition_intensity") - F.col("brand_penalty"))),
        "differentiation": points("opportunity_count", cfg["differentiationScore"]["pointsPerOpportunity"]),
        "shipping_simplicity": half_up(clamp(F.lit(100.0) - F.col("weight_penalty") - F.col("volume_penalty") - F.col("fragile_penalty"))),
        "customer_pain_opportunity": points("complaint_count", cfg["customerPainOpportunityScore"]["pointsPerComplaint"]),
        "bundle_expansion": half_up(clamp(F.coalesce(F.col("bundle_potential_score").cast("double"), F.col("bundle_baseline")))),
    })


def missing_critical() -> Column:
    """Ordered names of the critical inputs that are absent; a zero counts as present."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    absent = {
        "selling_price": F.col("selling_price").isNull(),
        "product_cost": F.col("product_cost").isNull(),
        "marketplace": blank("marketplace"),
        "demand_signal": F.col("review_count").isNull() | F.col("average_rating").isNull(),
        "competition_signal": F.col("competitor_count").isNull(),
        "source": blank("source_name") | blank("source_url"),
        "collected_at": F.col("collected_at").isNull(),
    }
    return F.filter(F.array(*[F.when(absent[f], F.lit(f)) for f in CRITICAL_FIELDS]), lambda f: f.isNotNull())


def critical_labels(fields: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CRITICAL_FIELDS.items() for x in pair])
    return F.transform(fields, lambda f: F.coalesce(known[f], f))


def with_quality(products: DataFrame) -> DataFrame:
    df = products.withColumn("missing_critical_fields", missing_critical())
    status = F.when(F.size("missing_critical_fields") == 0, F.lit("COMPLETE")).otherwise(F.lit("INCOMPLETE"))
    return df.withColumn("score_status", status)


def with_final_score(products: DataFrame, cfg: dict) -> DataFrame:
    """Weighted mean over the available sub-scores; withheld while a critical input is missing."""
    weights = {c: float(cfg["finalScoreWeights"][key]) for c, key in COMPONENTS}
    available = F.lit(0.0)
    for c, w in weights.items():
        available = available + F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
    df = products.withColumn("_available", available)
    graded = (F.col("score_status") == "COMPLETE") & (F.col("_available") > 0)
    share = {c: F.when(F.col(c).isNotNull() & graded, F.lit(w) / F.nullif(F.col("_available"), F.lit(0.0))) for c, w in weights.items()}
    total = F.lit(0.0)
    for c in weights:
        total = total + F.coalesce(F.col(c) * share[c], F.lit(0.0))

    def as_map(value) -> Column:
        pairs = F.create_map(*[x for c, key in COMPONENTS for x in (F.lit(key), value(c))])
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    return df.withColumns({
        "effective_weights": as_map(lambda c: half_up(share[c], 4)),
        "contributions": as_map(lambda c: half_up(F.col(c) * share[c])),
        "data_completeness": half_up(F.col("_available")),
        "final_score": F.when(graded, half_up(clamp(total))),
    }).drop("_available")


def with_risk(products: DataFrame, cfg: dict) -> DataFrame:
    """Penalty sum with a reason per penalty; missing cost data adds a reason but no points."""
    r = cfg["riskScore"]
    margin = F.when(F.col("is_reliable"), F.col("margin_pct"))
    levels = lambda column, points: F.create_map(*[F.lit(x) for k, v in points.items() for x in (k, float(v))])[F.col(column)]
    low_margin = F.concat(F.lit("Low margin ("), text(margin, 2), F.lit(f"% < {r['lowMarginThresholdPct']}%)"))
    named = lambda column, what: F.concat(F.col(column), F.lit(what))
    rules = [
        ("fragile", _yes("fragile"), F.lit(float(r["fragilePenalty"])), F.lit("Fragile product")),
        ("heavyOrBulky", F.col("shipping_simplicity") < float(r["heavyOrBulkyShippingSimplicityThreshold"]), F.lit(float(r["heavyOrBulkyPenalty"])), F.lit("Heavy or bulky to ship")),
        ("lowMargin", margin < float(r["lowMarginThresholdPct"]), F.lit(float(r["lowMarginPenalty"])), low_margin),
        ("highCompetition", F.col("competition_opportunity") < float(r["highCompetitionOpportunityThreshold"]), F.lit(float(r["highCompetitionPenalty"])), F.lit("High competition")),
        ("establishedBrandDominance", _yes("established_brand_dominance"), F.lit(float(r["establishedBrandDominancePenalty"])), F.lit("Strong established brands")),
        ("returnRisk", levels("return_risk", r["returnRiskPenalty"]) > 0, levels("return_risk", r["returnRiskPenalty"]), named("return_risk", " return risk")),
        ("regulatoryComplexity", levels("regulatory_complexity", r["regulatoryComplexityPenalty"]) > 0, levels("regulatory_complexity", r["regulatoryComplexityPenalty"]), named("regulatory_complexity", " regulatory complexity")),
        ("brandIpRisk", _yes("brand_ip_risk"), F.lit(float(r["brandIpRiskPenalty"])), F.lit("Brand/IP risk")),
        ("seasonalDemand", _yes("seasonal_demand"), F.lit(float(r["seasonalDemandPenalty"])), F.lit("Seasonal demand")),
    ]
    points = F.lit(0.0)
    for _, condition, penalty, _ in rules:
        points = points + F.when(condition, penalty).otherwise(0.0)
    reasons = [F.when(condition, reason) for _, condition, _, reason in rules]
    reasons.append(F.when(~_yes("is_reliable"), F.lit("Quality uncertainty: no verified cost data")))
    penalties = F.create_map(*[x for name, condition, penalty, _ in rules for x in (F.lit(name), F.when(condition, penalty))])
    return products.withColumns({
        "risk_score": half_up(clamp(points)),
        "risk_reasons": F.filter(F.array(*reasons), lambda x: x.isNotNull()),
        "risk_penalties": F.map_filter(penalties, lambda _, v: v.isNotNull()),
    })


def with_class(products: DataFrame, cfg: dict) -> DataFrame:
    c = cfg["classification"]
    final, risk = F.col("final_score"), F.col("risk_score")
    strong = (final >= float(c["strongCandidate"]["minFinalScore"])) & (risk <= float(c["strongCandidate"]["maxRiskScore"]))
    grade = (
        F.when(final.isNull(), None)
        .when(risk >= float(c["weakCandidateRiskOverride"]["minRiskScore"]), "C")
        .when(strong, "A")
        .when(final >= float(c["needsValidation"]["minFinalScore"]), "B")
        .otherwise("C")
    )
    return products.withColumn("classification", grade)


def with_scores(products: DataFrame, cfg: dict) -> DataFrame:
    return with_class(with_risk(with_final_score(with_quality(with_sub_scores(products, cfg)), cfg), cfg), cfg)


def evidence(scored: DataFrame, cfg: dict) -> DataFrame:
    """Adds ``score_breakdown``: the inputs and formula behind every sub-score."""
    d, ship, prof = cfg["demandScore"], cfg["shippingSimplicityScore"], cfg["profitabilityScore"]
    diff, pain = cfg["differentiationScore"]["pointsPerOpportunity"], cfg["customerPainOpportunityScore"]["pointsPerComplaint"]
    c = F.col
    cohort = [c("cohort_label").alias("cohort"), c("cohort_size").alias("cohortSize")]
    lit = lambda v, name: F.lit(v).alias(name)
    why_not = lambda column, message: F.when(c(column).isNull(), message if isinstance(message, Column) else F.lit(message)).alias("unavailableReason")
    no_reviews = "No review-derived observations collected for this product."
    bundle_source = F.when(c("bundle_potential_score").isNotNull(), "manual_override").when(c("bundle_baseline").isNotNull(), "category_baseline")
    inputs = {
        "demand": [
            c("review_count").alias("reviewCount"), c("average_rating").alias("averageRating"),
            half_up(c("log_reviews")).alias("logReviews"), half_up(c("volume_component")).alias("volumeComponent"),
            half_up(c("rating_component")).alias("ratingComponent"), *cohort,
            lit(f"{d['reviewVolumeWeight']} * normalized(ln(reviews+1)) + {d['ratingWeight']} * (rating/5*100)", "formula"),
            why_not("demand", "Requires both review count and average rating."),
        ],
        "profitability": [
            c("margin_pct").alias("profitMarginPercentage"), c("profit").alias("profitPerUnit"),
            c("selling_price").alias("sellingPrice"), c("total_cost").alias("totalCost"),
            lit(prof["marginFloorPct"], "marginFloorPct"), lit(prof["marginCeilingPct"], "marginCeilingPct"),
            c("missing_costs").alias("missingCostFields"),
            lit("clamp((margin% - floor%) / (ceiling% - floor%) * 100, 0, 100)", "formula"),
            why_not("profitability", "Requires a selling price and a supplier/product cost."),
        ],
        "competition_opportunity": [
            c("competitor_count").alias("competitorCount"), half_up(c("competition_intensity")).alias("competitionIntensity"),
            c("established_brand_dominance").alias("establishedBrandDominance"), c("brand_penalty").alias("brandPenalty"), *cohort,
            lit("100 - normalized(competitor_count) - established_brand_penalty", "formula"),
            lit("100 = attractive competition environment, 0 = extremely difficult", "direction"),
            why_not("competition_opportunity", "Requires a counted number of comparable competing listings."),
        ],
        "differentiation": [
            F.coalesce("opportunity_count", F.lit(0)).alias("opportunityCount"), lit(diff, "pointsPerOpportunity"),
            lit("min(opportunity_count * points_per_opportunity, 100)", "formula"), why_not("differentiation", no_reviews),
        ],
        "shipping_simplicity": [
            c("weight_kg").alias("weightKg"), c("weight_penalty").alias("weightPenalty"), c("volume_cm3").alias("volumeCm3"),
            c("volume_penalty").alias("volumePenalty"), c("fragile"), c("fragile_penalty").alias("fragilePenalty"),
            c("volume_cm3").isNotNull().alias("dimensionsAvailable"),
            lit("100 - weight_penalty - volumetric_penalty - fragile_penalty", "formula"),
            why_not("shipping_simplicity", "Requires product weight."),
        ],
        "customer_pain_opportunity": [
            F.coalesce("complaint_count", F.lit(0)).alias("complaintCount"), lit(pain, "pointsPerComplaint"),
            lit("min(complaint_count * points_per_complaint, 100)", "formula"), why_not("customer_pain_opportunity", no_reviews),
        ],
        "bundle_expansion": [
            bundle_source.alias("source"), c("category"), c("bundle_potential_score").alias("manualValue"), c("bundle_baseline").alias("baseline"),
            why_not("bundle_expansion", F.concat(F.lit("No manual value and no category baseline configured for '"), c("category"), F.lit("'."))),
        ],
    }
    sub_scores = F.struct(*[
        F.struct(c(name).alias("value"), F.struct(*inputs[name]).alias("evidence")).alias(key) for name, key in COMPONENTS
    ])
    return scored.withColumn("score_breakdown", F.struct(
        sub_scores.alias("subScores"), c("effective_weights").alias("effectiveWeights"), c("contributions"),
        c("risk_penalties").alias("risk"), c("cost_breakdown").alias("costBreakdown"), c("fees").alias("appliedFees"),
        F.struct("score_status", "missing_critical_fields", critical_labels(c("missing_critical_fields")).alias("missing_critical_labels")).alias("dataQuality"),
    ))
