"""Rescore every product: newest observations, economics, cohorts, scores."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright import config, schemas
from listwright.fixed import COMPONENTS
from listwright.functions.numbers import discount_pct, half_up
from listwright.operators import scoring, serve
from listwright.operators.economics import with_economics, with_fees
from listwright.operators.history import METRIC_FIELDS, newest
from listwright.operators.ranked import ProductQuery, page, rank_base
from listwright.session import stage
from listwright.sources.tables import Store, dimension

COST_COLUMNS = [
    "product_cost", "shipping_cost", "packaging_cost", "marketplace_fee_override", "payment_fee",
    "advertising_cost", "return_allowance", "other_costs",
]


@dataclass
class Catalog:
    """The stored tables the scoring and serving jobs read."""

    products: DataFrame
    prices: DataFrame
    metrics: DataFrame
    costs: DataFrame
    pain_points: DataFrame
    fees: DataFrame
    marketplaces: DataFrame
    sources: DataFrame
    #: columns after ``collected_at`` that make "newest" a total order
    tiebreak: tuple[str, ...] = ("row_id",)
    #: newest rows by history, where they are stored; the others are worked out from the history
    newest: dict[str, DataFrame] = field(default_factory=dict)

    def latest(self, name: str, values: list[str]) -> DataFrame:
        """One row per product with the values of its newest row."""
        if name in self.newest:
            return self.newest[name].select("product_id", *values)
        return newest(getattr(self, name), ["product_id"], self.order(), values)

    def order(self) -> list[str]:
        return ["collected_at", *self.tiebreak]


def pain_counts(pain_points: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("type") == k)
    return pain_points.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("pain_rows"), kind("complaint").alias("complaint_count"), kind("opportunity").alias("opportunity_count")
    )


def signals(cat: Catalog) -> DataFrame:
    """One row per product with its newest price, metrics and costs and its pain-point counts.

    Every child table is reduced to one row per product before the join, all on the same key.
    """
    return (
        cat.products
        .join(cat.latest("prices", ["selling_price", "mrp"]), "product_id", "left")
        .join(cat.latest("metrics", METRIC_FIELDS), "product_id", "left")
        .join(cat.latest("costs", COST_COLUMNS), "product_id", "left")
        .join(pain_counts(cat.pain_points), "product_id", "left")
    )


def economics(cat: Catalog, as_of: dt.date) -> DataFrame:
    return with_economics(with_fees(signals(cat), cat.fees, as_of))


def scored(cat: Catalog, as_of: dt.date, cfg: dict | None = None, exclude_sample: bool = False) -> DataFrame:
    """Products with every signal, economics and score column.

    The signals are written once: the cohort ranges and the scores are two passes over them.
    """
    cfg = cfg or config.scoring()
    base = stage(signals(cat), "signals")
    ranged = scoring.with_cohorts(base, scoring.cohorts(base, exclude_sample))
    return scoring.with_scores(with_economics(with_fees(ranged, cat.fees, as_of)), cfg)


def score_table(df: DataFrame, cfg: dict | None = None, computed_at=None) -> DataFrame:
    """The stored score row: profit figures only where the product cost is known."""
    cfg = cfg or config.scoring()
    sold = F.col("selling_price") > 0
    reliable = lambda c: F.when(F.col("is_reliable"), F.col(c))
    weights = F.create_map(*[F.lit(x) for _, k in COMPONENTS for x in (k, float(cfg["finalScoreWeights"][k]))])
    return df.select(
        "product_id",
        F.when(sold, half_up(F.col("selling_price"))).alias("selling_price"),
        F.col("landed_cost").alias("estimated_landed_cost"),
        reliable("profit").alias("profit_per_unit"),
        reliable("margin_pct").alias("profit_margin_percentage"),
        reliable("roi_pct").alias("roi_percentage"),
        *[F.col(c).alias(f"{c}_score") for c, _ in COMPONENTS],
        "final_score", "score_status", "missing_critical_fields", "risk_score", "risk_reasons", "classification",
        "data_completeness", "effective_weights", "contributions",
        weights.alias("weights_snapshot"),
        (F.lit(computed_at) if computed_at is not None else F.lit(None)).cast("timestamp").alias("computed_at"),
    )


def stored_scores(cat: Catalog, as_of: dt.date, cfg: dict | None = None, **options) -> DataFrame:
    """The score table as written: filters on it reach the scan instead of repeating the formulas."""
    return stage(score_table(scored(cat, as_of, cfg, **options), cfg), "scores")


def write_scores(store: Store, cat: Catalog, as_of: dt.date, run_id: str, computed_at, cfg: dict | None = None) -> None:
    """Rescores the catalog and commits the score table, each row with the breakdown behind its sub-scores."""
    cfg = cfg or config.scoring()
    explained = stage(scoring.evidence(scored(cat, as_of, cfg), cfg), "explained")
    breakdown = explained.select("product_id", F.to_json("score_breakdown").alias("score_breakdown"))
    with store.begin(run_id) as run:
        run.write_snapshot("scores", score_table(explained, cfg, computed_at).join(breakdown, "product_id"))


def stored_catalog(store: Store, fees: DataFrame | None = None, marketplaces: DataFrame | None = None, sources: DataFrame | None = None) -> Catalog:
    """The catalog as the newest commit has it, with stored dimensions where none are given; of rows collected at one time the one of the
    later run is newer. Newest rows come from their own tables, so rescoring reads no history."""
    fees, marketplaces, sources = (dimension(store, n) if d is None else d for n, d in (("fees", fees), ("marketplaces", marketplaces), ("sources", sources)))
    last = {n: store.read_snapshot(f"newest_{n}", schemas.TABLES[f"newest_{n}"]) for n in ("prices", "metrics", "costs")}
    history = lambda name, schema: store.with_run_time(store.read_history(name, schema))
    return Catalog(
        products=store.read_snapshot("products", schemas.PRODUCTS).select("*", "dimensions.*", F.lit(None).cast("long").alias("data_source_id")),
        prices=history("prices", schemas.PRICES), metrics=history("metrics", schemas.METRICS),
        costs=history("costs", schemas.COSTS).withColumn("record_no", F.lit(0).cast("long")), pain_points=store.read_snapshot("pain_points", schemas.PAIN_POINTS),
        fees=fees, marketplaces=marketplaces, sources=sources, tiebreak=("run_at", "run_id", "record_no"), newest=last,
    )


def restricted(cat: Catalog, ids: DataFrame) -> Catalog:
    """The catalog cut to a few requested products before anything is aggregated."""
    cut = {name: serve.only(getattr(cat, name), ids) for name in ("products", "prices", "metrics", "costs", "pain_points")}
    return replace(cat, **cut, newest={name: serve.only(rows, ids) for name, rows in cat.newest.items()})


def opportunity_inputs(cat: Catalog, as_of: dt.date, q: ProductQuery, cfg: dict | None = None):
    """Top page by final score, and details and pain points of its products only."""
    forced = replace(q, sort_by="finalScore", sort_direction="DESC", offset=0)
    base = rank_base(cat.products, stored_scores(cat, as_of, cfg), cat.marketplaces, cat.sources)
    top = stage(page(base, forced), "top")
    few = restricted(cat, top)
    detail = economics(few, as_of)
    searched = few.latest("metrics", ["search_term"]) if "search_term" in few.metrics.columns else None
    details = detail.select(
        "product_id", F.col("selling_price").alias("latest_price"), F.col("mrp").alias("latest_mrp"),
        discount_pct(F.col("selling_price"), F.col("mrp")).alias("latest_discount"),
        "review_count", "average_rating", "competitor_count", "product_cost", "total_cost", "is_reliable", "economics_notes",
    )
    details = details.join(searched, "product_id", "left") if searched is not None else details.withColumn("search_term", F.lit(None).cast("string"))
    return top, details, serve.pain_summary(few.pain_points)
