"""Ranked product lists: filters, order, page, rank numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.skew import ranked

SORTABLE = {
    "finalScore": "final_score",
    "profitMarginPercentage": "profit_margin_percentage",
    "demandScore": "demand_score",
    "riskScore": "risk_score",
    "sellingPrice": "selling_price",
}
ROW_COLUMNS = [
    "product_id", "name", "url", "marketplace", "category", "brand", "selling_price",
    "estimated_landed_cost", "profit_per_unit", "profit_margin_percentage", "demand_score",
    "competition_opportunity_score", "differentiation_score", "shipping_simplicity_score",
    "customer_pain_opportunity_score", "bundle_expansion_score", "risk_score", "risk_reasons",
    "final_score", "classification", "data_completeness", "dataset_status", "score_status",
    "missing_critical_fields", "source_name", "source_url", "collected_at", "computed_at",
]


@dataclass(frozen=True)
class ProductQuery:
    category: tuple[str, ...] = ()
    marketplace: tuple[str, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    margin_min: float | None = None
    demand_min: float | None = None
    competition_opportunity_min: float | None = None
    differentiation_min: float | None = None
    risk_max: float | None = None
    score_min: float | None = None
    classification: str | None = None
    search: str | None = None
    dataset_status: tuple[str, ...] = ()
    exclude_sample_data: bool = False
    score_status: str | None = None
    verified_only: bool = False
    sort_by: str | None = None
    sort_direction: str | None = None
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        for name in ("demand_min", "competition_opportunity_min", "differentiation_min", "risk_max", "score_min"):
            value = getattr(self, name)
            if value is not None and not 0 <= value <= 100:
                raise ValueError(f"{name} must be between 0 and 100")
        if not 1 <= self.limit <= 500:
            raise ValueError("limit must be between 1 and 500")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        if self.classification not in (None, "A", "B", "C"):
            raise ValueError("classification must be A, B or C")
        if self.score_status not in (None, "COMPLETE", "INCOMPLETE"):
            raise ValueError("score_status must be COMPLETE or INCOMPLETE")
        if not set(self.dataset_status) <= {"SAMPLE", "UNVERIFIED", "VERIFIED"}:
            raise ValueError("unknown dataset_status")


def rank_base(products: DataFrame, scores: DataFrame, marketplaces: DataFrame, sources: DataFrame) -> DataFrame:
    """Product with its score, marketplace name and data source; ``marketplace_slug`` stays for filters."""
    names = marketplaces.select(F.col("slug").alias("marketplace"), "marketplace_name")
    origin = sources.select("data_source_id", F.col("name").alias("_source"))
    joined = products.join(scores, "product_id", "left").join(names, "marketplace", "left").join(origin, "data_source_id", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumns({
        "marketplace_slug": F.col("marketplace"),
        "marketplace": F.coalesce("marketplace_name", "marketplace"),
        "source_name": F.coalesce("source_name", "_source", F.lit("unknown")),
        "risk_reasons": F.coalesce("risk_reasons", empty),
        "missing_critical_fields": F.coalesce("missing_critical_fields", empty),
    }).select(*ROW_COLUMNS, "marketplace_slug")


def filtered(base: DataFrame, q: ProductQuery) -> DataFrame:
    c = F.col
    conditions: list[Column] = []
    if q.category:
        conditions.append(c("category").isin(*q.category))
    if q.marketplace:
        conditions.append(c("marketplace_slug").isin(*q.marketplace))
    at_least = {
        "selling_price": q.price_min, "profit_margin_percentage": q.margin_min, "demand_score": q.demand_min,
        "competition_opportunity_score": q.competition_opportunity_min,
        "differentiation_score": q.differentiation_min, "final_score": q.score_min,
    }
    conditions += [c(name) >= float(v) for name, v in at_least.items() if v is not None]
    conditions += [c(name) <= float(v) for name, v in {"selling_price": q.price_max, "risk_score": q.risk_max}.items() if v is not None]
    if q.classification:
        conditions.append(c("classification") == q.classification)
    if q.search:
        conditions.append(c("name").ilike(f"%{q.search}%") | c("brand").ilike(f"%{q.search}%"))
    if q.dataset_status:
        conditions.append(c("dataset_status").isin(*q.dataset_status))
    if q.exclude_sample_data or q.verified_only:
        conditions.append(c("dataset_status") != "SAMPLE")
    if q.score_status:
        conditions.append(c("score_status") == q.score_status)
    if q.verified_only:
        conditions += [c("score_status") == "COMPLETE", c("final_score").isNotNull()]
    for condition in conditions:
        base = base.where(condition)
    return base


def _order(q: ProductQuery) -> list[Column]:
    column = F.col(SORTABLE.get(q.sort_by or "finalScore", "final_score"))
    first = column.asc_nulls_last() if q.sort_direction == "ASC" else column.desc_nulls_last()
    return [first, F.col("name").asc(), F.col("product_id").asc()]


#: Rows a task keeps to serve a page; pages further down are cut out by ranges of the sort column.
PAGE_HEAP = 10_000
_CUTS = 64


def page(base: DataFrame, q: ProductQuery, heap: int = PAGE_HEAP) -> DataFrame:
    """One page with rank numbers.

    Up to ``heap`` rows from the top the first rows are kept by every task. Further down the sort column's quantiles cut
    the rows into ranges, one aggregate counts them, and only the ranges that hold the page are sorted and numbered.
    """
    order, rows, end = _order(q), filtered(base, q), q.offset + q.limit
    rank = F.col("rank")
    on_page = (rank > q.offset) & (rank <= end)
    if end <= heap:
        top = rows.orderBy(*order).limit(end)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).where(on_page)
    column = F.col(SORTABLE.get(q.sort_by or "finalScore", "final_score"))
    cuts = rows.agg(F.percentile_approx(column, [i / _CUTS for i in range(1, _CUTS)], 10_000)).first()[0] or []
    edges = sorted(set(cuts))
    above = F.lit(0)
    for edge in edges:
        above = above + (column > F.lit(edge)).cast("int")
    # Ranges in the order of the page; rows without a value are the last one.
    place = above if q.sort_direction == "ASC" else F.lit(len(edges)) - above
    place = F.when(column.isNull(), F.lit(len(edges) + 1)).otherwise(place)
    counts = {r["place"]: r["n"] for r in rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, ahead, passed = [], None, 0
    for at in sorted(counts):
        if passed < end and passed + counts[at] > q.offset:
            held.append(at)
            ahead = passed if ahead is None else ahead
        passed += counts[at]
    part = rows.where(place.isin(*held)) if held else rows.limit(0)
    return ranked(part, order, "rank").withColumn("rank", (rank + (ahead or 0)).cast("long")).where(on_page)


def total(base: DataFrame, q: ProductQuery) -> DataFrame:
    return filtered(base, q).agg(F.count(F.lit(1)).alias("total"))


def all_ranked(base: DataFrame, q: ProductQuery) -> DataFrame:
    """Every matching row by final score, numbered across range partitions (the export order)."""
    order = [F.col("final_score").desc_nulls_last(), F.col("name").asc(), F.col("product_id").asc()]
    return ranked(filtered(base, q), order, "rank").withColumn("rank", F.col("rank").cast("long"))
