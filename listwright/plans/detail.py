"""Everything on file about a few requested products."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.operators import serve
from listwright.operators.history import newest_first
from listwright.plans import rescore


@dataclass
class Detail:
    """``product`` has one row per product: its record, newest values, cost stack, fees and stored score. Histories are numbered from the newest row."""

    product: DataFrame
    provenance: DataFrame
    sources: DataFrame
    prices: DataFrame
    metrics: DataFrame
    costs: DataFrame
    pain_points: DataFrame


def product_detail(cat: rescore.Catalog, scores: DataFrame, ids: DataFrame, as_of: dt.date) -> Detail:
    """Details of the requested products (``ids``: at most a page); every table is cut to them before anything is aggregated."""
    few = rescore.restricted(cat, ids)
    order = cat.order()
    score = serve.only(scores, ids)
    score = score.select("product_id", F.struct(*[c for c in score.columns if c != "product_id"]).alias("score"))
    history = lambda rows: newest_first(rows, "product_id", order)
    return Detail(
        product=rescore.economics(few, as_of).join(score, "product_id", "left"),
        provenance=serve.provenance(few.products, few.prices, few.metrics, few.costs, few.pain_points, order),
        sources=serve.data_sources(few.products, few.pain_points),
        prices=history(few.prices), metrics=history(few.metrics), costs=history(few.costs), pain_points=few.pain_points,
    )


def compare(cat: rescore.Catalog, scores: DataFrame, ids: DataFrame, as_of: dt.date) -> DataFrame:
    """The detail rows of up to five products side by side, in the order of the request."""
    return ids.join(product_detail(cat, scores, ids, as_of).product, "product_id")
