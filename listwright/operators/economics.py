"""Fee schedules and unit economics.

The schedule in force is worked out on the fee dimension alone: one row per marketplace and
category with all its fees as an array. A product then needs one equi join for its own category
and one for the marketplace default, and its row is never multiplied.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed import COST_FIELDS, GATEWAY_FEE_TYPE, PERCENTAGE_FEE_TYPES
from listwright.functions.numbers import half_up

def fee_schedule(fees: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """(category fees, marketplace defaults) in force on ``as_of``: one array per key, newest row per fee type."""
    order = F.struct("effective_date", -F.col("fee_id"))
    payload = F.struct("fee_value", "source", "effective_date")
    live = fees.where(F.col("effective_date") <= F.lit(as_of))
    best = live.groupBy("marketplace", "category", "fee_type").agg(F.max_by(payload, order).alias("f"))
    rows = best.select("marketplace", "category", F.struct("fee_type", "f.*", "category").alias("fee"))
    is_default = F.col("category") == "default"
    own = rows.where(~is_default).groupBy("marketplace", "category").agg(F.collect_list("fee").alias("_own"))
    return own, rows.where(is_default).groupBy("marketplace").agg(F.collect_list("fee").alias("_default"))


def with_fees(products: DataFrame, fees: DataFrame, as_of: dt.date) -> DataFrame:
    """Adds ``fees``: the rows in force, sorted by type, with ``amount`` at the product's selling price.

    Per fee type a row of the product's category beats the default, even a newer one.
    """
    own, default = fee_schedule(fees, as_of)
    # One row per marketplace; the category schedule's size decides at run time whether it is broadcast.
    joined = products.join(own, ["marketplace", "category"], "left").join(F.broadcast(default), "marketplace", "left")
    none = F.array().cast(own.schema["_own"].dataType)
    specific, general = F.coalesce("_own", none), F.coalesce("_default", none)
    inherited = F.filter(general, lambda d: ~F.exists(specific, lambda o: o["fee_type"] == d["fee_type"]))
    chosen = F.array_sort(F.concat(specific, inherited))

    def priced(f: Column) -> Column:
        pct = f["fee_type"].isin(PERCENTAGE_FEE_TYPES)
        amount = half_up(F.when(pct, F.col("selling_price") * f["fee_value"] / 100.0).otherwise(f["fee_value"]))
        return F.struct(
            f["fee_type"].alias("fee_type"), F.when(pct, f["fee_value"]).alias("percentage"), amount.alias("amount"),
            f["source"].alias("source"), f["effective_date"].alias("effective_date"), f["category"].alias("category"),
        )

    priced_fees = F.when(F.col("selling_price").isNotNull(), F.transform(chosen, priced))
    return joined.withColumn("fees", priced_fees).drop("_own", "_default")


def _fee_sum(keep) -> Column:
    amounts = F.transform(F.filter("fees", keep), lambda f: f["amount"])
    return F.when(F.size(amounts) > 0, half_up(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)))


def with_economics(products: DataFrame) -> DataFrame:
    """Adds the cost stack, profit, margin and ROI; all NULL unless the selling price is positive.

    Needs ``selling_price``, ``fees`` and the cost columns with ``marketplace_fee_override``. A
    missing cost counts as zero but is listed; without a product cost the result is not reliable.
    """
    df = products.withColumn(
        "marketplace_fee", F.coalesce("marketplace_fee_override", _fee_sum(lambda f: f["fee_type"] != GATEWAY_FEE_TYPE))
    ).withColumn("payment_fee", F.coalesce("payment_fee", _fee_sum(lambda f: f["fee_type"] == GATEWAY_FEE_TYPE)))

    price = F.col("selling_price")
    sold = price > 0
    parts = {c: half_up(F.coalesce(F.col(c), F.lit(0.0))) for c, _ in COST_FIELDS}
    total = F.lit(0.0)
    for c, _ in COST_FIELDS:
        total = total + parts[c]
    landed = parts["product_cost"] + parts["shipping_cost"] + parts["packaging_cost"]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in COST_FIELDS]), lambda n: n.isNotNull())

    df = df.withColumns({
        "cost_breakdown": F.when(sold, F.struct(*[parts[c].alias(c) for c, _ in COST_FIELDS])),
        "missing_costs": F.when(sold, missing),
        "total_cost": F.when(sold, half_up(total)),
        "landed_cost": F.when(sold, half_up(landed)),
        "is_reliable": F.when(sold, F.col("product_cost").isNotNull()),
    })
    df = df.withColumn("profit", half_up(price - F.col("total_cost")))
    positive = F.when(sold, price)
    notes = F.array(
        F.when(F.col("product_cost").isNull(), F.lit("No supplier/product cost on record — profit is not meaningful until one is supplied.")),
        F.when(F.size("missing_costs") > 0, F.concat(F.lit("Treated as zero because no value was collected: "), F.array_join("missing_costs", ", "), F.lit("."))),
        F.when((F.size("fees") == 0) & F.col("marketplace_fee").isNull(), F.lit("No marketplace fee schedule matched this marketplace/category.")),
    )
    return df.withColumns({
        "margin_pct": half_up(F.col("profit") / positive * 100.0),
        "roi_pct": half_up(F.col("profit") / F.when(F.col("landed_cost") > 0, F.col("landed_cost")) * 100.0),
        "economics_notes": F.when(sold, F.filter(notes, lambda n: n.isNotNull())),
    })


def fee_rows(products: DataFrame) -> DataFrame:
    """Applied fees in long form."""
    return products.select("product_id", F.explode("fees").alias("f")).select("product_id", "f.*")
