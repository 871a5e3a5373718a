"""Matching a batch with the stored products, and the tables that follow from the match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import product_key
from listwright.operators.standardize import LISTING_COLUMNS

PRODUCT_COLUMNS = [
    c for c in LISTING_COLUMNS
    if c not in ("record_no", "selling_price", "mrp", "discount_percentage", "currency", "review_count", "average_rating", "competitor_count",
                 "seller_count", "best_seller_rank", "search_term", "costs", "pain_points")
] + ["verification_notes"]


KEY_KINDS = ("external_id", "url", "normalized_name")


def key_entries(rows: DataFrame, *carried: str) -> DataFrame:
    """One row per key a product or listing can be found under: slot (hash of the key), marketplace, kind, key and ``carried`` columns."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KEY_KINDS])
    some = rows.where("marketplace IS NOT NULL").select("marketplace", F.explode(keys).alias("k"), *carried).where("k.key <> ''")
    return some.select(F.xxhash64("marketplace", "k.kind", "k.key").alias("slot"), "marketplace", "k.*", *carried)


def product_entries(products: DataFrame) -> DataFrame:
    """The index rows of products."""
    named = products.withColumn("sample", F.col("dataset_status").eqNullSafe("SAMPLE"))
    return key_entries(named, "product_id", "sample").withColumn("live", F.lit(True))


def changed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """Index rows of products whose record became another: the new entries, and the old ones that no longer hold as withdrawn."""
    now = product_entries(after)
    gone = product_entries(before).join(now, ["slot", "marketplace", "kind", "key", "product_id"], "left_anti")
    return now.unionByName(gone.withColumn("live", F.lit(False)))


def match_by(batch: DataFrame, entries: DataFrame, exclude_sample: bool = False) -> DataFrame:
    """Adds ``existing_id``: the product by external id, else by URL, else by name, of index rows ``entries``; the lowest id where a key has
    several products.

    Only entries that a row of the batch asks for are aggregated, and once per key, so neither a key that many products share
    nor one that many rows ask for multiplies rows.
    """
    asked = key_entries(batch, "record_no")
    on = ["slot", "marketplace", "kind", "key"]
    usable = entries.where("live AND NOT sample" if exclude_sample else "live")
    found = usable.join(asked.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.min("product_id").alias("product_id"))
    by = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("product_id"))).alias(f"by_{kind}")
    hits = asked.join(found, on).groupBy("record_no").agg(*[by(k) for k in KEY_KINDS])
    joined = batch.join(hits, "record_no", "left")
    return joined.withColumn("existing_id", F.coalesce("by_external_id", "by_url", "by_normalized_name"))


def match(batch: DataFrame, products: DataFrame, exclude_sample: bool = False) -> DataFrame:
    """``match_by`` over the entries of products at hand, where there is no stored index."""
    return match_by(batch, product_entries(products), exclude_sample)


def resolve(found: DataFrame) -> DataFrame:
    """Adds ``product_id``, ``is_new`` and ``conflict`` to a deduplicated batch that was matched.

    Matching is against the products as they were before the batch. Rows that match nothing share
    the product of the first row of the batch with their URL; that row creates it unless it
    matched. A row whose URL belongs to another product, stored or of an earlier row, conflicts.
    """
    owner = found.withColumn("_id", F.coalesce("existing_id", product_key(F.col("identity_key"))))
    heads = owner.groupBy("marketplace", "url").agg(F.min_by(F.struct("_id", "record_no", "existing_id"), "record_no").alias("_head"))
    joined = found.join(heads, ["marketplace", "url"])
    head = F.col("_head")
    df = joined.withColumns({
        "product_id": F.coalesce("existing_id", head["_id"]),
        "is_new": F.col("existing_id").isNull() & head["existing_id"].isNull() & (head["record_no"] == F.col("record_no")),
    })
    taken = (F.col("by_url").isNotNull() & (F.col("by_url") != F.col("product_id"))) | (head["_id"] != F.col("product_id"))
    return df.withColumn("conflict", F.coalesce(taken, F.lit(False))).drop("_head", "by_external_id", "by_url", "by_normalized_name")


def snapshot(products: DataFrame | None, resolved: DataFrame) -> DataFrame:
    """Products after the batch: the last record of a product overwrites every column, also with NULL. Without ``products`` only
    those the batch changed."""
    last = resolved.groupBy("product_id").agg(F.max_by(F.struct(*PRODUCT_COLUMNS), "record_no").alias("r")).select("product_id", "r.*")
    if products is None:
        return last
    untouched = products.join(last.select("product_id"), "product_id", "left_anti")
    return untouched.select("product_id", *PRODUCT_COLUMNS).unionByName(last)


def replace_by_key(stored: DataFrame, incoming: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows of an incoming key replace all its stored rows; keys without incoming rows keep theirs."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def pain_point_rows(resolved: DataFrame) -> DataFrame:
    """Pain points of the last record per product that has any."""
    some = resolved.where(F.size("pain_points") > 0)
    last = some.groupBy("product_id").agg(F.max_by(F.struct("pain_points", "collected_at"), "record_no").alias("r"))
    return last.select("product_id", F.col("r.collected_at").alias("collected_at"), F.explode("r.pain_points").alias("p")).select("product_id", "p.*", "collected_at")


def ledger_rows(resolved: DataFrame, run_id: Column) -> DataFrame:
    """One provenance row per supplied field."""
    return resolved.select(
        "product_id", "record_no", F.explode("observations").alias("o"), "source_name", "source_url",
        F.col("collected_at").alias("observed_at"), "confidence_score", run_id.alias("run_id"),
    ).select("product_id", "record_no", "o.*", "source_name", "source_url", "observed_at", "confidence_score", "run_id")
