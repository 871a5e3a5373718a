"""Jobs that repair stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import match_name, trimmed
from listwright.functions.urls import is_non_attributable, is_placeholder_url

REGATED = "The stored VERIFIED claim was withdrawn: its source or its address cannot be traced."
SEEDED = "Rows of the seed source are samples and cannot be VERIFIED."


def regate(products: DataFrame) -> DataFrame:
    """Applies the URL and source rules to stored VERIFIED rows; seed rows become SAMPLE."""
    c = F.col
    verified = c("dataset_status") == "VERIFIED"
    seed = verified & (F.lower(trimmed(c("source_name"))) == "seed_demo_data")
    doubtful = verified & (is_placeholder_url(c("url")) | is_placeholder_url(c("source_url")) | is_non_attributable(c("source_name")))
    return products.withColumns({
        "dataset_status": F.when(seed, "SAMPLE").when(doubtful, "UNVERIFIED").otherwise(c("dataset_status")),
        "verification_notes": F.when(seed, F.array(F.lit(SEEDED))).when(doubtful, F.array(F.lit(REGATED))).otherwise(c("verification_notes")),
    })


def backfill(products: DataFrame, sources: DataFrame) -> DataFrame:
    """Fills names, sources and statuses of rows stored before those columns existed; renames PROVISIONAL."""
    c = F.col
    named = sources.select("data_source_id", c("name").alias("_source"))
    status = F.coalesce("dataset_status", F.when(c("is_sample_data"), "SAMPLE").otherwise("UNVERIFIED"))
    return products.join(named, "data_source_id", "left").withColumns({
        "normalized_name": F.coalesce(c("normalized_name"), match_name(c("name"))),
        "source_name": F.coalesce("source_name", "_source", F.lit("unknown")),
        "dataset_status": F.when(status == "PROVISIONAL", "UNVERIFIED").otherwise(status),
    }).drop("_source", "is_sample_data")


def withhold_ungated(scores: DataFrame) -> DataFrame:
    """Scores computed before the critical-field gate lose their headline number and class."""
    return scores.withColumns({
        "score_status": F.lit("INCOMPLETE"), "final_score": F.lit(None).cast("double"), "classification": F.lit(None).cast("string"),
    })
