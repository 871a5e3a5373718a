"""Scoring configuration and the small dimensions, read once on the driver."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.fixed import COMPONENTS

CONF = Path(__file__).parent / "conf"


def check_scoring(cfg: dict) -> dict:
    weights = [cfg["finalScoreWeights"][key] for _, key in COMPONENTS]
    if any(w < 0 for w in weights) or abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError("the seven final score weights must be non-negative and sum to 1")
    span = cfg["profitabilityScore"]
    if span["marginCeilingPct"] == span["marginFloorPct"]:
        raise ValueError("marginCeilingPct must differ from marginFloorPct")
    return cfg


def scoring(path: str | None = None) -> dict:
    return check_scoring(json.loads(Path(path or CONF / "scoring.json").read_text()))


@lru_cache
def dimensions(path: str | None = None) -> dict:
    return json.loads(Path(path or CONF / "dimensions.json").read_text())


def category_slugs() -> list[str]:
    return [row["slug"] for row in dimensions()["categories"]]


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Inline table: Catalyst knows its size, and no Python worker is needed to read it."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def marketplaces(spark: SparkSession) -> DataFrame:
    rows = [(m["slug"], m["name"], m["website_url"]) for m in dimensions()["marketplaces"]]
    return literal_table(spark, rows, ["slug", "marketplace_name", "website_url"])


def fees(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """Fee rows of the configuration file, plus any given ones, with a fee id for stable ties."""
    rows = [
        (f["marketplace"], f["category"], f["feeType"], float(f["value"]), f["source"], f["effectiveDate"])
        for f in dimensions()["fees"]
    ]
    rows += [tuple(r) for r in extra]
    names = ["fee_id", "marketplace", "category", "fee_type", "fee_value", "source", "effective_date"]
    df = literal_table(spark, [(i, *r) for i, r in enumerate(rows, 1)], names)
    return df.withColumns({
        "fee_id": F.col("fee_id").cast("long"), "fee_value": F.col("fee_value").cast("double"), "effective_date": F.to_date("effective_date")
    })
