"""Scan of price-tracker dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.sources.landing import numbered

_SIZES = ", ".join(f"{kind}{side} bigint" for kind in ("package", "item") for side in ("Length", "Width", "Height", "Weight"))
PRODUCT = f"""
  asin string, domainId int, productType int, title string, brand string, manufacturer string,
  csv array<array<bigint>>,
  stats struct<current:array<bigint>,avg:array<bigint>,avg30:array<bigint>,avg90:array<bigint>,avg180:array<bigint>,avg365:array<bigint>,
    min:array<array<bigint>>,max:array<array<bigint>>,buyBoxPrice:bigint,buyBoxShipping:bigint,buyBoxIsFBA:boolean,
    salesRankDrops30:bigint,salesRankDrops90:bigint,salesRankDrops180:bigint,salesRankDrops365:bigint,
    outOfStockPercentage30:bigint,outOfStockPercentage90:bigint>,
  images array<struct<l:string,m:string,lH:bigint,lW:bigint>>, imagesCSV string, categories array<bigint>,
  categoryTree array<struct<catId:bigint,name:string>>, rootCategory bigint, salesRanks map<string,array<bigint>>,
  salesRankReference bigint, availabilityAmazon int, lastUpdate bigint, lastPriceChange bigint, {_SIZES},
  features array<string>, description string, color string, size string, variations array<struct<asin:string>>"""


def _as_struct_fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


def envelope_schema() -> str:
    return (
        "timestamp bigint, tokensLeft bigint, refillIn bigint, refillRate bigint, tokensConsumed bigint, tokenFlowReduction double, "
        f"processingTimeInMs bigint, products array<{_as_struct_fields(PRODUCT)}>, error struct<type:string,message:string>"
    )


def read_dump(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Response envelopes -> one row per product object, numbered over the dump, with its position in the response."""
    rows = spark.read.schema(envelope_schema()).option("multiLine", multi_line).json(path)
    objects = rows.select(F.posexplode("products").alias("_pos", "p"), "_metadata")
    return numbered(objects.select((F.col("_pos") + 1).cast("long").alias("position"), "p.*", "_metadata"), first=1).drop("file", "line_no")
