"""Tracker product objects made up per part, with sentinels, gaps, odd tails and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import binding
from listwright.operators.skew import spread

CATEGORY = "home-organization"
AT = "2026-09-29 12:00:00"
#: index of each filled series and how many points it has at most
FILLED = {0: 7, 1: 3, 3: 6, 16: 5, 17: 4}
#: scalars, in SQL that Spark and DuckDB read alike
CELLS = {
    "asin": "CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN '' ELSE 'B' || p_partkey END",
    "productType": "CASE WHEN p_partkey % 17 = 0 THEN 4 WHEN p_partkey % 19 = 0 THEN 3 WHEN p_partkey % 23 = 0 THEN 5 WHEN p_partkey % 2 = 0 THEN 0 END",
    "title": "p_name || '  ' || p_partkey", "brand": "CASE WHEN p_partkey % 3 <> 0 THEN p_brand END", "manufacturer": "'Maker ' || p_brand",
    "availabilityAmazon": "CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 8 - 1 END",
    "lastUpdate": "CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 7000000 + p_partkey END", "lastPriceChange": "CASE WHEN p_partkey % 4 = 0 THEN 6900000 + p_partkey END",
    "packageLength": "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size * 11 END", "itemLength": "p_size * 9",
    "packageWidth": "p_partkey % 400 + 1", "itemWidth": "p_size", "packageHeight": "CASE WHEN p_partkey % 6 <> 0 THEN p_size END", "itemHeight": "CASE WHEN p_partkey % 12 <> 0 THEN 25 END",
    "packageWeight": "CASE WHEN p_partkey % 6 = 1 THEN -1 WHEN p_partkey % 6 <> 2 THEN p_size * 55 END", "itemWeight": "CASE WHEN p_partkey % 4 <> 2 THEN p_size * 50 END",
    "color": "CASE WHEN p_partkey % 2 = 0 THEN 'red' ELSE '' END", "size": "CASE WHEN p_partkey % 3 = 0 THEN 'L' END",
    "imagesCSV": "CASE WHEN p_partkey % 4 = 0 THEN 'a.jpg, b' || p_partkey || '.jpg,,' END",
}
STATS = {
    "buyBoxPrice": "CASE WHEN p_partkey % 3 = 0 THEN -1 WHEN p_partkey % 5 <> 0 THEN p_partkey * 100 + 99 END",
    "buyBoxShipping": "CASE WHEN p_partkey % 3 = 0 THEN -2 ELSE 0 END", "salesRankDrops30": "p_partkey % 13 - 1", "outOfStockPercentage90": "p_partkey % 101",
}
FBA = "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 2 = 0 END"


def _flat(series: int, most: int) -> str:
    """Spark SQL of one flat [t, v, ...] array."""
    time = f"CASE WHEN (p_partkey + i) % 11 = 0 THEN 0 ELSE 7000000 + p_partkey * 3 + i * 60 END"
    value = f"CASE WHEN (p_partkey + i + {series}) % 5 = 0 THEN -1 WHEN (p_partkey + i) % 13 = 0 THEN -2 ELSE (p_partkey * 37 + i * 101 + {series} * 13) % {70 if series == 16 else 5000} END"
    pairs = f"flatten(transform(sequence(0, {most} - 1), i -> CASE WHEN i < p_partkey % {most + 1} THEN array(CAST({time} AS BIGINT), CAST({value} AS BIGINT)) ELSE array() END))"
    return f"CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE concat({pairs}, CASE WHEN p_partkey % 6 = 0 THEN array(7000000L) ELSE CAST(array() AS ARRAY<BIGINT>) END) END"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv = ", ".join(_flat(i, FILLED[i]) if i in FILLED else "CAST(NULL AS ARRAY<BIGINT>)" for i in range(19))
    current = "transform(sequence(0, CASE WHEN p_partkey % 8 = 0 THEN 11 ELSE 18 END), i -> CAST(CASE WHEN (p_partkey + i) % 4 = 0 THEN -1 ELSE (p_partkey * (i + 1) * 7) % CASE WHEN i = 16 THEN 60 ELSE 9000 END END AS BIGINT))"
    stats = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in STATS.items())
    kinds = {"productType": "INT", "availabilityAmazon": "INT"}
    number = ("lastUpdate", "lastPriceChange") + tuple(n for n in CELLS if n.startswith(("package", "item")))
    cells = [F.expr(f"CAST({e} AS {kinds.get(n, 'BIGINT' if n in number else 'STRING')})").alias(n) for n, e in CELLS.items()]
    return spread(binding.table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("record_no"), *cells,
        F.expr(f"array({csv})").alias("csv"), F.expr(f"struct({current} AS current, {stats}, {FBA} AS buyBoxIsFBA)").alias("stats"),
        F.expr("CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN array(named_struct('l', concat('x', p_partkey), 'm', 'y'), named_struct('l', CAST(NULL AS STRING), 'm', 'z'), named_struct('l', CAST(NULL AS STRING), 'm', '')) ELSE CAST(array() AS ARRAY<STRUCT<l:STRING,m:STRING>>) END").alias("images"),
        F.expr("array(p_partkey, p_partkey + 1)").alias("categories"),
        F.expr("CASE WHEN p_partkey % 6 <> 0 THEN array(named_struct('catId', p_partkey, 'name', 'Root'), named_struct('catId', p_partkey + 1, 'name', p_type)) END").alias("categoryTree"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN array('f1', 'f2') ELSE CAST(array() AS ARRAY<STRING>) END").alias("features"),
        F.lit(None).cast("string").alias("description"), F.expr("CASE WHEN p_partkey % 9 = 0 THEN array(named_struct('asin', concat('V', p_partkey))) END").alias("variations"),
    )
