"""Golden tracker mapping and the export file."""

import glob
import json

from pyspark.sql import functions as F

from listwright.fixed import EXPORT_COLUMNS
from listwright.functions.text import iso
from listwright.operators import tracker
from listwright.sources import export
from listwright.sources.tracker import read_dump

COMPLETE = {
    "asin": "B0TESTBOX1", "productType": 0, "title": "Folding  crate", "brand": "Stakk",
    "csv": [[7101000, 92500, 7101700, -1, 7102400, 84900], None, None, [7101000, 6010, 7102400, 5321, 7]] + [None] * 12 + [[7101000, 90, 7102400, 43], [7101000, 90, 7102400, 217]],
    "stats": {"current": [84900, 83500, -1, 5321, 129900, -1, -1, -1, -1, -1, -1, 8, 0, -1, -1, -1, 43, 217, 84900], "buyBoxPrice": 84900, "buyBoxShipping": -2, "buyBoxIsFBA": True},
    "images": [{"l": "I1.jpg", "m": "x"}], "categories": [1, 2], "categoryTree": [{"catId": 1, "name": "Root"}, {"catId": 2, "name": "Leaf"}], "availabilityAmazon": 0, "lastUpdate": 7102400,
    "packageLength": 410, "packageWidth": 260, "packageHeight": 75, "packageWeight": 640,
}
NO_PRICE = {"asin": "B0TESTBOX2", "csv": [None, None, None, [7100500, 4120]], "stats": {"current": [-1, -1], "buyBoxPrice": -1}, "availabilityAmazon": 9}
INVALID = {"asin": "B0TESTBOX3", "productType": 4}


def _mapped(spark, tmp_path, *objects):
    (tmp_path / "dump.json").write_text(json.dumps({"tokensLeft": 3, "products": list(objects)}, indent=1))
    dump = read_dump(spark, str(tmp_path / "dump.json"))
    return dump, tracker.map_dump(dump, "home-organization", F.to_timestamp(F.lit("2026-09-29 12:00:00"))).orderBy("record_no").collect()


def test_mapping(spark, tmp_path):
    no_box = {**COMPLETE, "stats": {**COMPLETE["stats"], "buyBoxPrice": -1, "current": [-1, 83500] + COMPLETE["stats"]["current"][2:]}}
    dump, (full, no_price, invalid, fallback) = _mapped(spark, tmp_path, COMPLETE, NO_PRICE, INVALID, no_box)
    assert (full.selling_price, full.mrp, full.average_rating, full.review_count, full.best_seller_rank, full.competitor_count, full.weight_kg) == (849, 1299, 4.3, 217, 5321, 8, 0.64)
    assert tuple(full.dimensions) == (41, 26, 7.5) and full.url == "https://amazon.in/dp/B0TESTBOX1" and full.source_url == "https://www.amazon.in/dp/B0TESTBOX1"
    assert full.costs is None and full.dataset_status == "UNVERIFIED" and full.subcategory == "Leaf" and full.name == "Folding crate" and full.unusable_reasons == []
    fields = {f.field: f for f in full.fields}
    assert fields["availability"].value == "in stock" and fields["keepa_last_update"].value == "2024-07-03T05:20:00.000Z" and fields["images"].value.endswith("/I/I1.jpg")
    assert fields["buy_box_shipping"].value is None and fields["observed_price"].origin == "CALCULATED" and "(used: buy box)" in fields["observed_price"].derivation
    assert no_price.selling_price is None and "no current price" in no_price.unusable_reasons[0] and no_price.best_seller_rank == 4120
    assert {f.field: f.value for f in no_price.fields}["availability"] == "code 9"
    assert "INVALID" in invalid.unusable_reasons[0] and fallback.selling_price == 835 and "lowest marketplace New" in fallback.notes[0]


def test_history(spark, tmp_path):
    dump, _ = _mapped(spark, tmp_path, COMPLETE)
    rows = tracker.history(dump).select("series", "position", iso(F.col("at")).alias("at"), "value").collect()
    amazon = sorted((r.position, r.value) for r in rows if r.series == "AMAZON")
    assert amazon == [(0, 925.0), (1, 849.0)]
    assert [r.value for r in rows if r.series == "RATING"] == [4.3] and sorted(r.value for r in rows if r.series == "SALES_RANK") == [5321, 6010]
    assert {r.at for r in rows if r.value == 849.0 and r.series == "AMAZON"} == {"2024-07-03T05:20:00.000Z"}
    short = dump.withColumn("csv", F.array(F.array(F.lit(7100000).cast("long")), F.array().cast("array<bigint>")))
    assert tracker.history(short).count() == 0


def test_csv_export(spark, tmp_path):
    kinds = {c: "string" for c, _ in EXPORT_COLUMNS} | {"rank": "long", "price": "double", "final_score": "double"}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    row = {c: None for c in kinds} | {"rank": 1, "product": 'Box, "large"', "price": 899.0, "missing_critical_fields": "None", "url": ""}
    export.write_csv(spark.createDataFrame([tuple(row.values())], schema).coalesce(1), str(tmp_path / "one"))
    (part,) = glob.glob(str(tmp_path / "one" / "*.csv"))
    content = open(part, newline="").read()
    header, line, rest = content.split("\r\n")
    assert header.split(",")[5] == "Price (INR)" and len(header.split(",")) == 24 and rest == ""
    assert line.startswith('1,"Box, ""large""",,Data unavailable,Data unavailable,899,Data unavailable')
    export.write_csv(spark.createDataFrame([], schema).coalesce(1), str(tmp_path / "none"))
    (part,) = glob.glob(str(tmp_path / "none" / "*.csv"))
    assert open(part).read().startswith("Rank,Product,URL")


def test_export_parts_follow_the_rank(spark, tmp_path):
    ranks = [(i * 37) % 400 + 1 for i in range(400)]
    rows = spark.createDataFrame([(r, *[None] * (len(EXPORT_COLUMNS) - 1)) for r in ranks], ", ".join(f"`{c}` {'long' if c == 'rank' else 'string'}" for c, _ in EXPORT_COLUMNS)).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_csv(rows, str(tmp_path / "export"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "export").glob("part-*"))
    lines = [int(line.split(",")[0].strip('"')) for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and lines == list(range(1, 401))
