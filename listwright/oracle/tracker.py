"""Oracle SQL for the price-tracker queries."""

from __future__ import annotations

from listwright import binding_tracker as made
from listwright.fixed import TRACKER_AVAILABILITY, TRACKER_EPOCH_MINUTES, TRACKER_IMAGE_PREFIX, TRACKER_PAGE_PREFIX, TRACKER_SERIES
from listwright.oracle.base import iso, num, quote, with_ctes

_NAMES = {i: n for n, i in TRACKER_SERIES.items()}
_TIME = lambda m: f"make_timestamp(CAST(({m} + {TRACKER_EPOCH_MINUTES}) AS BIGINT) * 60000000)"


def _points(series: int, most: int) -> str:
    t = "CASE WHEN (p_partkey + i) % 11 = 0 THEN 0 ELSE 7000000 + p_partkey * 3 + i * 60 END"
    v = f"CASE WHEN (p_partkey + i + {series}) % 5 = 0 THEN -1 WHEN (p_partkey + i) % 13 = 0 THEN -2 ELSE (p_partkey * 37 + i * 101 + {series} * 13) % {70 if series == 16 else 5000} END"
    value = {0: "v / 100.0", 1: "v / 100.0", 16: "CASE WHEN v <= 50 THEN floor(v / 10.0 * 100 + 0.5) / 100 END"}.get(series, "CAST(v AS DOUBLE)")
    return f"""SELECT part, '{_NAMES[series]}' AS series, row_number() OVER (PARTITION BY part ORDER BY i) - 1 AS position, seen, value FROM (
      SELECT p_partkey AS part, i, {_TIME('t')} AS seen, {value} AS value, t, v FROM (
        SELECT p_partkey, i, {t} AS t, {v} AS v FROM (SELECT p_partkey, unnest(range(0, p_partkey % {most + 1})) AS i FROM part WHERE p_partkey % 14 <> 0))) WHERE t > 0 AND v >= 0 AND value IS NOT NULL"""


_CURRENT = lambda i: f"CASE WHEN {i} <= CASE WHEN p_partkey % 8 = 0 THEN 11 ELSE 18 END THEN CASE WHEN (p_partkey + {i}) % 4 = 0 THEN -1 ELSE (p_partkey * {i + 1} * 7) % {60 if i == 16 else 9000} END END"
_PRICE = lambda raw: f"CASE WHEN ({raw}) >= 0 THEN ({raw}) / 100.0 END"
_COUNT = lambda raw: f"CASE WHEN ({raw}) >= 0 THEN CAST(({raw}) AS DOUBLE) END"
_CM = lambda raw: f"CASE WHEN ({raw}) > 0 THEN floor(({raw}) / 10.0 * 100 + 0.5) / 100 END"
_KG = lambda raw: f"CASE WHEN ({raw}) > 0 THEN floor(({raw}) / 1000.0 * 1000 + 0.5) / 1000 END"

EXTRA = {
    "points": " UNION ALL ".join(_points(s, n) for s, n in made.FILLED.items()),
    "cells": "SELECT p_partkey AS record_no, p_partkey, p_type, " + ", ".join(f"{e} AS {n}" for n, e in {**made.CELLS, **made.STATS}.items())
        + f", {made.FBA} AS fba, " + ", ".join(f"{_CURRENT(i)} AS cur{i}" for i in (0, 1, 3, 4, 11, 12, 16, 17, 18)) + " FROM part",
    "last_points": "SELECT part, series, max_by(value, position) AS v FROM points GROUP BY ALL",
    "vals": f"""SELECT *, CASE WHEN asin <> '' THEN asin END AS id, trim(regexp_replace(title, ' +', ' ', 'g')) AS shown, coalesce(brand, manufacturer) AS maker,
      {_PRICE('buyBoxPrice')} AS buy_box, {_PRICE('cur0')} AS amazon, {_PRICE('cur1')} AS fresh, {_PRICE('cur4')} AS list_price, {_PRICE('cur18')} AS with_shipping,
      coalesce(lr.v, CASE WHEN cur16 BETWEEN 0 AND 50 THEN floor(cur16 / 10.0 * 100 + 0.5) / 100 END) AS rating, coalesce(lc.v, {_COUNT('cur17')}) AS reviews, coalesce(ls.v, {_COUNT('cur3')}) AS sales_rank,
      {_COUNT('cur11')} AS new_offers, {_COUNT('cur12')} AS used_offers, coalesce({_KG('packageWeight')}, {_KG('itemWeight')}) AS kg,
      {_CM('coalesce(packageLength, itemLength)')} AS l_cm, {_CM('coalesce(packageWidth, itemWidth)')} AS w_cm, {_CM('coalesce(packageHeight, itemHeight)')} AS h_cm,
      CASE WHEN p_partkey % 4 = 0 THEN ['a.jpg', 'b' || p_partkey || '.jpg'] WHEN p_partkey % 4 = 1 THEN ['x' || p_partkey, 'z'] ELSE [] END AS images
      FROM cells LEFT JOIN last_points lr ON lr.part = record_no AND lr.series = 'RATING' LEFT JOIN last_points lc ON lc.part = record_no AND lc.series = 'COUNT_REVIEWS'
      LEFT JOIN last_points ls ON ls.part = record_no AND ls.series = 'SALES_RANK'""",
    "mapped": f"""SELECT *, coalesce(buy_box, amazon, fresh) AS price, l_cm IS NOT NULL AND w_cm IS NOT NULL AND h_cm IS NOT NULL AS has_dims,
      CASE WHEN buy_box IS NOT NULL THEN 'buy box' WHEN amazon IS NOT NULL THEN 'Amazon offer' WHEN fresh IS NOT NULL THEN 'lowest marketplace New' ELSE 'none' END AS basis,
      CASE WHEN list_price > 0 AND coalesce(buy_box, amazon, fresh) <= list_price THEN floor((list_price - coalesce(buy_box, amazon, fresh)) / list_price * 10000.0 + 0.5) / 100.0 END AS discount,
      list_transform(images, lambda n: '{TRACKER_IMAGE_PREFIX}' || n) AS image_urls,
      list_filter([CASE WHEN productType = 4 THEN 'Keepa productType=4 (INVALID): no reliable data for this ASIN' END, CASE WHEN productType = 3 THEN 'Keepa productType=3 (INACCESSIBLE): product data is not retrievable' END,
        CASE WHEN id IS NULL THEN 'no ASIN on the Keepa product object' END,
        CASE WHEN coalesce(buy_box, amazon, fresh) IS NULL THEN 'no current price available from Keepa (buy box, Amazon and marketplace New all absent)' END], lambda x: x IS NOT NULL) AS bad
      FROM vals""",
}
_AVAILABILITY = "CASE availabilityAmazon " + " ".join(f"WHEN {c} THEN {quote(l)}" for c, l in TRACKER_AVAILABILITY.items()) + " ELSE 'code ' || availabilityAmazon END"
_S = "OBSERVED"
_FIELDS = [
    ("source_product_id", "id", None, _S), ("product_name", "title", None, _S), ("brand", "maker", None, _S), ("buy_box_price", None, "buy_box", _S),
    ("buy_box_shipping", None, _PRICE("buyBoxShipping"), _S), ("buy_box_price_with_shipping", None, "with_shipping", _S), ("amazon_price", None, "amazon", _S),
    ("marketplace_new_price", None, "fresh", _S), ("buy_box_is_fba", "CAST(fba AS VARCHAR)", None, _S), ("observed_price", None, "price", "CALCULATED"), ("mrp", None, "list_price", _S),
    ("discount_percentage", None, "discount", "CALCULATED"), ("rating", None, "rating", _S), ("review_count", None, "reviews", _S), ("sales_rank", None, "sales_rank", _S),
    ("sales_rank_drops_30d", None, _COUNT("salesRankDrops30"), _S), ("new_offer_count", None, "new_offers", _S), ("used_offer_count", None, "used_offers", _S),
    ("availability", f"CASE WHEN availabilityAmazon IS NOT NULL THEN {_AVAILABILITY} END", None, _S), ("out_of_stock_percentage_90d", None, _COUNT("outOfStockPercentage90"), _S),
    ("product_weight", None, "kg", _S), ("product_dimensions", f"CASE WHEN has_dims THEN {num('l_cm')} || 'x' || {num('w_cm')} || 'x' || {num('h_cm')} END", None, _S),
    ("images", "nullif(array_to_string(image_urls, '|'), '')", None, _S), ("source_category", "CASE WHEN p_partkey % 6 <> 0 THEN 'Root > ' || p_type END", None, _S),
    ("source_category_ids", "p_partkey || ',' || (p_partkey + 1)", None, _S),
    ("keepa_last_update", f"CASE WHEN lastUpdate > 0 THEN {iso(_TIME('lastUpdate'))} END", None, _S), ("keepa_last_price_change", f"CASE WHEN lastPriceChange > 0 THEN {iso(_TIME('lastPriceChange'))} END", None, _S),
]
EXTRA["field_table"] = " UNION ALL ".join(
    f"SELECT record_no, '{f}' AS field, {s or num(n)} AS value, {f'CAST({n} AS DOUBLE)' if n else 'CAST(NULL AS DOUBLE)'} AS numeric_value, '{o}' AS origin, len(bad) = 0 AS usable FROM mapped" for f, s, n, o in _FIELDS
)


def q(body: str) -> str:
    return with_ctes(body, EXTRA)


SQL = {
    "tracker_history": q(f"SELECT CAST(part AS VARCHAR) AS asin, series, position, {iso('seen')} AS \"at\", value FROM points"),
    "tracker_price_and_rank": q(f"""SELECT CAST(part AS VARCHAR) AS asin, series, count(*) AS points, {iso('min(seen)')} AS first_at, {iso('max(seen)')} AS last_at, max_by(value, position) AS last_value
      FROM points WHERE series IN ('AMAZON', 'SALES_RANK') GROUP BY part, series"""),
    "tracker_dump_scan": q("""SELECT p_partkey AS part, row_number() OVER (ORDER BY p_partkey) AS record_no, 1 AS position, asin, title, 19 AS series, buyBoxPrice AS buy_box, fba AS is_fba,
      CASE WHEN p_partkey % 4 = 0 THEN -1 WHEN p_partkey % 4 = 1 THEN 3 ELSE 0 END AS images, packageLength FROM cells"""),
    "tracker_listings": q(f"""SELECT record_no, shown AS name, coalesce('https://amazon.in/dp/' || id, '') AS url, id AS external_id, maker AS brand, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS subcategory,
      CASE WHEN len(image_urls) > 0 THEN array_to_string(image_urls, '|') END AS image_urls, size AS sizes, nullif(color, '') AS colors, CASE WHEN p_partkey % 9 = 0 THEN 'V' || p_partkey END AS variants,
      CASE WHEN p_partkey % 5 = 0 THEN 'f1|f2' END AS features, kg AS weight_kg, CASE WHEN has_dims THEN l_cm END AS length_cm, CASE WHEN has_dims THEN h_cm END AS height_cm, price AS selling_price,
      list_price AS mrp, discount AS discount_percentage, CAST(reviews AS BIGINT) AS review_count, rating AS average_rating, CAST(new_offers AS BIGINT) AS competitor_count, CAST(sales_rank AS BIGINT) AS best_seller_rank,
      coalesce('{TRACKER_PAGE_PREFIX}' || id, '') AS source_url,
      1 + CASE WHEN productType = 5 THEN 1 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sales_rank IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN new_offers IS NOT NULL THEN 1 ELSE 0 END AS notes FROM mapped"""),
    "tracker_fields": q("SELECT record_no, field, value, numeric_value, origin FROM field_table WHERE value IS NOT NULL"),
    "tracker_ledger": q("SELECT field AS field_name, count(*) AS rows, count(numeric_value) AS numbers FROM field_table WHERE usable AND origin = 'OBSERVED' AND value IS NOT NULL GROUP BY field"),
    "tracker_usable": q("SELECT record_no, id AS identifier, 'INVALID_VALUE' AS code, array_to_string(bad, '; ') AS errors FROM mapped WHERE len(bad) > 0"),
    "tracker_check": q(f"""SELECT record_no, len(bad) = 0 AS usable, CASE WHEN price IS NULL THEN 0 ELSE 1 END + CASE WHEN discount IS NULL THEN 0 ELSE 1 END AS calculated_fields,
      CASE WHEN len(bad) = 0 AND price <= 0 THEN 'INVALID_VALUE' END AS code, CASE WHEN len(bad) = 0 THEN 'UNVERIFIED' END AS if_verified_requested, CASE WHEN len(bad) = 0 THEN true END AS downgraded,
      CASE WHEN len(bad) = 0 THEN 1 + CASE WHEN price <= 0 THEN 1 ELSE 0 END + CASE WHEN reviews IS NULL OR rating IS NULL THEN 1 ELSE 0 END + CASE WHEN new_offers IS NULL THEN 1 ELSE 0 END END AS refusals,
      CASE WHEN len(bad) = 0 AND price > 0 THEN false END AS is_reliable, CAST(NULL AS DOUBLE) AS profit FROM mapped"""),
}
