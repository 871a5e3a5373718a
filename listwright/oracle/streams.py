"""Oracle SQL for the streams: the same end state from the whole tables at once."""

from __future__ import annotations

from listwright.oracle import imports, scoring
from listwright.oracle.base import iso, with_ctes

_NOTHING_STORED = {**imports.EXTRA, "stored_products": f"SELECT * FROM ({imports.EXTRA['stored_products']}) WHERE false"}

SQL = {
    "stream_price_changes": scoring.SQL["price_change_on_arrival"],
    "stream_latest_price": f"""SELECT product_id, arrival, price AS selling_price, {iso('seen')} AS collected_at FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seen DESC, arrival DESC) AS rn FROM (
        SELECT user_id AS product_id, event_id AS arrival, ts - to_days(CAST(event_id % 7 AS INTEGER)) AS seen, floor(value/100) AS price FROM events)) WHERE rn = 1""",
    "stream_ledger": "SELECT user_id AS product_id, event_type AS field_name, count(*) AS rows FROM events GROUP BY ALL",
    "stream_import": with_ctes("""SELECT l_last.product_id, name, url, marketplace, external_id, brand, dataset_status, source_name, p.n AS price_rows FROM l_last
      LEFT JOIN (SELECT product_id, count(*) AS n FROM price_walk GROUP BY product_id) p USING (product_id)""", _NOTHING_STORED),
    "stream_import_used_store": imports.SQL["store_after_imports"],
}
