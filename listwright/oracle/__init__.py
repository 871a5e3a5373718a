"""The same results in plain SQL for DuckDB, written from the rules and not from the jobs."""

from listwright.oracle import imports, scoring, streams, tracker

SQL = {**scoring.SQL, **imports.SQL, **tracker.SQL, **streams.SQL}
SQL["newest_price_table"] = f"SELECT product_id, selling_price, mrp FROM ({scoring.SQL['latest_price']})"
