"""Streams over the driver's tables, run until everything available is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import binding, binding_raw, config, schemas
from listwright.functions.text import iso
from listwright.operators import history
from listwright.operators.history import PRICE_FIELDS
from listwright.plans.imports import write_import
from listwright.queries.imports import _base_store, store_state, third
from listwright.queries.scoring import _late_arrivals
from listwright.session import scratch_path, stage
from listwright.sources.tables import Store
from listwright.streaming import imports, state


def _thirds(rows: DataFrame, number: str) -> list[DataFrame]:
    last = rows.agg(F.max(number)).first()[0]
    cuts = [0, last // 3, 2 * last // 3, last + 1]
    return [rows.where((F.col(number) >= low) & (F.col(number) < high)) for low, high in zip(cuts, cuts[1:])]


def _in_parts(spark: SparkSession, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Feeds parts to a stream one after the other, which is started anew from its checkpoint for each, and returns what it wrote."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = job(spark.readStream.schema(part.schema).parquet(source))
        state.to_table(stream, out, checkpoint, mode).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(out)


def stream_price_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the observations is on file, gated as a batch; the stream begins with its newest stored rows and takes the others."""
    first, *rest = _thirds(_late_arrivals(spark, sf), "arrival")
    stored = stage(history.changed_on_arrival(first, "product_id", "arrival", "collected_at", PRICE_FIELDS), "stored")
    on_file = stage(history.newest(stored, ["product_id"], ["collected_at", "arrival"], ["collected_at", *PRICE_FIELDS]), "on-file")
    kept = _in_parts(spark, rest, lambda s: state.changed(s, "product_id", "arrival", "collected_at", PRICE_FIELDS, on_file), "append")
    columns = ["product_id", "arrival", "selling_price"]
    return stored.select(*columns).unionByName(kept.select(*columns))


def stream_latest_price(spark: SparkSession, sf: str) -> DataFrame:
    rows = _late_arrivals(spark, sf)
    values = ["arrival", "selling_price", "collected_at"]
    updates = _in_parts(spark, _thirds(rows, "arrival"), lambda s: state.newest(s, "product_id", ["collected_at", "arrival"], values), "update")
    now = updates.groupBy("product_id").agg(F.max_by(F.struct(*values), "batch_id").alias("r"))
    return now.select("product_id", "r.arrival", "r.selling_price", iso(F.col("r.collected_at")).alias("collected_at"))


def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = binding.table(spark, sf, "events").select(
        F.col("user_id").alias("product_id"), F.col("event_type").alias("field_name"), F.col("value").cast("string").alias("raw_value"),
        F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("run_id"),
    )
    identity = ["product_id", "field_name", "run_id", "raw_value"]
    parts = _thirds(rows, "run_id")
    kept = _in_parts(spark, [*parts, parts[-1]], lambda s: state.ledger_without_replays(s, "observed_at", "40 days", identity), "append")
    return kept.groupBy("product_id", "field_name").agg(F.count(F.lit(1)).alias("rows"))


def stream_import(spark: SparkSession, sf: str) -> DataFrame:
    """The raw listings as one CSV submission of a continuous import; the stored products afterwards."""
    source, root, checkpoint = (scratch_path(spark, n) for n in ("stream-in", "store", "stream-state"))
    cells = binding_raw.raw(spark, sf, binding_raw.LISTING)
    cells.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(source)
    store = Store(spark, root)
    rows = imports.submissions(spark, source, cells.columns).drop("_metadata")
    now = F.to_timestamp(F.lit(binding_raw.NOW))
    imports.continuous_import(rows, store, checkpoint, now, config.marketplaces(spark), research=False).awaitTermination()
    products = store.read_snapshot("products", schemas.PRODUCTS)
    prices = store.read_history("prices", schemas.PRICES).groupBy("product_id").agg(F.count(F.lit(1)).alias("price_rows"))
    return products.join(prices, "product_id", "left").select("product_id", "name", "url", "marketplace", "external_id", "brand", "dataset_status", "source_name", "price_rows")


def stream_import_used_store(spark: SparkSession, sf: str) -> DataFrame:
    """Three submissions over a store that holds products: two micro-batches of one stream, one of another, then the first stream once
    more without new files, and its first batch a second time."""
    store, rows = _base_store(spark, sf), binding_raw.raw(spark, sf, binding_raw.LISTING)
    now = F.to_timestamp(F.lit(binding_raw.NOW))
    folders = {stream: (scratch_path(spark, "stream-in"), scratch_path(spark, "stream-state")) for stream in "ab"}

    def run(stream: str) -> None:
        source, checkpoint = folders[stream]
        feed = imports.submissions(spark, source, rows.columns).drop("_metadata")
        imports.continuous_import(feed, store, checkpoint, now, config.marketplaces(spark), research=False).awaitTermination()

    for k, stream in enumerate("aab"):
        third(rows, k).write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "").csv(folders[stream][0])
        run(stream)
    run("a")
    write_import(store, third(rows, 0), store.commits()[1][1], now, config.marketplaces(spark), False)
    return store_state(store)


QUERIES = {f.__name__: f for f in [stream_price_changes, stream_latest_price, stream_ledger, stream_import, stream_import_used_store]}
