"""Stateful streams: change-gated observations, newest values, ledger rows without replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from listwright.operators.history import _signature

_STATE = "at_us bigint, sig string"
#: ``transformWithState`` keeps its state here; the setting counts when a stream is started.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Gate(StatefulProcessor):
    """Keeps the newest *stored* (time, values) of a key; skipped and late rows do not move it."""

    def __init__(self, arrival: str, columns: list[str], ttl_ms: int | None) -> None:
        self.arrival, self.columns, self.ttl_ms = arrival, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", _STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        at_us, sig = self.newest.get() if self.newest.exists() else (None, None)
        if at_us is None or initialState["at_us"] >= at_us:
            self.newest.update((initialState["at_us"], initialState["sig"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at_us, sig = self.newest.get() if self.newest.exists() else (None, None)
        moved = False
        for row in sorted(rows, key=lambda r: r[self.arrival]):
            if sig is None or row["sig"] != sig:
                if at_us is None or row["at_us"] >= at_us:
                    at_us, sig, moved = row["at_us"], row["sig"], True
                yield Row(**{c: row[c] for c in self.columns})
        if moved or self.ttl_ms:  # a key that is still seen doesn't run out
            self.newest.update((at_us, sig))

    def close(self) -> None:
        pass


def changed(rows: DataFrame, key: str, arrival: str, at: str, fields: list[str], on_file: DataFrame | None = None, ttl: str | None = None) -> DataFrame:
    """Rows that differ from the newest stored row of their key, with the rule of the batch job.

    The state is one row per key. ``on_file`` (a table of the newest stored row per key: ``key``, ``at``, ``fields``) is what a
    stream without a checkpoint begins with; one that is started again goes on from its checkpoint. With ``ttl`` (as "30 days") a key that isn't
    seen for that long is forgotten, and its next row is stored. A key's rows of one micro-batch are put in arrival order, so
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the source bounds what one key holds; without a bound use the batch job in
    ``foreachBatch``, as the imports do.
    """
    rows.sparkSession.conf.set(*PROVIDER)
    signed = lambda df: df.withColumns({"sig": _signature(fields), "at_us": F.unix_micros(at)})
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    first = signed(on_file).select(key, "at_us", "sig").groupBy(key) if on_file is not None else None
    gate = _Gate(arrival, rows.columns, ttl_ms)
    return signed(rows).groupBy(key).transformWithState(gate, rows.schema, "Append", "ProcessingTime" if ttl else "None", first)


def newest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Newest value per key so far, for update mode; partially aggregated before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(key, *[F.col("_row")[v].alias(v) for v in values])


def ledger_without_replays(rows: DataFrame, at: str, delay: str, identity: list[str]) -> DataFrame:
    """Ledger rows, each once, as long as a replay arrives within ``delay`` of its observation time."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(identity)


def to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Writes each micro-batch to its own folder, so a replayed batch overwrites itself. With ``once`` it ends when everything available
    is written; a stream with a ``ttl`` has to go on instead, as Spark starts batches for it as long as time passes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    writer = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
