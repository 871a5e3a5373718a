"""Imports as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.plans.imports import write_import
from listwright.session import prepare, stage
from listwright.sources.landing import numbered, research_entries
from listwright.sources.tables import Store


def submissions(spark: SparkSession, path: str, fields: list[str], max_files: int | None = None) -> DataFrame:
    """A directory of CSV submissions as a stream of all-string rows with their place (``file``, ``block``).

    ``fields`` are the columns in file order; a file with another header is an error, not a shift of its columns.
    """
    reader = spark.readStream.schema(", ".join(f"`{f}` string" for f in fields)).option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    rows = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).csv(path)
    return rows.select(*[F.col(f).alias(f.strip().lower()) for f in fields], "_metadata")


def json_submissions(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A directory of research submissions in JSON as a stream of all-string rows with their place."""
    reader = spark.readStream.option("wholetext", True)
    return research_entries((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(path).select("value", "_metadata"))


def continuous_import(
    rows: DataFrame, store: Store, checkpoint: str, now: Column, marketplaces: DataFrame | None, research: bool,
    data_source_id: int | None = None, after: Callable[[Store, str], None] | None = None, first: int = 2,
) -> StreamingQuery:
    """Imports every micro-batch as one run.

    The run id follows from the checkpoint folder and the batch id: streams never share ids, and a batch that is replayed
    after a lost driver or executor finds its run committed, or starts it anew on the tables as they are. ``after`` is
    called with the run id of each committed batch (to rescore, for example). Rows without a ``record_no`` are numbered from ``first``:
    2 where a file begins with a header. A batch that meets a commit of another stream is repeated on the newer tables.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def run(batch: DataFrame, batch_id: int) -> None:
        prepare(batch.sparkSession)
        run_id = f"stream-{stream}-{batch_id:010d}"
        if "record_no" in batch.columns:
            landed = stage(batch.withColumn("record_no", F.col("record_no").cast("long")).drop("_metadata"), "landed")
        else:
            landed = numbered(batch, first=first) if "_metadata" in batch.columns else stage(batch.withColumn("record_no", F.monotonically_increasing_id()), "landed")
        write_import(store, landed, run_id, now, marketplaces, research, data_source_id)
        if after is not None:
            after(store, run_id)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
