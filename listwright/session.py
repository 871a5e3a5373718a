"""Session settings and staged tables.

Long jobs are cut into written parquet tables in the shared folder the cluster names in
``spark.checkpoint.dir``. A staged table survives the loss of executors, is scanned with column
pruning, and its size on disk lets Catalyst decide by itself whether a join may broadcast it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Runtime settings the jobs rely on; none of them changes a result except the time zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where the split costs one more shuffle further on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Whole texts travel in batches: fewer rows at a time bound what a Python worker holds.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Keys of a small batch reach the Bloom filters of stored files as they are.
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
}
#: For the session builder only: call sites of every column expression double the time it takes to
#: build a wide projection.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``, else a folder of the session's warehouse."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    return root.rstrip("/") if root else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/listwright/{name}-{uuid.uuid4().hex}"


#: Paths staged inside open ``cleared`` blocks, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged inside the block at its end; nothing that still reads them may leave it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses scan the table instead of repeating the job."""
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
