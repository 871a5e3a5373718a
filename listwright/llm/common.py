"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run without ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def quoted(name: str) -> str:
    """A column's name for ``F.col`` and ``select``, whatever it holds: dots and backticks too."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[list[tuple]]]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain Python values: nulls are None and long keys stay exact.

    ``make()`` runs once per task; what it returns gets the columns of each batch as lists and yields lists of rows.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for rows in work(*(c.to_pylist() for c in batch.columns)):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return df.mapInArrow(run, schema)


def add_up(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Sums binary arrays of ``dtype`` by ``chunk`` (columns chunk, values) in the cluster; the driver gets one array per chunk.

    The caller's number of chunks is fixed, so the result does not grow with the data.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, values in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(values, dtype)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": list(sums), "values": [s.tobytes() for s in sums.values()]}, schema=pa.schema([("chunk", pa.int64()), ("values", pa.binary())]))

    rows = parts.select(F.col("chunk").cast("long"), "values").repartition("chunk").mapInArrow(add, "chunk long, values binary").collect()
    return {r["chunk"]: np.frombuffer(r["values"], dtype) for r in rows}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, whatever others there are: a column spelled alike comes before one that differs in case.

    Works by position, so names that clash but for case, or hold dots, don't matter.
    """
    at = [next((i for i, c in enumerate(df.columns) if c == n), next((i for i, c in enumerate(df.columns) if c.lower() == n.lower()), None)) for n in names]
    if None in at:
        raise ValueError(f"column {names[at.index(None)]} is missing; there are {df.columns}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])
