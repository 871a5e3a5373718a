"""Export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.fixed import EXPORT_COLUMNS, UNAVAILABLE
from listwright.functions.numbers import text


def _cell(name: str, kind: str) -> Column:
    return text(F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")


def _in_order(rows: DataFrame) -> DataFrame:
    """Range partitions by rank: the parts of the file follow each other in rank order."""
    return rows.repartitionByRange("rank").sortWithinPartitions("rank")


def write_csv(rows: DataFrame, path: str) -> None:
    """24 headed columns, CRLF, doubled quotes; a missing value is written as 'Data unavailable'."""
    kinds = dict(rows.dtypes)
    out = _in_order(rows).select(*[_cell(c, kinds[c]).alias(h) for c, h in EXPORT_COLUMNS])
    (
        out.write.option("header", True).option("nullValue", UNAVAILABLE).option("emptyValue", "").option("escape", '"')
        .option("lineSep", "\r\n").csv(path)
    )


def write_json(rows: DataFrame, path: str) -> None:
    """The same rows as JSON lines, NULLs kept."""
    _in_order(rows).write.option("ignoreNullFields", False).json(path)
