"""Ordered work on groups of any size.

``row_number`` and ``lag`` over ``Window.partitionBy(key)`` put a whole key into one task, and a
window without a key puts the whole table there. Keys above a row limit are therefore handled on
*slices*: a range-partitioned copy of the rows, in which a key may span any number of slices, plus
one summary row per key and slice that carries the count or the last row over to the next slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import stage

#: Rows one key may bring into one task.
GROUP_LIMIT = 500_000
#: Rows a task takes of a table that is spread.
TASK_ROWS = 50_000
#: Slices whose summary rows are added up in one task; those tasks' sums are added up once more.
SLICE_GROUP = 1_000


def spread(df: DataFrame, rows_per_task: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt evenly among tasks, for work that takes far longer than reading does: one row group, or one file that
    can't be split, is one task's however many rows it holds. ``df`` is a stored table, counted without reading its columns."""
    n = -(-df.count() // rows_per_task)
    return df.repartition(n) if n > 1 else df


def split_hot(df: DataFrame, keys: list[str], limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys, None if no key is hot). Hot keys stay a table and are joined, whatever their number."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    hot = stage(counts, "hot-keys")
    if hot.isEmpty():
        return df, None
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def slices(df: DataFrame, order: list[Column], name: str, rows_per_slice: int) -> DataFrame:
    """Range-partitioned, written copy of ``df``: ``_slice`` ascends along ``order``, ``_within`` counts from 1 inside a slice.

    ``order`` must be a total order: equal rows would share a slice. The input is written first, as
    counting, sampling the range bounds and shuffling would each run it again. A row's place in its sorted partition is
    in the low bits of its id, so numbering takes no further shuffle.
    """
    held = stage(df, name)
    n = max(1, -(-held.count() // rows_per_slice))
    ranged = held.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    return stage(placed.withColumns({"_slice": F.shiftright("_id", 33), "_within": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_id"), name)


def ranked(df: DataFrame, order: list[Column], out: str, rows_per_slice: int = GROUP_LIMIT) -> DataFrame:
    """``out`` = 1-based position of every row in the total order, without a one-task window over rows."""
    cut = slices(df, order, "ranked", rows_per_slice)
    counts = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.floor(F.col("_slice") / SLICE_GROUP))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_sum"))
    groups = groups.select("_group", F.coalesce(F.sum("_sum").over(ahead(Window.orderBy("_group"))), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum("_n").over(ahead(Window.partitionBy("_group").orderBy("_slice"))), F.lit(0))
    offsets = counts.withColumn("_inside", inside).join(groups, "_group").select("_slice", (F.col("_inside") + F.col("_ahead")).alias("_before"))
    return cut.join(offsets, "_slice").withColumn(out, F.col("_within") + F.col("_before")).drop("_slice", "_within", "_before")


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], out: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """1-based position inside each key; a hot key is numbered slice by slice."""
    calm, hot = split_hot(df, keys, limit)
    numbered = calm.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if hot is None:
        return numbered
    cut = slices(hot, [F.col(k) for k in keys] + order, "ranked-within", limit).drop("_within")
    counts = cut.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order))
    joined = cut.withColumn("_within", within).join(before, ["_slice", *keys])
    return numbered.unionByName(joined.withColumn(out, (F.col("_within") + F.col("_before")).cast("long")).drop("_slice", "_within", "_before"))


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """``out`` = ``value`` of the row before this one in its key (NULL for the first), hot keys by slices.

    ``value`` must not be NULL (pass a struct to carry several columns).
    """
    calm, hot = split_hot(df, keys, limit)
    seen = calm.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is None:
        return seen
    cut = slices(hot, [F.col(c) for c in [*keys, *order]], "previous", limit).drop("_within")
    last = cut.groupBy("_slice", *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    inside = F.lag(value).over(Window.partitionBy("_slice", *keys).orderBy(*order))
    joined = cut.withColumn("_inside", inside).join(carried, ["_slice", *keys], "left")
    return seen.unionByName(joined.withColumn(out, F.coalesce("_inside", "_carry")).drop("_slice", "_inside", "_carry"))
