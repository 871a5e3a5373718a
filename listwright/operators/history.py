"""Observation histories: newest row, newest-first order, and rows that are appended only on a change."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.skew import GROUP_LIMIT, ranked_within, split_hot, with_previous
from listwright.session import stage

PRICE_FIELDS = ["selling_price", "mrp"]
METRIC_FIELDS = ["review_count", "average_rating", "competitor_count", "seller_count", "best_seller_rank"]
#: Only these three make a new metrics row.
METRIC_TRIGGERS = METRIC_FIELDS[:3]


def newest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last row per key along ``order``: one ``max_by``, aggregated before the shuffle, no window.

    Spark aggregates rows of several columns by sorting them; where a history is stored, its table of newest rows (``folded``) spares both.
    """
    pick = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col("_row")[v].alias(v) for v in values])


def newest_first(df: DataFrame, key: str, order: list[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Histories numbered from the newest row (position 1)."""
    return ranked_within(df, [key], [F.col(c).desc() for c in order], "position", limit)


def _signature(fields: list[str]) -> Column:
    """NULL-safe comparison of several columns as one never-NULL string."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in fields])


def with_any_metric(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in METRIC_FIELDS]))


def changed_in_order(df: DataFrame, key: str, order: list[str], fields: list[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Rows that differ from the one before, for observations arriving in collected order.

    In that order a skipped row equals the newest stored one, so the previous row always carries
    the stored values and ``lag`` is exact.
    """
    signed = df.withColumn("_sig", _signature(fields))
    seen = with_previous(signed, [key], order, "_sig", "_prev", limit)
    return seen.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_sig"))).drop("_sig", "_prev")


def _walk(batches: Iterator[pd.DataFrame], key: str, at: str, exits: bool) -> Iterator[pd.DataFrame]:
    """Replay rows sorted by (key, slice, arrival), holding only the newest stored row of the group."""
    group, state_at, state_sig, last = None, None, None, None
    for pdf in batches:
        keep, done = [], []
        columns = (pdf[key], pdf["_slice"], pdf[at + "_us"], pdf["_sig"], pdf["_entry_at"], pdf["_entry_sig"])
        for k, s, t, sig, entry_at, entry_sig in zip(*(c.tolist() for c in columns)):
            if (k, s) != group:
                if exits and group is not None:
                    done.append((*group, state_at, state_sig))
                group = (k, s)
                known = isinstance(entry_sig, str)
                state_at, state_sig = (int(entry_at), entry_sig) if known else (None, None)
            stored = state_sig is None or sig != state_sig
            keep.append(stored)
            if stored and (state_at is None or t >= state_at):
                state_at, state_sig = t, sig
        if exits:
            last = (*group, state_at, state_sig)
            yield pd.DataFrame(done, columns=[key, "_slice", "_exit_at", "_exit_sig"])
        else:
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]
    if exits and last is not None:
        yield pd.DataFrame([last], columns=[key, "_slice", "_exit_at", "_exit_sig"])


def _replay(rows: DataFrame, key: str, arrival: str, at: str) -> DataFrame:
    ordered = rows.repartition(F.col(key), F.col("_slice")).sortWithinPartitions(key, "_slice", arrival)
    return ordered.mapInPandas(lambda batches: _walk(batches, key, at, False), rows.schema)


def _exits(rows: DataFrame, key: str, arrival: str, at: str) -> DataFrame:
    slim = rows.select(key, "_slice", arrival, at + "_us", "_sig", "_entry_at", "_entry_sig")
    ordered = slim.repartition(F.col(key), F.col("_slice")).sortWithinPartitions(key, "_slice", arrival)
    key_type = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, _slice long, _exit_at long, _exit_sig string"
    return ordered.mapInPandas(lambda batches: _walk(batches, key, at, True), schema)


def changed_on_arrival(
    arrivals: DataFrame, key: str, arrival: str, at: str, fields: list[str],
    on_file: DataFrame | None = None, limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rows to append when each arriving row is compared with the newest *stored* row by ``at``.

    Rows may arrive out of collected order: a late row is compared with the newest row on file and
    may be stored, but does not become the newest. ``on_file`` holds one newest stored row per key
    (``key``, ``at``, ``fields``); ``arrival`` numbers the rows of the batch uniquely.

    A key whose rows arrive in collected order, none before its stored row, is compared row by row with the row before it: there
    a skipped row equals the stored one, so ``lag`` is exact, on hot keys by slices. Only keys with a late row are replayed, as
    a late row may be stored without becoming the one to compare with: each partition as a stream of Arrow batches, so memory does
    not grow with a key. Such a key of more than ``limit`` rows is cut into arrival ranges of at most ``limit`` rows that are
    replayed side by side from guessed entry states; the exit of each range becomes the entry of
    the next one until no entry changes, which makes the result exact. After round r the first r
    ranges are right, so the loop ends; a range that stores any row forgets its entry, so two or
    three rounds are usual.
    """
    columns = arrivals.columns
    rows = arrivals.withColumn("_sig", _signature(fields)).withColumn(at + "_us", F.unix_micros(at))
    if on_file is None:
        entry = lambda df: df.withColumn("_entry_at", F.lit(None).cast("long")).withColumn("_entry_sig", F.lit(None).cast("string"))
    else:
        known = on_file.select(key, F.unix_micros(at).alias("_entry_at"), _signature(fields).alias("_entry_sig"))
        entry = lambda df: df.join(known, key, "left")
    # A row without a time is late by definition: it can't be placed in the order.
    seen = with_previous(rows.withColumn("_row", F.struct(F.col(at + "_us").alias("at"), F.col("_sig").alias("sig"))), [key], [arrival], "_row", "_before", limit).drop("_row")
    seen = stage(entry(seen), "arrivals")
    before = lambda f: F.when(F.col("_before").isNotNull(), F.col(f"_before.{f}")).otherwise(F.col(f"_entry_{f}"))
    late = F.col(at + "_us").isNull() | (F.col("_before").isNotNull() & F.col("_before.at").isNull()) | (F.col(at + "_us") < before("at"))
    replayed = stage(seen.where(F.coalesce(late, F.lit(False))).select(key).distinct(), "late-keys")
    prompt = seen.join(replayed, key, "left_anti").where(before("sig").isNull() | (before("sig") != F.col("_sig"))).select(*columns)
    if replayed.isEmpty():
        return prompt
    rows = seen.join(replayed, key, "left_semi").select(*columns, "_sig", at + "_us")
    return prompt.unionByName(_replayed(rows, columns, key, arrival, at, entry, limit))


def _replayed(rows: DataFrame, columns: list[str], key: str, arrival: str, at: str, entry: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """The rows of keys with late rows that are stored."""
    calm, hot = split_hot(rows, [key], limit)
    parts = [_replay(entry(calm.withColumn("_slice", F.lit(0).cast("long"))), key, arrival, at)]
    if hot is not None:
        cut = stage(entry(hot.withColumn("_slice", F.floor(F.col(arrival) / limit).cast("long"))), "arrival-slices")
        first = cut.groupBy(key, "_slice").agg(F.first("_entry_at").alias("_entry_at"), F.first("_entry_sig").alias("_entry_sig"))
        entries = stage(first, "entries")
        file_state = entries.select(key, "_slice", F.col("_entry_at").alias("_file_at"), F.col("_entry_sig").alias("_file_sig"))
        bare = cut.drop("_entry_at", "_entry_sig")
        along = Window.partitionBy(key).orderBy("_slice")
        same_group = [key, "_slice"]
        while True:
            ends = _exits(bare.join(entries, same_group), key, arrival, at)
            before = F.lag(F.struct("_exit_at", "_exit_sig")).over(along)
            moved = (
                ends.withColumn("_before", before).join(file_state, same_group)
                .select(
                    *same_group,
                    F.when(F.col("_before").isNull(), F.col("_file_at")).otherwise(F.col("_before._exit_at")).alias("_entry_at"),
                    F.when(F.col("_before").isNull(), F.col("_file_sig")).otherwise(F.col("_before._exit_sig")).alias("_entry_sig"),
                )
            )
            next_entries = stage(moved, "entries")
            settled = next_entries.exceptAll(entries).isEmpty()
            entries = next_entries
            if settled:
                break
        parts.append(_replay(bare.join(entries, same_group).select(*rows.columns, "_slice", "_entry_at", "_entry_sig"), key, arrival, at))
    return reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts])


def cost_rows(listings: DataFrame, key: str = "product_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Every listing with a cost struct adds a cost row, effective on the day it was collected."""
    return listings.where(F.col("costs").isNotNull()).select(
        key, "costs.*", F.to_date("collected_at").alias("effective_date"), "collected_at", "confidence_score", *carried
    )


def folded(on_file: DataFrame, added: DataFrame, run_no: int) -> DataFrame:
    """Newest rows that a run changes: of its rows and the newest on file, the last by collection time, commit number and record. Both are
    one run's worth of rows; a product whose newest row stays is not among the result."""
    rows = on_file.unionByName(added.withColumn("run_no", F.lit(run_no).cast("long")))
    rest = [c for c in rows.columns if c != "product_id"]
    last = newest(rows, ["product_id"], ["collected_at", "run_no", "record_no"], rest)
    return last.where(F.col("run_no") == run_no).select(*on_file.columns)
