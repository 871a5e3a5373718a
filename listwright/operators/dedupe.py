"""Greedy duplicate removal inside one submission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import identity_key, name_key
from listwright.session import stage

#: Rounds of winners before chains of open rows are followed.
ROUNDS = 2
_COLUMNS = ["identity_key", "name_key", "record_no"]


def with_keys(listings: DataFrame) -> DataFrame:
    return listings.withColumns({
        "identity_key": identity_key(F.col("marketplace"), F.col("external_id"), F.col("url")),
        "name_key": name_key(F.col("marketplace"), F.col("normalized_name")),
    })


def _large(df: DataFrame) -> DataFrame:
    """For a join that shuffles both sides: these tables grow with the batch, and as broadcasts round after round would pass through the driver."""
    return df.hint("merge")


def keep_first(keyed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``record_no`` of the kept rows, as the row-by-row rule keeps them.

    A row is kept if neither of its keys was registered by an earlier *kept* row. Copies with both
    keys alike are folded to their first row before anything is shuffled by a single key. Each
    round then keeps the open rows that come first under both of their keys and drops the open
    rows that share a key with them. The winners are aggregated per key and joined on the unique record number, so a hot
    key never meets itself. From round ``rounds`` on, what is still open is followed along chains as well (``_chains``), so that
    a chain through any number of rows takes the logarithm of its length in joins. No step holds a key or a chain in one task.
    """
    pairs = keyed.groupBy("identity_key", "name_key").agg(F.min("record_no").alias("record_no")).select(*_COLUMNS)
    undecided, kept, turn = stage(pairs, "undecided"), [], 0
    while True:
        first = lambda key: undecided.groupBy(key).agg(F.min("record_no").alias("record_no")).select("record_no")
        winners = undecided.join(_large(first("identity_key")), "record_no", "left_semi").join(_large(first("name_key")), "record_no", "left_semi")
        winners = stage(winners, "winners")
        lost = None
        if turn >= rounds:
            followed = _chains(undecided, winners)
            winners = winners.unionByName(followed.where("kept").select(*_COLUMNS))
            lost = followed.where("NOT kept").select("record_no")
        kept.append(winners)
        rest = undecided.join(_large(winners.select("identity_key")), "identity_key", "left_anti").join(_large(winners.select("name_key")), "name_key", "left_anti")
        undecided = stage((rest if lost is None else rest.join(_large(lost), "record_no", "left_anti")).select(*_COLUMNS), "undecided")
        turn += 1
        if undecided.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), [k.select("record_no") for k in kept])


def _chains(undecided: DataFrame, winners: DataFrame) -> DataFrame:
    """Open rows whose fate follows from one other row, with ``kept``.

    A row that is second under one key and first under the other has one earlier neighbour, and is kept if that one isn't. So it
    points at it with one flip; pointers are joined with themselves until they end at a row without a pointer, each join doubling the
    length they span. Where that row is a winner the fate is known. A row is pointed at by two others at most, so no join is skewed.
    """
    first = lambda key, out: undecided.groupBy(key).agg(F.min("record_no").alias(out))
    rows = undecided.join(_large(first("identity_key", "i1")), "identity_key").join(_large(first("name_key", "n1")), "name_key")
    rows = stage(rows, "firsts")
    second = lambda key, at, out: rows.where(F.col("record_no") > F.col(at)).groupBy(key).agg(F.min("record_no").alias(out))
    rows = rows.join(_large(second("identity_key", "i1", "i2")), "identity_key", "left").join(_large(second("name_key", "n1", "n2")), "name_key", "left")
    leads = (F.col("record_no") == F.col("i1"), F.col("record_no") == F.col("n1"))
    before = F.when(leads[0] & (F.col("record_no") == F.col("n2")), F.col("n1")).when(leads[1] & (F.col("record_no") == F.col("i2")), F.col("i1"))
    pointers = stage(rows.select(*_COLUMNS, before.alias("to"), F.lit(1).alias("flips")).where(F.col("to").isNotNull()), "pointers")
    while True:
        onward = pointers.select(F.col("record_no").alias("to"), F.col("to").alias("_to"), F.col("flips").alias("_flips"))
        joined = pointers.join(_large(onward), "to", "left")
        moved = stage(joined.select(
            *_COLUMNS, F.coalesce("_to", "to").alias("to"), ((F.col("flips") + F.coalesce("_flips", F.lit(0))) % 2).alias("flips"), F.col("_to").isNotNull().alias("moved")
        ), "pointers")
        pointers = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    ends = winners.select(F.col("record_no").alias("to"))
    return pointers.join(_large(ends), "to", "left_semi").select(*_COLUMNS, (F.col("flips") == 0).alias("kept"))


def split_duplicates(keyed: DataFrame, **options) -> DataFrame:
    """Adds ``is_duplicate``."""
    kept = keep_first(keyed, **options).withColumn("_kept", F.lit(True))
    return keyed.join(_large(kept), "record_no", "left").withColumn("is_duplicate", F.col("_kept").isNull()).drop("_kept")
