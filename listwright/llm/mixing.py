"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Targets: the mix takes ``BUDGET`` times all words. Sources (by code point, null last) weigh 5, 2, 1, repeating; a
source takes ``REPEATS`` times its words at most, and what it can't take is shared out again by weight. So every
target is ``min(REPEATS * size, weight * level)`` with one level for all, found by adding up the sources in the order in which they fill up.

Curriculum: over training time 0 to 1 the weight of a source runs linearly between the two factors of its class in
``SCHEDULES``. Its integral is the source's cumulative token demand; the documents of a source lie in a fixed random
order (md5 of doc_id) on its token axis, pass after pass, and the inverse of the demand gives each copy its
position. The mix is sorted by position by range partitioning.

A source's documents are added up in two levels, over about sqrt(n) slices of the md5 range of about sqrt(n) rows
each, so no task holds a whole source. Only the table of sources (one row each) is ordered in one task.

Defined cases: null text or text without words has size 0 and is never taken; a null source is a source of its own,
sorted last; rows that repeat a doc_id are ordered by size and then split freely, so equal rows may swap their parts;
an empty table gives no rows; no words at all give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.common import WORD, quoted
from listwright.session import stage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
#: Factor of the weight at the start and at the end of training, by class (rank of the source modulo 3).
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """source, n, source_size, weight, class, target: one row per source."""
    sources = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("class") + 1).cast("int"))
    sources = sources.withColumn("class", (rank % len(weights)).cast("int")).withColumn("weight", pick(weights).cast("double"))
    sources = sources.withColumn("cap", (F.lit(repeats) * F.col("source_size")).cast("double"))
    # Sources fill up in the order of cap / weight. Behind the first k full ones the level is what is left of the budget
    # per open weight; it rises while the next source would be full as well and falls after that, so the highest one holds.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.lit(budget) * F.sum("source_size").over(everyone) - full) / open_weight)
    return sources.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everyone))).select("source", "n", "source_size", "weight", "class", "target")


def moment(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source has been asked for ``share`` (0 to 1) of its target: the inverse of a*t + (b-a)*t*t/2."""
    first = F.element_at(F.array(*(F.lit(float(a)) for a, _ in schedules)), kind % len(schedules) + 1)
    last = F.element_at(F.array(*(F.lit(float(b)) for _, b in schedules)), kind % len(schedules) + 1)
    whole = share * (first + last) / 2
    return 2 * whole / (first + F.sqrt(F.greatest(F.lit(0.0), first * first + 2 * (last - first) * whole)))


def _placed(sized: DataFrame, weights, budget, repeats) -> DataFrame:
    """Adds n, source_size, target, class and start (words of the source ahead of the row) to rows of doc_id, source and size."""
    sized = sized.withColumn("key", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
    # One key that is never null for joins and windows, so that they share a partitioning. The written tables of sources
    # and slices have a known size: while they are small, rows with their texts aren't shuffled to meet them.
    sized = sized.withColumn("owner", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = stage(targets(sized, weights, budget, repeats), "mix-sources")
    sources = sources.withColumn("owner", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    rows = sized.join(sources, "owner")
    # The slice of a row is the place of its md5 in the md5 range, so it doesn't depend on how the rows are stored.
    place = F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10).cast("double"), F.lit(0.0)) / float(2**32)
    rows = rows.withColumn("slice", F.floor(place * F.ceil(F.sqrt("n"))))
    slices = rows.groupBy("owner", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("owner").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = stage(slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).drop("slice_size"), "mix-slices")
    inside = Window.partitionBy("owner", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(slices, ["owner", "slice"]).withColumn("start", F.col("start") + F.col("ahead"))


def _taken(copy: int) -> Column:
    """Words the mix takes of a row's copy (0 for the first pass over the source)."""
    left = F.round("target").cast("long") - F.col("start") - copy * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def _position(copy: int, schedules) -> Column:
    share = F.least(F.lit(1.0), (F.col("start") + copy * F.col("source_size")) / F.col("target"))
    return F.when(_taken(copy) > 0, moment(share, F.col("class"), schedules))


def _ordered(placed: DataFrame, repeats: int, schedules, carried: list[str], untaken: bool = False) -> DataFrame:
    """Copies (``carried`` columns, copy, words, position) in training order, sorted by range partitioning. With ``untaken`` a row of which nothing is taken stays as a copy without words and position, behind the others."""
    copies = F.array(*(F.struct(F.lit(k).alias("copy"), _taken(k).alias("words"), _position(k, schedules).alias("position")) for k in range(repeats)))
    rows = placed.select("doc_id", *carried, F.explode(copies).alias("c")).select("doc_id", *carried, "c.*")
    rows = rows.where("words > 0 OR copy = 0" if untaken else "words > 0")
    # Further keys also part the copies without position, which no range bound of positions could.
    order = (F.col("position").asc_nulls_last(), F.xxhash64("doc_id"), F.col("doc_id"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def assign(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position of its first copy (null if untaken). Added up from the mix's copies, which are written in training order without their texts."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))
    sized = stage(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    about = ["row", "source", "size", "source_size", "target"]
    copies = stage(_ordered(_placed(sized, weights, budget, repeats), repeats, schedules, about, untaken=True), "mix-order")
    rows = copies.groupBy("doc_id", *about).agg(F.sum("words").alias("taken"), F.min_by("position", "copy").alias("position"))
    return rows.drop("row")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The mixed corpus in training order: the columns of ``docs``, a row for each copy taken. The copy at which a target is reached is cut behind the words it still takes and is the text's start as it was."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*map(quoted, docs.columns)).alias("row"))
    rows = _ordered(_placed(sized, weights, budget, repeats), repeats, schedules, ["row", "size"])
    # Cut behind each word, so every piece keeps the white space ahead of its word.
    pieces = F.slice(F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("words").cast("int"))
    text = F.when(F.col("words") < F.col("size"), F.array_join(pieces, "")).otherwise(F.col("row.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
