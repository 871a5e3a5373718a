"""Exact top-k inner products by a three-phase uniform threshold.

Components become ``floor(256 * x)``. The dimensions are dealt into ``LISTS`` blocks; a block gives every candidate a partial
score, and a query's score is the sum over its blocks. For a block of queries:

1. every task keeps, for each query and list, its ``k`` best partial scores with their rows' whole scores, and the list's
   smallest; the lists are gathered per query, and the k-th best whole score among the rows seen is the query's safe cutoff;
2. the cutoffs are broadcast; a candidate that stays below the floor plus an equal share of the cutoff in every list
   can't reach it. Tasks collect entries list by list; what the lists still to come can add is bounded by the
   lengths of their parts, and a candidate that can't reach the cutoff any more is left;
3. the remaining scores are resolved, for the candidates left alone, exactly, and the best ``k`` of every task ranked per query.

The rows are read in place; only queries travel, ``QUERY_BLOCK`` vectors at a time (a bounded broadcast), so the job
is a stated query set against all rows, in blocks. No list of candidates grows with the table: a task sends ``k`` entries
a query and list.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids;
vectors meet only vectors of their own length; a candidate row that repeats counts once for each row, a repeated query id
is asked once, with its smallest vector; ties go to the smaller vec_id; a query without candidates has no rows; other columns
are ignored; an empty table gives no rows. Scores beyond 64 bits are cut to the largest long, and their order among each other is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import stage

SCALE, LISTS, QUERY_BLOCK, ROWS, PAIRS = 256, 4, 4096, 512, 1 << 16
ENTRIES = "query_id long, list int, row long, partial double, score double, low double"
RESULT = "query_id long, vec_id long, score long"
#: Sums below this are exact in double precision.
EXACT = 2.0**53


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and components as doubles, floor(SCALE * x); only whole, finite vectors."""
    whole = F.size("embedding") > 0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & finite).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_ids, row numbers, matrix) for each vector length among some rows."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ids, numbers = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            for i in range(0, len(rows), ROWS):
                some = rows[i : i + ROWS]
                yield ids[some], numbers[some], flat[at[some][:, None] + np.arange(d)]


def _parts(d: int, lists: int) -> list[slice]:
    edges = np.linspace(0, d, min(lists, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _exactly(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles while sums of their products are exact there, else as Python numbers."""
    if not rows.size or not queries.size or np.abs(rows).max() * np.abs(queries).max() * rows.shape[1] < EXACT:
        return queries, rows
    whole = np.vectorize(int, otypes=[object])
    return whole(queries), whole(rows)


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all queries and rows."""
    queries, rows = _exactly(queries, rows)
    return queries @ rows.T


def _of_pairs(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of query ``q`` and row ``row`` alone; one product where most pairs are asked for."""
    if len(q) * 8 > len(queries) * len(rows):
        return (queries @ rows.T)[q, row]
    parts = [(queries[q[i : i + PAIRS]] * rows[row[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _lengths(vectors: np.ndarray, parts: list[slice]) -> np.ndarray:
    """The length of each vector's part, by list; rounded up, so that products of lengths bound inner products."""
    return np.stack([np.sqrt((vectors[:, p].astype(float) ** 2).sum(axis=1)) for p in parts]) * (1 + 1e-9)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores of each row, ties to the left, in any order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    cut = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, equal = scores > cut, scores == cut
    equal &= equal.cumsum(axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]
    return np.nonzero(above | equal)[1].reshape(-1, k)


class Queries:
    """A block of queries, by vector length."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            self.by_length[int(d)] = ids[own], np.stack([vectors[i] for i in own])


def _lists(queries: Queries, k: int, lists: int):
    """Phase 1: the local score lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for ids, numbers, rows in _blocks(batches):
            d = rows.shape[1]
            if d not in queries.by_length:
                continue
            asked, vectors = queries.by_length[d]
            own = asked[:, None] == ids[None, :]
            partial = [_product(vectors[:, part], rows[:, part]).astype(float) for part in _parts(d, lists)]
            total = sum(partial)
            for j, scores in enumerate(partial):
                low = scores.min(axis=1)
                scores[own] = -np.inf
                best = _best(scores, k)
                some, whole, names = np.take_along_axis(scores, best, axis=1), np.take_along_axis(total, best, axis=1), numbers[best]
                if (d, j) in held:
                    some, whole, names, low = (*(np.hstack(x) for x in zip(held[d, j], (some, whole, names))), np.minimum(held[d, j][3], low))
                    best = np.lexsort((names, -some), axis=1)[:, :k]
                    some, whole, names = (np.take_along_axis(x, best, axis=1) for x in (some, whole, names))
                held[d, j] = some, whole, names, low
        for (d, j), (some, whole, names, low) in held.items():
            wide = lambda x: np.broadcast_to(x[:, None], some.shape).ravel()
            out = {"query_id": wide(queries.by_length[d][0]), "list": np.full(some.size, j, np.int32), "row": names.ravel(), "partial": some.ravel(), "score": whole.ravel(), "low": wide(low)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def cutoffs(entries: DataFrame, k: int) -> DataFrame:
    """query_id, cutoff (k-th best score seen, over the floors), floors (by list): one row per query, aggregated in the cluster."""
    floors = entries.groupBy("query_id", "list").agg(F.min("low").alias("low"))
    by_query = floors.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("list", "low"))).alias("floors"))  # LISTS entries a query
    rank = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("partial"), "row"))
    seen = entries.where("partial > double('-infinity')").withColumn("rank", rank).where(F.col("rank") <= k)
    scores = seen.groupBy("query_id", "row").agg(F.max("score").alias("score"))  # by row: rows may share a vec_id
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row"))
    cut = scores.withColumn("place", place).where(F.col("place") == k).join(floors.groupBy("query_id").agg(F.sum("low").alias("floor")), "query_id")
    cut = cut.select("query_id", (F.col("score") - F.col("floor")).alias("cutoff"))
    return by_query.join(cut, "query_id", "left").select("query_id", F.coalesce("cutoff", F.lit(0.0)).alias("cutoff"), "floors.low")


def _resolve(queries: Queries, cut: dict[int, tuple[float, np.ndarray]], k: int, lists: int):
    """Phases 2 and 3: entries list by list, as long as a candidate may still reach the cutoff, down to exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pd.DataFrame] = {}
        for ids, _, rows in _blocks(batches):
            d = rows.shape[1]
            if d not in queries.by_length:
                continue
            asked, vectors = queries.by_length[d]
            parts = _parts(d, lists)
            none = 0.0, np.zeros(len(parts))
            floors = np.array([cut.get(q, none)[1] for q in asked])
            known = np.array([cut.get(q, none)[0] for q in asked])
            known -= 1e-9 * (np.abs(known) + np.abs(floors).sum(axis=1))  # covers rounding where partial scores aren't exact in doubles
            share = known / len(parts)
            need = known + floors.sum(axis=1)
            mine, theirs = _lengths(vectors, parts), _lengths(rows, parts)
            left, right = _exactly(vectors, rows)
            first = left[:, parts[0]] @ right[:, parts[0]].T
            q, row = np.nonzero((first + mine[1:].T @ theirs[1:] >= need[:, None]) & (asked[:, None] != ids[None, :]))
            score = first[q, row]
            reached = score - floors[q, 0] >= share[q]
            for j, part in enumerate(parts[1:], 1):
                partial = _of_pairs(left[:, part], right[:, part], q, row)
                score, reached = score + partial, reached | (partial - floors[q, j] >= share[q])
                ahead = (mine[j + 1 :, q] * theirs[j + 1 :, row]).sum(axis=0)
                still = (score + ahead >= need[q]).astype(bool)
                q, row, score, reached = q[still], row[still], score[still], reached[still]
            reached = reached.astype(bool)
            q, row, score = q[reached], row[reached], score[reached]
            found = pd.DataFrame({"q": q, "score": score, "id": ids[row]})
            if d in held:
                found = pd.concat([held[d], found])
            held[d] = found.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)
        for d, found in held.items():
            scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in found["score"]]
            data = {"query_id": queries.by_length[d][0][found["q"].to_numpy()], "vec_id": found["id"].to_numpy(), "score": scores}
            yield pa.RecordBatch.from_pydict(data, schema=pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")]))

    return run


def top(vectors: DataFrame, queries: DataFrame, k: int, lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query vector over all other vectors."""
    rows = stage(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(2**31))), "topk-queries")
    spark = vectors.sparkSession
    # Blocks of queries: ranges of a hash, so that a block holds QUERY_BLOCK of them in expectation, whatever their ids.
    blocks = -(-asked.count() // query_block)
    results = spark.createDataFrame([], RESULT)
    for b in range(blocks):
        low, high = b * 2**31 // blocks, (b + 1) * 2**31 // blocks
        own = asked.where((F.col("part") >= low) & (F.col("part") < high)).select("vec_id", "v").toPandas()
        block = Queries(own["vec_id"].to_numpy(), list(own["v"]))
        entries = stage(rows.mapInArrow(_lists(block, k, lists), ENTRIES), "topk-lists")
        cut = {r["query_id"]: (r["cutoff"], np.array(r["low"])) for r in cutoffs(entries, k).collect()}
        found = stage(rows.mapInArrow(_resolve(block, cut, k, lists), RESULT), "topk-found")
        results = results.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return results.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
