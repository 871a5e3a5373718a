"""Ranked lexical search with norm buckets: the exact k best documents of every query, most documents untouched.

A term of a document has an impact, its weight times its saturated frequency; a query is a set of terms, so a score is the inner product
of the document's impact vector with ones. For a block of queries:

1. one pass over whole texts keeps each document's length and its frequencies of the block's terms; corpus counts (documents, terms,
   documents of a term) are added up over all documents;
2. impact vectors are computed, ordered by their length (a range sort, longest first) and written: rows that follow each other are
   buckets of alike length;
3. the ``HEAD`` longest vectors give each query a first threshold, the k-th best score among them;
4. a task goes through its buckets with the thresholds, which rise as it finds better documents. Cauchy-Schwarz drops a query for a
   bucket whose longest vector can't reach the threshold. Inside, the query's coordinates are taken by their largest value in the
   bucket until those left can give a quarter of the threshold at most, by their largest values or by Cauchy-Schwarz: only documents
   with one of the coordinates taken are candidates, and each is dropped where its sum so far and the bound of the rest stay below;
5. survivors are scored in 64-bit integers, each task sends k entries a query at most, and lists are merged in two steps.

Thresholds only drop what scores strictly less, so ties survive, and the result doesn't depend on order or partitions.

What is broadcast: the terms of a block, ``TERMS`` at most or those of one query; terms above ``LONG`` bytes travel as digests. The
table of queries is read in blocks of such a size, and the texts once per block.

Defined cases: a null text has no terms and is no document in the count; rows with a null or repeated doc_id or item_id are documents or
queries of their own (a null doc_id comes first among equal scores); a query without terms, or without a document that scores above 0,
has no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.common import pick
from listwright.session import stage

#: Distinct terms of a block of queries, documents that give the first thresholds, bytes of a term that travels as it is.
TERMS, HEAD, LONG = 1 << 17, 4096, 64
#: Partial lists of a query that are merged before the last step.
MERGES = 64
#: Byte table: A-Z to a-z, other letters, digits and all beyond ASCII as they are, the rest to spaces.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "query long, row long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLDED).split()


def _key(term: bytes) -> bytes:
    return term if len(term) <= LONG else b"#" + hashlib.sha256(term).digest()  # no term begins with this sign


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Asked:
    """A block of queries: their terms numbered, and each query's numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        names = sorted({t for _, words in items for t in words})
        self.numbers = {t: i for i, t in enumerate(names)}
        self.queries = {q: np.array(sorted(self.numbers[t] for t in words), np.int64) for q, words in items if words}


def _questions(items: DataFrame) -> DataFrame:
    """(query, item_id, words): the distinct terms of every row of ``items``, written once; ``query`` tells equal ids apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({_key(t) for t in terms(x)}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary()))], ["item_id", "words"])

    slim = pick(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return stage(slim.mapInArrow(read, "item_id long, words array<binary>").withColumn("query", F.monotonically_increasing_id()), "lexical-queries")


def _blocks(questions: DataFrame, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries in blocks by a hash, halved until a block holds ``most`` terms or one query."""
    spread = F.pmod(F.xxhash64("query"), F.lit(1 << 30))
    pending = [(0, 1 << 30)]
    while pending:
        low, high = pending.pop()
        block = questions.where((spread >= low) & (spread < high))
        size, count = block.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count(F.lit(1))).first()
        if size > most and count > 1:
            middle = (low + high) // 2
            pending += [(low, middle), (middle, high)]
        elif size:
            yield [(r["query"], [bytes(w) for w in r["words"]]) for r in block.collect()]


def _frequencies(numbers: dict[bytes, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held, often = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.translate(_FOLDED).split() if text else []
                n.append(len(words))
                found = [(numbers.get(w if len(w) <= LONG else _key(w)), k) for w, k in Counter(words).items()]
                found = sorted((i, k) for i, k in found if i is not None)
                held.append([i for i, _ in found])
                often.append([k for _, k in found])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "often"])

    return read


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _impacts(weights: np.ndarray, documents: int, words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = _flat(batch.column("terms"))
            often, _ = _flat(batch.column("often"))
            n = batch.column("n").to_numpy()
            m = 50 + (50 * n * documents) // words
            row = np.repeat(np.arange(len(n)), np.diff(at))
            impact = weights[held] * ((1_000_000_000 * often) // (1000 * often + 20 * m[row]))
            norm = np.sqrt(np.bincount(row, impact.astype(float) ** 2, len(n)))
            values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(impact, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(norm), batch.column("terms"), values], ["row", "doc_id", "norm", "terms", "impacts"])

    return read


class _Bucket:
    """Impact vectors of some documents by coordinate."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        held, at = _flat(batch.column("terms"))
        self.held, self.at, self.norm = held, at, batch.column("norm").to_numpy()
        self.impact = _flat(batch.column("impacts"))[0]
        doc = np.repeat(np.arange(len(self.norm)), np.diff(at))
        order = np.argsort(held, kind="stable")
        self.doc, self.value = doc[order], self.impact[order]
        self.start = np.searchsorted(held[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, held, self.impact)

    def postings(self, coordinates: np.ndarray) -> np.ndarray:
        """Places of the entries of these coordinates."""
        first, last = self.start[coordinates], self.start[coordinates + 1]
        sizes = last - first
        return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def search_bucket(bucket: _Bucket, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, number of documents scored): every document of the bucket that scores ``least`` or more, which is at least 1."""
    none = np.empty(0, np.int64)
    slack = 1 + 1e-9  # covers the rounding of norms
    if math.sqrt(len(query)) * bucket.norm.max(initial=0.0) * slack < least:
        return none, none, 0
    query = query[bucket.most[query] > 0]
    query = query[np.argsort(-bucket.most[query], kind="stable")]
    rest = np.concatenate([np.cumsum(bucket.most[query][::-1])[::-1], [0]])  # what the coordinates from here on can give
    schwarz = np.sqrt(np.arange(len(query), -1, -1)) * bucket.norm.max(initial=0.0) * slack
    focus = int(np.argmax(np.minimum(rest, schwarz) <= least / 4))
    at = bucket.postings(query[:focus])
    partial = np.bincount(bucket.doc[at], bucket.value[at], len(bucket.norm))
    squared = np.bincount(bucket.doc[at], bucket.value[at].astype(float) ** 2, len(bucket.norm))
    left = np.sqrt(len(query) - focus) * np.sqrt(np.maximum(bucket.norm**2 * slack - squared, 0)) + 1
    docs = np.flatnonzero((partial > 0) & (partial + np.minimum(rest[focus], left) >= least))
    # Survivors: all their coordinates of the query, in integers.
    wanted = np.zeros(len(bucket.most), bool)
    wanted[query] = True
    sizes = bucket.at[docs + 1] - bucket.at[docs]
    own = np.repeat(bucket.at[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(docs) else none
    asked = wanted[bucket.held[own]] if len(own) else np.empty(0, bool)
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, np.repeat(np.arange(len(docs)), sizes)[asked], bucket.impact[own][asked])
    keep = scores >= least
    return docs[keep], scores[keep], len(docs)


def _search(queries: dict[int, np.ndarray], least: dict[int, int], size: int, k: int):
    """Walks buckets with rising thresholds; the k best of a task per query."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, int | None, int]]] = {}
        known = dict(least)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = _Bucket(batch, size)
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_numpy()
            for q, query in queries.items():
                docs, scores, _ = search_bucket(bucket, query, known.get(q, 1))
                if not len(docs):
                    continue
                best = held.get(q, []) + [(-int(s), ids[d] is not None, ids[d] or 0, int(rows[d])) for d, s in zip(docs.tolist(), scores.tolist())]
                best.sort()
                held[q] = best = best[:k]
                if len(best) == k:
                    known[q] = max(known.get(q, 1), -best[-1][0])
        out = [(q, row, doc if real else None, -s) for q, best in held.items() for s, real, doc, row in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query", "row", "doc_id", "score"])

    return read


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; lists of tasks are merged ``MERGES`` ways first."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), "row"]
    part = F.pmod(F.xxhash64("row"), F.lit(MERGES))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, most_terms: int = TERMS, head: int = HEAD) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item that score above 0."""
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    questions = _questions(items)
    results = spark.createDataFrame([], FOUND)
    for block in _blocks(questions, most_terms):
        results = results.unionByName(_ranked_block(texts, Asked(block), k, head))
    best = _best(results, k)
    return best.join(questions.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _ranked_block(texts: DataFrame, asked: Asked, k: int, head: int) -> DataFrame:
    size = len(asked.numbers)
    counted = texts.mapInArrow(_frequencies(asked.numbers), "doc_id long, n long, terms array<int>, often array<long>")
    counted = stage(counted.withColumn("row", F.monotonically_increasing_id()), "lexical-terms")
    documents, words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(size, np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[r["term"]] = weight(documents, r["df"])
    vectors = counted.where(F.size("terms") > 0).mapInArrow(_impacts(weights, documents, words), "row long, doc_id long, norm double, terms array<int>, impacts array<long>")
    # Longest first: a file's rows keep their order when read, so the batches of a task are buckets of alike length.
    ordered = stage(vectors.repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row"), "lexical-impacts")
    longest = ordered.orderBy(F.desc("norm"), "row").limit(head).repartition(8, "row")
    first = _best(longest.mapInArrow(_search(asked.queries, {}, size, k), FOUND), k)
    least = {r["query"]: r["score"] for r in first.where(F.col("rank") == k).collect()}
    return stage(ordered.mapInArrow(_search(asked.queries, least, size, k), FOUND), "lexical-found")
