"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct shingles of ``N`` words as 64-bit hashes. Equal sets are folded to one node first. Then

1. groups: nodes that agree in two MinHash values share a bucket, each bucket's best connected node is its centre,
   and every node is compared exactly with the centre it shares most buckets with. The components of these links are
   the groups: real links, so nothing in a group has to be compared again.
2. matrix: tokens are ordered by how often they occur (from tables of fixed size over all documents: which tokens
   some task met twice, and how often each occurs), rarest first. Of a similar pair the rarest token they share stands in both prefixes of ``n - ceil(0.75 n) + 1`` tokens, with
   enough tokens left behind it (positional filter). The matrix holds one row per token and group, with the
   group's range of set sizes. Groups with a token in common that passes the length and positional filters are candidates. A token
   that more than ``CROWD`` groups hold first compares each of them with one of them only, the one with the fewest rarer tokens ahead of it
   and so the least of its own: what is linked with it joins it, and near copies that missed their centre don't meet one another in pairs.
3. bound: the nodes of the smaller group ask the blocks (up to about ``BLOCK`` nodes) of the other one. A block's token union
   bounds the overlap with each of its nodes; only where the bound reaches 0.75 of the query is the block opened and
   its nodes compared exactly. Before whole sets are moved, parity bits of fixed size, which differ no more than the
   sets do, rule out most queries and nodes. A query needs one link to a group, since the group is connected already.

The components of all links are exact: what isn't compared is already connected or can't link. A hot token, group or
centre is never gathered: the matrix has one row per token and group, blocks have a bounded size, and the queries of a
block are dealt out by their number. Sets are made again from the texts where they are needed, instead of being kept: a fixed
table of hashed ids (``BITS``) chooses the texts, and an exact join follows.

Two different sets with one 64-bit hash would count as copies; for a billion documents the chance is below 3 %.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; fewer than ``N`` words are one
shingle; rows with a null doc_id take no part and have no component; rows that share a doc_id are compared each for
itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh3_64_intdigest

from listwright.llm.common import add_up, map_rows, quoted
from listwright.operators.graph import components
from listwright.session import stage

N = 5
#: Jaccard threshold as a fraction; the filters below follow from it.
ABOVE, BELOW = 3, 4
#: MinHash values, two to a bucket.
HASHES = 16
#: Fixed sizes, as powers of two: counters of token counts, bits of repeated tokens, hashed ids that choose texts.
COUNTERS, MARKS, BITS = 20, 26, 20
#: Parity bits of a set.
PARITY = 4096
#: Nodes of a block, queries of one task's share of a block, buckets a node has to share with its centre.
BLOCK, SHARE, VOTES = 64, 512, 2
#: Groups that may hold a token before one of them is asked first.
CROWD = 16
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BUCKETS = [f"b{i}" for i in range(HASHES // 2)]


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``n`` words; bytes.split() parts at exactly the ASCII white space."""
    words = (text or b"").lower().split()
    if len(words) < n:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    runs = len(words) - n + 1
    mixed = hashes[:runs] * _STEP
    for i in range(1, n):
        mixed = (mixed + hashes[i : runs + i]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def node_of(tokens: np.ndarray) -> int:
    return _signed(xxh3_64_intdigest(tokens.tobytes()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common values of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def similar(shared: int, a: int, b: int) -> bool:
    return BELOW * shared >= ABOVE * (a + b - shared)


def prefix(n: int) -> int:
    return n - -(-ABOVE * n // BELOW) + 1


def _profile(docs: DataFrame) -> DataFrame:
    """One pass: a row per document (kind 0: doc_id, n, node, MinHash buckets), the token counts of each task (kind 1) and the tokens a task met twice (kind 2)."""
    names = ["kind", "doc_id", "n", "node", *BUCKETS, "chunk", "counts"]
    schema = ", ".join(f"{c} {'binary' if c == 'counts' else 'long'}" for c in names)
    chunk = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, open_sets, waiting = np.zeros(1 << COUNTERS, np.int64), [], 0
        met, twice = np.zeros((1 << MARKS) // 8, np.uint8), []
        shift, mark_shift = np.uint64(64 - COUNTERS), np.uint64(64 - MARKS)
        add = lambda: counts + np.bincount(np.concatenate(open_sets).astype(np.int64), minlength=len(counts))
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = shingles(text)
                if not len(tokens):
                    rows.append((0, doc_id, 0, None, *[None] * len(BUCKETS), None, None))
                    continue
                least = (_MULTIPLIERS[:, None] * tokens).min(axis=1)
                buckets = ((least[0::2] * _STEP) ^ least[1::2]).astype(np.int64).tolist()
                rows.append((0, doc_id, len(tokens), node_of(tokens), *buckets, None, None))
                marks = (tokens >> mark_shift).astype(np.int64)
                byte, bit = marks >> 3, np.left_shift(1, marks & 7).astype(np.uint8)
                twice.append(marks[met[byte] & bit > 0])
                first = np.flatnonzero(np.diff(byte, prepend=-1))  # the marks ascend, so those of one byte are neighbours
                met[byte[first]] |= np.bitwise_or.reduceat(bit, first)
                open_sets.append(tokens >> shift)
                waiting += len(tokens)
                if waiting > len(counts):
                    counts, open_sets, waiting, twice = add(), [], 0, [np.unique(np.concatenate(twice))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "counts" else pa.int64()) for c, k in zip(zip(*rows), names)], names=names)
        if open_sets:
            counts = add()
        if counts.any():
            blank = [None] * (3 + len(BUCKETS))
            rows = [(1, *blank, i, counts[i * chunk : (i + 1) * chunk].astype("<i8").tobytes()) for i in range(len(counts) // chunk)]
            marks = np.unique(np.concatenate(twice))
            edges = np.searchsorted(marks, np.arange(0, (1 << MARKS) + 1, 1 << COUNTERS))
            rows += [(2, *blank, i, marks[a:b].astype("<i4").tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "counts" else pa.int64()) for c, k in zip(zip(*rows), names)], names=names)

    return stage(docs.mapInArrow(run, schema), "jaccard-profile")


def _repeated(profile: DataFrame) -> np.ndarray:
    """Packed bits of the tokens some task met twice; of fixed size."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, marks in zip(*(c.to_pylist() for c in batch.columns)):
                own = bits.setdefault(chunk, np.zeros(1 << COUNTERS, bool))
                own[np.frombuffer(marks, "<i4") & ((1 << COUNTERS) - 1)] = True
        if bits:
            yield pa.RecordBatch.from_pydict({"chunk": list(bits), "marks": [np.packbits(b, bitorder="little").tobytes() for b in bits.values()]}, schema=pa.schema([("chunk", pa.int64()), ("marks", pa.binary())]))

    size = (1 << COUNTERS) // 8
    out = np.zeros((1 << MARKS) // 8, np.uint8)
    for row in profile.where("kind = 2").select("chunk", "counts").repartition("chunk").mapInArrow(union, "chunk long, marks binary").collect():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["marks"], np.uint8)
    return out


def _levels(profile: DataFrame) -> np.ndarray:
    """Twice the logarithm of each counter, plus one; a fixed number of rows reaches the driver."""

    sums = add_up(profile.where("kind = 1").select("chunk", F.col("counts").alias("values")), "<i8")
    counts = np.concatenate([sums[i] for i in sorted(sums)]) if sums else np.zeros(1 << COUNTERS)
    return 1 + np.floor(2 * np.log2(counts + 1)).astype(np.uint8)


def _prefixes(texts: DataFrame, levels: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """token, node, size (set size in the upper, tokens from this one on in the lower 32 bits) for the prefix of each document."""
    shared = texts.sparkSession.sparkContext.broadcast((levels, repeated))
    names = ["token", "node", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, marked), shift, mark_shift = shared.value, np.uint64(64 - COUNTERS), np.uint64(64 - MARKS)
        out: list[tuple[np.ndarray, ...]] = []
        rows = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = shingles(text)
                if (n := len(tokens)) == 0:
                    continue
                marks = (tokens >> mark_shift).astype(np.int64)
                often = (marked[marks >> 3] >> (marks & 7).astype(np.uint8)) & 1
                # Sorted by value already, so a stable sort orders by (met once or how often, token).
                first = np.argsort(level[tokens >> shift] * often, kind="stable")[: prefix(n)]
                out.append((tokens[first].astype(np.int64), np.full(len(first), node_of(tokens)), (n << 32) + n - np.arange(len(first), dtype=np.int64)))
                rows += len(first)
                if rows > 100_000:
                    yield flush()
                    out, rows = [], 0
        if out:
            yield flush()

    return texts.mapInArrow(run, "token long, node long, size long")


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each of PARITY counters: whether an odd number of tokens fell on it. Sets that differ in d tokens differ in d bits at most."""
    odd = np.bincount((tokens & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _sets(docs: DataFrame, wanted: DataFrame, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """node, n, payload (``form`` of the sorted hashes) of the wanted (node, doc_id)."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS)).cast("int").alias("bit")
    bits = wanted.select(bit(F.col("rep"))).distinct()  # 2 ** BITS rows at most
    some = docs.select("doc_id", "text", bit(F.col("doc_id"))).join(F.broadcast(bits), "bit", "left_semi").select("doc_id", "text")

    def make():
        def work(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                if len(tokens := shingles(text)):
                    rows.append((doc_id, node_of(tokens), len(tokens), form(tokens)))
                if len(rows) >= 2_000:
                    yield rows
                    rows = []
            yield rows

        return work

    found = map_rows(some, make, "doc_id long, node long, n int, payload binary")
    found = found.join(wanted.select("node", "rep"), "node").where("doc_id = rep")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))


def _meet(sets: DataFrame, blocks: DataFrame, queries: DataFrame, answer: Callable[[list, int, int, bytes], list[int]]) -> DataFrame:
    """block, slice, a, b: what ``answer`` gives for the nodes (node, n, payload) of a block and each of its queries.

    The queries of a block are dealt into shares by their number; a share gets its own copy of the block.
    """
    key = ["block", "slice"]
    load = queries.groupBy(*key).agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    held = blocks.join(load, key).select(*key, "node", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("asks"))
    asked = queries.join(load, key).select(*key, "node", F.pmod(F.xxhash64("node"), "shares").alias("share"), F.lit(1).alias("asks"))
    rows = held.unionByName(asked).join(sets, "node")
    rows = rows.repartition("block", "slice", "share").sortWithinPartitions("block", "slice", "share", "asks")

    def make():
        state = {"key": None, "nodes": []}

        def work(block, part, share, asks, nodes, sizes, payloads):
            found = []
            for k, asking, node, n, payload in zip(zip(block, part, share), asks, nodes, sizes, payloads):
                if k != state["key"]:
                    state.update(key=k, nodes=[])
                if asking and state["nodes"]:  # a slice may have got no node
                    found += [(k[0], k[1], node, other) for other in answer(state["nodes"], node, n, payload)]
                elif not asking:
                    state["nodes"].append((node, n, payload))
            yield found

        return work

    return map_rows(rows.select("block", "slice", "share", "asks", "node", "n", "payload"), make, "block long, slice int, a long, b long")


def _possible(held: list[tuple[int, int, bytes]], node: int, n: int, payload: bytes) -> list[int]:
    """The nodes whose parity bits allow a link: sets at the threshold differ in a seventh of their sizes at most."""
    bits = np.frombuffer(payload, np.uint64)
    differ = np.bitwise_count(np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(len(held), -1) ^ bits).sum(axis=1)
    return [other for (other, m, _), d in zip(held, differ) if other != node and (ABOVE + BELOW) * int(d) <= (BELOW - ABOVE) * (n + m)]


def _linked(held: list[tuple[int, int, bytes]], node: int, n: int, payload: bytes) -> list[int]:
    """One similar node of the block, if there is one: the block is opened only if its token union holds enough of the query."""
    tokens = np.frombuffer(payload, np.uint64)
    sets = [np.frombuffer(h[2], np.uint64) for h in held]
    union = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
    if BELOW * overlap(tokens, union) < ABOVE * n:
        return []
    for (other, m, _), theirs in zip(held, sets):
        if other != node and BELOW * min(n, m) >= ABOVE * max(n, m) and similar(overlap(tokens, theirs), n, m):
            return [other]
    return []


def _links(docs: DataFrame, nodes: DataFrame, blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """a, b: for each query (block, slice, node) one similar node of its block (block, slice, node), if there is one.

    Parity bits, a fraction of the sets' size, go first and leave few queries and nodes for the sets themselves.
    """
    named = lambda *parts: nodes.join(reduce(lambda x, y: x.unionByName(y), [p.select("node") for p in parts]).distinct(), "node", "left_semi")
    possible = stage(_meet(_sets(docs, named(blocks, queries), parity), blocks, queries, _possible), "jaccard-possible")
    asked = possible.select("block", "slice", F.col("a").alias("node")).distinct()
    opened = possible.select("block", "slice", F.col("b").alias("node")).distinct()
    return stage(_meet(_sets(docs, named(asked, opened), np.ndarray.tobytes), opened, asked, _linked).select("a", "b"), "jaccard-links")


def _centres(nodes: DataFrame) -> DataFrame:
    """node, centre: the centre a node shares most buckets with, VOTES at least. A bucket's centre is its node with the most bucket fellows."""
    in_bucket = nodes.select("node", "n", F.posexplode(F.array(*BUCKETS)).alias("at", "bucket"))
    sizes = in_bucket.groupBy("at", "bucket").agg(F.count("*").alias("fellows")).where("fellows > 1")
    known = stage(in_bucket.join(sizes, ["at", "bucket"]), "jaccard-buckets")
    weight = known.groupBy("node").agg(F.sum("fellows").alias("weight"))
    ranked = known.join(weight, "node")
    best = ranked.groupBy("at", "bucket").agg(F.max(F.struct("weight", "node", "n")).alias("best")).select("at", "bucket", F.col("best.node").alias("centre"), F.col("best.n").alias("size"))
    alike = (F.least("n", "size") * BELOW >= F.greatest("n", "size") * ABOVE) & (F.col("node") != F.col("centre"))
    votes = ranked.join(best, ["at", "bucket"]).where(alike).groupBy("node", "centre").count().where(F.col("count") >= VOTES)
    return votes.groupBy("node").agg(F.max(F.struct("count", "centre"))["centre"].alias("centre"))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, group for every node: the root of its component, or itself."""
    roots = components(edges)
    return nodes.join(roots, "node", "left").select("node", "n", "rep", F.coalesce("root", "node").alias("group"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """node, n, rep, group for every node, with the groups that the links (a, b: nodes) connect as one."""
    name = groups.select("node", "group")
    between = links.join(name.withColumnsRenamed({"node": "a", "group": "ga"}), "a").join(name.withColumnsRenamed({"node": "b", "group": "gb"}), "b")
    roots = components(between.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("group"), "root")
    return groups.join(roots, "group", "left").select("node", "n", "rep", F.coalesce("root", "group").alias("group"))


def _matrix(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """token, group, least, most, room: the group's range of set sizes and most tokens from this one on, one row per token and group."""
    n, room = F.shiftright("size", 32), F.col("size").bitwiseAND(F.lit(0xFFFFFFFF))
    return prefixes.join(groups.select("node", "group"), "node").groupBy("token", "group").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.max(room).alias("room"))


def _second(matrix: DataFrame) -> DataFrame:
    return matrix.select("token", *(F.col(c).alias(f"{c}2") for c in ("group", "least", "most", "room")))


def _may_link() -> Column:
    """The length and positional filters of two groups that hold a token."""
    lengths = (F.col("least") * ABOVE <= F.col("most2") * BELOW) & (F.col("least2") * ABOVE <= F.col("most") * BELOW)
    return lengths & (F.least("room", "room2") * (ABOVE + BELOW) >= (F.col("least") + F.col("least2")) * ABOVE)


def _crowds(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: each group that holds crowded tokens, and the group that leads most of them; as many pairs as groups at most."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("nodes"))
    held = matrix.groupBy("token").agg(F.count("*").alias("groups")).where(F.col("groups") > CROWD).select("token")
    crowd = stage(matrix.join(held, "token").join(sizes, "group"), "jaccard-crowd")
    most = F.max(F.struct((F.col("room") - F.col("most")).alias("ahead"), "nodes", "group", "least", "most", "room")).alias("lead")
    leads = crowd.groupBy("token").agg(most).select("token", *(F.col(f"lead.{c}").alias(f"{c}2") for c in ("nodes", "group", "least", "most", "room")))
    votes = crowd.join(leads, "token").where((F.col("group") != F.col("group2")) & _may_link()).groupBy("group", "nodes2", "group2").agg(F.count("*").alias("votes"))
    return votes.groupBy("group").agg(F.max(F.struct("votes", "nodes2", "group2"))["group2"].alias("b")).select(F.col("group").alias("a"), "b")


def _candidates(matrix: DataFrame) -> DataFrame:
    """a, b: pairs of groups that share a prefix token and pass the length and positional filters."""
    return matrix.join(_second(matrix), "token").where((F.col("group") < F.col("group2")) & _may_link()).select(F.col("group").alias("a"), F.col("group2").alias("b")).distinct()


def _between(docs: DataFrame, nodes: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: links of nodes between the given pairs (a, b) of groups; the smaller one's nodes ask the blocks of the larger one."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    first, second = sizes.select(F.col("group").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("group").alias("b"), F.col("size").alias("size_b"))
    sided = pairs.join(first, "a").join(second, "b").withColumn("swap", F.col("size_a") > F.col("size_b"))
    sided = sided.select(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("group"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("block"), F.ceil(F.greatest("size_a", "size_b") / BLOCK).alias("slices"))
    sided = stage(sided, "jaccard-pairs")
    asking = sided.join(groups.select("group", "node"), "group").select("block", "node", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))).alias("slice"))
    opened = sided.select(F.col("block").alias("group"), "slices").distinct().join(groups.select("group", "node"), "group")
    opened = opened.select(F.col("group").alias("block"), "node", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"))
    return _links(docs, nodes, opened, asking)


def _linked_rows(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, node, component_id and first: whether the row has its component's smallest (doc_id, node)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    profile = _profile(texts)
    levels, repeated = _levels(profile), _repeated(profile)
    rows = profile.where("kind = 0").select("doc_id", "n", "node")
    nodes = profile.where("kind = 0 and doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), *(F.min(b).alias(b) for b in BUCKETS))
    nodes = stage(nodes, "jaccard-nodes")

    centres = stage(_centres(nodes), "jaccard-centres")
    around = centres.select(F.col("centre").alias("block"), F.lit(0).alias("slice"), "node")
    middles = centres.select(F.col("centre").alias("block"), F.lit(0).alias("slice"), F.col("centre").alias("node")).distinct()
    groups = stage(_labels(nodes, _links(texts, nodes, middles, around)), "jaccard-groups")

    of_token = Window.partitionBy("token")
    prefixes = _prefixes(texts.where("doc_id is not null").select("text"), levels, repeated)
    shared = prefixes.withColumn("low", F.min("node").over(of_token)).withColumn("high", F.max("node").over(of_token)).where("low < high").drop("low", "high")
    prefixes = stage(shared.distinct(), "jaccard-prefixes")
    matrix = stage(_matrix(prefixes, groups), "jaccard-matrix")
    crowds = stage(_crowds(matrix, groups), "jaccard-crowds")
    if not crowds.isEmpty():
        groups = stage(_joined(groups, _between(texts, nodes, groups, crowds)), "jaccard-groups")
        matrix = _matrix(prefixes, groups)
    whole = _joined(groups, _between(texts, nodes, groups, _candidates(matrix))).withColumnRenamed("group", "root")
    smallest = whole.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("least"))
    named = whole.join(smallest, "root").select("node", F.col("least.rep").alias("component"), (F.col("node") == F.col("least.node")).alias("leads"))
    out = rows.join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n", "node", component.alias("component_id"), (F.col("leads") & (F.col("doc_id") == F.col("component"))).alias("first"))


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked to directly or through others, itself included)."""
    return _linked_rows(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


@F.pandas_udf(LongType())
def _nodes(texts: pd.Series) -> pd.Series:
    return pd.Series([node_of(tokens) if len(tokens := shingles(text)) else None for text in texts], dtype="Int64")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component one row, that of the smallest doc_id and then node, the first by text.

    Rows are told apart by doc_id and node, so rows that share a doc_id are decided each for itself. Rows without
    doc_id and rows with an empty set are linked with nothing and stay.
    """
    own = [quoted(c) for c in docs.columns]
    linked = stage(_linked_rows(docs).where("doc_id is not null and node is not null").select("doc_id", "node", "first"), "jaccard-components")
    ids = linked.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("first").alias("first"))
    text = F.col("text").cast("binary")
    blank = F.coalesce(~F.decode(text, "ISO-8859-1").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    # A doc_id on one row with a set stands for that row; only of the others the node is made again from the text.
    once = docs.join(ids.where("rows > 1 or not first").select("doc_id"), "doc_id", "left_anti").select(*own)
    empty = docs.where(blank).join(ids.where("rows > 1 or not first").select("doc_id"), "doc_id", "left_semi").select(*own)
    repeated = docs.where(~blank).join(ids.where("rows > 1").select("doc_id"), "doc_id", "left_semi")
    repeated = repeated.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _nodes(text).alias("node"))
    several = repeated.join(linked.where("first").select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    several = several.groupBy("doc_id", "node").agg(F.min_by("row", "row.text").alias("row")).select("row.*")
    return once.unionByName(empty).unionByName(several)
