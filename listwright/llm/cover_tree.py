"""Near-duplicate embeddings by dual traversal of cover trees.

Vectors are scaled to length 1, so cosine >= ``COSINE`` means a distance of at most ``sqrt(2 - 2 * COSINE)``. Equal vectors are
folded to one node with a weight. A bounded sample of pivots only decides which nodes share a tree; every tree holds
about ``TREE`` nodes at most. A tree has nested levels with halving radii (``RADII``): each node of a level covers its
descendants within the level's radius, and keeps the distance of the farthest one. Two trees are traversed together from the roots;
a pair of nodes whose distance exceeds the threshold plus both covering radii is dropped with all pairs below it,
so what reaches the last level are exactly the pairs above the threshold, tested there in double precision.

Trees meet on a grid: they are dealt into blocks of about ``GRID`` nodes, and the task of a grid cell holds one block and
streams the other past it. Pairs never leave a task: it reports link counts and, for each connected part, one star of edges.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
rows with a null vec_id (they have no component); vectors link only with vectors of their own length; rows that repeat a vec_id
are vectors of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import map_rows
from listwright.operators.graph import components
from listwright.session import stage

COSINE = 0.95
TREE, GRID, PIVOTS = 1024, 8192, 64
#: Covering radii of the levels below the root (any two unit vectors are within 2); the points themselves are the last level.
RADII = (1.0, 0.5, 0.25)
#: Rounding of distances from single precision, which is used above the last level only.
SLACK = 1e-3


class Tree:
    """nodes, weights, unit vectors; for each level the centres, their covering radii and the place of each one's parent."""

    def __init__(self, nodes: list[int], weights: list[int], vectors: np.ndarray, radii=RADII):
        self.nodes, self.weights, self.points = np.array(nodes), np.array(weights, float), vectors
        self.coarse = vectors.astype(np.float32)
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.coarse @ self.coarse.T)))
        members = [np.arange(len(nodes))]
        centres = [0]
        self.levels = [(np.array([0]), far[0].max(keepdims=True), np.array([0]))]
        for radius in radii:
            below, kept, parents, reach = [], [], [], []
            for parent, (own, centre) in enumerate(zip(members, centres)):
                chosen, nearest = [centre], far[centre, own]
                while nearest.max() > radius:
                    chosen.append(own[nearest.argmax()])
                    nearest = np.minimum(nearest, far[chosen[-1], own])
                owner = far[np.ix_(chosen, own)].argmin(axis=0)
                for i, c in enumerate(chosen):
                    mine = np.union1d(own[owner == i], [c]) if i == 0 else own[owner == i]
                    mine = mine if len(mine) else np.array([c])
                    below.append(mine)
                    kept.append(c)
                    parents.append(parent)
                    reach.append(far[c, mine].max())
            members, centres = below, kept
            self.levels.append((np.array(kept), np.array(reach), np.array(parents)))
        last = np.empty(len(nodes), int)
        for parent, own in enumerate(members):
            last[own] = parent
        self.levels.append((np.arange(len(nodes)), np.zeros(len(nodes), np.float32), last))

    def __getstate__(self):
        return self.nodes, self.weights, self.points, self.levels

    def __setstate__(self, state):
        self.nodes, self.weights, self.points, self.levels = state
        self.coarse = self.points.astype(np.float32)


def traverse(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(places in a, places in b, matrix of the pairs at or above the threshold); both orders of a pair when a is b."""
    limit = sqrt(2 - 2 * cosine) + SLACK
    rows = columns = np.array([0])
    alive = np.ones((1, 1), bool)
    for depth, ((ca, ra, pa), (cb, rb, pb)) in enumerate(zip(a.levels, b.levels)):
        if depth:  # the children of what is alive
            was_row, was_column = np.full(len(a.levels[depth - 1][0]), -1), np.full(len(b.levels[depth - 1][0]), -1)
            was_row[rows], was_column[columns] = np.arange(len(rows)), np.arange(len(columns))
            rows, columns = np.flatnonzero(was_row[pa] >= 0), np.flatnonzero(was_column[pb] >= 0)
            alive = alive[np.ix_(was_row[pa[rows]], was_column[pb[columns]])]
        if depth + 1 < len(a.levels):
            near = a.coarse[ca[rows]] @ b.coarse[cb[columns]].T
            span_a, span_b = ra[rows].astype(np.float32), rb[columns].astype(np.float32)
            alive &= near >= 1 - (limit + span_a[:, None] + span_b[None, :]) ** 2 / 2
        else:
            alive &= a.points[rows] @ b.points[columns].T >= cosine
            if a is b:
                alive &= rows[:, None] != columns[None, :]
        keep_rows, keep_columns = alive.any(axis=1), alive.any(axis=0)
        if not keep_rows.any():
            return None
        rows, columns, alive = rows[keep_rows], columns[keep_columns], alive[np.ix_(keep_rows, keep_columns)]
    return rows, columns, alive


def report(a: Tree, b: Tree, cosine: float) -> list[tuple[int, int, int]]:
    """(node, links, smallest node of its connected part) of each node with a link between the trees."""
    if len(a.points[0]) != len(b.points[0]) or (found := traverse(a, b, cosine)) is None:
        return []
    rows, columns, pairs = found
    left, right = a.nodes[rows], b.nodes[columns]
    part_a, part_b = left, right
    while True:
        new_b = np.minimum(part_b, np.where(pairs, part_a[:, None], np.iinfo(np.int64).max).min(axis=0))
        new_a = np.minimum(part_a, np.where(pairs, new_b[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new_a == part_a).all() and (new_b == part_b).all():
            break
        part_a, part_b = new_a, new_b
    out = list(zip(left.tolist(), (pairs @ b.weights[columns]).astype(int).tolist(), part_a.tolist()))
    if a is not b:
        out += zip(right.tolist(), (a.weights[rows] @ pairs).astype(int).tolist(), part_b.tolist())
    return out


def _nodes(vectors: DataFrame) -> DataFrame:
    """node, vec_id (the smallest), weight, v: the distinct usable vectors, with the vector as given in ``embedding``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    folded = whole.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    return stage(folded.withColumn("node", F.monotonically_increasing_id()), "tree-nodes")


def _unit(vector: list[float]) -> np.ndarray:
    x = np.array(vector, float)
    x /= np.abs(x).max()  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x)


def _trees(nodes: DataFrame, count: int, tree: int, pivots: int) -> DataFrame:
    """tree, part, blob: nodes that are nearest to the same pivot share trees."""
    wanted = max(1, min(pivots, count // tree))
    sample = [_unit(r["embedding"]) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("embedding").collect()]

    def nearest():
        def work(ids, weights, vectors):
            rows = []
            for node, weight, vector in zip(ids, weights, vectors):
                unit = _unit(vector)
                scores = [float(unit @ p) if len(p) == len(unit) else -2.0 for p in sample]
                rows.append((node, weight, len(unit), int(np.argmax(scores)), unit.tobytes()))
            yield rows

        return work

    dealt = stage(map_rows(nodes.select("node", "weight", "embedding"), nearest, "node long, weight long, size int, pivot int, v binary"), "tree-points")
    cells = dealt.groupBy("size", "pivot").agg(F.ceil(F.count("*") / tree).alias("parts"))
    dealt = dealt.join(cells, ["size", "pivot"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.repartition("size", "pivot", "part").sortWithinPartitions("size", "pivot", "part", "node")

    def build(batches):
        import pyarrow as pa

        key, held = None, []

        def row():  # a tree is built once, here, and travels with its levels
            ids, weights, vectors = zip(*held)
            own = Tree(ids, weights, np.frombuffer(b"".join(vectors)).reshape(len(held), -1))
            return pa.RecordBatch.from_pydict({"size": [key[0]], "nodes": [len(held)], "blob": [pickle.dumps(own)]}, schema=pa.schema([("size", pa.int32()), ("nodes", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            for size, pivot, part, node, weight, v in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (size, pivot, part):
                    yield row()
                    held = []
                key = size, pivot, part
                held.append((node, weight, v))
        if held:
            yield row()

    return dealt.select("size", "pivot", "part", "node", "weight", "v").mapInArrow(build, "size int, nodes long, blob binary")


def link(vectors: DataFrame, cosine: float = COSINE, tree: int = TREE, grid: int = GRID, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes = _nodes(rows)
    count = nodes.count()
    trees = stage(_trees(nodes, count, tree, pivots).withColumn("tree", F.monotonically_increasing_id()), "trees")
    blocks = max(1, -(-count // grid))
    block = F.pmod(F.xxhash64("tree"), F.lit(blocks)).cast("int")
    # Cell (a, b), a <= b, holds the trees of block a and streams those of block b.
    sides = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(F.least(i, block).alias("a"), F.greatest(i, block).alias("b"), (block > i).cast("int").alias("streamed")))
    dealt = trees.select("tree", "blob", F.explode(sides).alias("cell")).select("cell.*", "tree", "blob")
    dealt = dealt.repartition("a", "b").sortWithinPartitions("a", "b", "streamed", "tree")

    def meet():
        state = {"cell": None, "trees": []}

        def work(a, b, streamed, _, blobs):
            for cell, passing, blob in zip(zip(a, b), streamed, blobs):
                if cell != state["cell"]:
                    state.update(cell=cell, trees=[])
                own = pickle.loads(blob)
                if cell[0] == cell[1]:
                    yield report(own, own, cosine)
                if cell[0] == cell[1] or passing:
                    for other in state["trees"]:
                        yield report(other, own, cosine)
                if not passing:
                    state["trees"].append(own)

        return work

    found = stage(map_rows(dealt, meet, "node long, links long, part long"), "tree-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("part").alias("b")))
    named = nodes.join(links, "node", "left").join(roots, "node", "left").select("embedding", "first", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(smallest, "root").select("embedding", (F.col("links") + F.col("weight") - 1).alias("links"), "component")
    out = rows.join(named.withColumnRenamed("embedding", "vector"), F.col("vec_id").isNotNull() & (F.col("embedding") == F.col("vector")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
