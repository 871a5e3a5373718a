"""Merkle manifest of a dataset by butterfly exchange: every document gets its own proof up to one root.

The leaves of a source, in order of doc_id, are dealt into aligned partitions of ``fanout ** depth`` leaves. A partition is a
group of rows that one task hashes to its subtree root. The levels above are climbed in rounds: at each round the partitions
that hold the same position below the ``fanout`` neighbouring nodes of a run swap the roots of their subtrees, and every one of
them hashes the parent for itself. After the last round each partition holds the root and all siblings on its way up, so no level is
gathered in one place and nothing is sent down again. The subroots of the sources are the leaves of one more tree, climbed likewise.

A round is one shuffle of a narrow row per partition, joined back on the same key, and is written before the next, so a lost
executor repeats one round at most. The last run of a level may be short: its partitions then send to the positions that are not
filled below it as well. Documents' texts are hashed where they are read; only digests are sorted.

``digest``: lower-case hex sha256; inputs are concatenated, digests as hex text. A leaf is the digest of doc_id, source, lang, n_chars
and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.

Defined cases: null doc_ids come first in their source, equal ones ascend by leaf and repeated rows are leaves of their own; the
null source comes first; an empty text is no null; a source of one leaf has that leaf as subroot, a single source its subroot as root;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import pick
from listwright.operators.skew import GROUP_LIMIT, ranked
from listwright.session import stage

#: Children of a node, and levels hashed inside one partition (256 leaves).
FANOUT, DEPTH = 16, 2
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEP = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: dict[str, Column]) -> Column:
    cells = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return digest(F.concat(*cells))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, start, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], fanout: int, height: int) -> list[list[str]]:
    """The nodes of a partition level by level, ``height`` levels above its leaves."""
    out = [nodes]
    for _ in range(height):
        out.append([_hash(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _height(n: int, fanout: int, depth: int) -> int:
    """Levels hashed inside a partition of a tree of ``n`` leaves: until one node remains, ``depth`` at most."""
    height = 0
    while height < depth and fanout**height < n:
        height += 1
    return height


def _bottom(fanout: int, depth: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        data = rows.sort_by("place").to_pydict()
        (node,) = _levels(data["digest"], fanout, _height(data["n"][0], fanout, depth))[-1]
        return pa.table({"tree": [data["tree"][0]], "part": [data["part"][0]], "n": [data["n"][0]], "node": [node]})

    return run


def climb(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(tree, part, n, node, way) of leaves (tree, place, n, part, digest): each partition's root and its siblings on the way there."""
    roots = leaves.groupBy("tree", "part").applyInArrow(_bottom(fanout, depth), "tree long, part long, n long, node string")
    state = stage(roots.withColumn("way", F.array().cast(_STEP)), "merkle-round")
    size, below = fanout**depth, 1  # leaves of a partition, partitions below a node
    most = state.agg(F.max("n")).first()[0] or 0
    while most > size * below:
        nodes = F.ceil(F.col("n") / (size * below)).cast("long")
        spots = {"at": F.floor(F.col("part") / below), "seat": F.col("part") % below, "nodes": nodes}
        here = state.withColumns(spots).withColumn("run", F.floor(F.col("at") / fanout))
        climbing = here.where("nodes > 1")
        # The partitions below the last node of a level fill all its seats between them.
        held = F.ceil(F.col("n") / size).cast("long") - (F.col("nodes") - 1) * below
        seats = F.when((F.col("at") == F.col("nodes") - 1) & (held < below), F.sequence(F.col("seat"), F.lit(below - 1).cast("long"), held)).otherwise(F.array("seat"))
        sent = climbing.select("tree", "run", "at", "node", F.explode(seats).alias("seat"))
        swapped = sent.groupBy("tree", "run", "seat").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("nodes"))
        names = lambda keep: F.array_join(F.transform(F.filter(F.col("met.nodes"), keep), lambda x: x["node"]), "")
        own = F.col("s.at")
        joined = climbing.drop("nodes").alias("s").join(swapped.alias("met"), ["tree", "run", "seat"])
        step = F.struct(names(lambda x: x["at"] < own).alias("before"), names(lambda x: x["at"] > own).alias("after"))
        parent = digest(names(lambda x: F.lit(True)))
        moved = joined.select("tree", "s.part", "s.n", parent.alias("node"), F.concat("s.way", F.array(step)).cast(_STEP).alias("way"))
        state = stage(moved.unionByName(here.where("nodes <= 1").select(*state.columns)), "merkle-round")
        below *= fanout
    return state


def _proofs(fanout: int, depth: int):
    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n, digests = rows.column("n")[0].as_py(), rows.column("digest").to_pylist()
        levels = _levels(digests, fanout, _height(n, fanout, depth))
        (rest,) = above.column("way").to_pylist()
        proofs = []
        for i in range(len(digests)):
            proof = []
            for nodes in levels[:-1]:
                first = i - i % fanout
                proof.append({"before": "".join(nodes[first:i]), "after": "".join(nodes[i + 1 : first + fanout])})
                i //= fanout
            proofs.append(proof + rest)
        steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        root = above.column("node")[0].as_py()
        return pa.table({"tree": rows.column("tree"), "place": rows.column("place"), "proof": pa.array(proofs, steps), "root": pa.array([root] * len(digests), pa.string())})

    return run


def proofs(leaves: DataFrame, states: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(tree, place, proof, root) of every leaf: its siblings inside its partition, then those of the partition's way."""
    slim = leaves.select("tree", "part", "place", "n", "digest").groupBy("tree", "part")
    above = states.select("tree", "part", "node", "way").groupBy("tree", "part")
    return slim.cogroup(above).applyInArrow(_proofs(fanout, depth), f"tree long, place long, proof {_STEP}, root string")


def _planted(rows: DataFrame, fanout: int, depth: int) -> DataFrame:
    return rows.withColumn("part", F.floor(F.col("place") / fanout**depth).cast("long"))


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH, limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, source, place (in its source, from 0), leaf, subroot, root and proof (array of the digests before and after the node of
    each level, concatenated) of every row. ``also`` computes further columns from the fields of a document, where its text is read."""
    extra = list(also or {})
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "source", leaf({f: F.col(f) for f in FIELDS}).alias("leaf"), *[c.alias(n) for n, c in (also or {}).items()]]
    rows = pick(docs, *FIELDS).select(*columns)
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf")]
    placed = stage(ranked(rows, order, "rank", limit), "merkle-leaves")
    sources = placed.groupBy("source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    # Sources are numbered by their order; the number stands for the name, null among them, from here on.
    named = stage(ranked(sources, [F.col("source").asc_nulls_first()], "tree", limit).withColumn("tree", F.col("tree") - 1), "merkle-sources")
    own = named.select(F.col("source").alias("_s"), "tree", "first", "n")
    leaves = placed.join(own, F.col("source").eqNullSafe(F.col("_s"))).withColumns({"place": F.col("rank") - F.col("first"), "digest": F.col("leaf")})
    leaves = stage(_planted(leaves.select("tree", "place", "n", "digest", "source", "doc_id", *extra), fanout, depth), "merkle-leaves")
    states = climb(leaves, fanout, depth)
    subroots = states.where("part = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("node").alias("digest"))
    upper = stage(_planted(subroots.withColumn("n", F.lit(named.count()).cast("long")), fanout, depth), "merkle-subroots")
    ways = proofs(upper, climb(upper, fanout, depth), fanout, depth).select(F.col("place").alias("tree"), F.col("proof").alias("rest"), "root")
    over = stage(states.join(ways, "tree").select("tree", "part", "node", F.concat("way", "rest").alias("way"), "root"), "merkle-ways")
    found = _with_proofs(leaves, over, extra, fanout, depth)
    return found.select("doc_id", "source", "place", "leaf", "subroot", "root", "proof", *extra)


def _with_proofs(leaves: DataFrame, over: DataFrame, extra: list[str], fanout: int, depth: int) -> DataFrame:
    """Leaves with their whole proofs; a partition and its way up meet in one group of at most ``fanout ** depth`` rows."""
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    kept = ["doc_id", "source", *extra]
    make = _proofs(fanout, depth)

    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        found = make(key, rows, above)
        root = pa.array([above.column("root")[0].as_py()] * len(rows), pa.string())
        columns = {"place": rows.column("place"), "leaf": rows.column("digest"), "subroot": found.column("root"), "root": root, "proof": found.column("proof")}
        return pa.table({**columns, **{c: rows.column(c) for c in kept}})

    schema = f"place long, leaf string, subroot string, root string, proof {_STEP}, " + ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return leaves.groupBy("tree", "part").cogroup(over.groupBy("tree", "part")).applyInArrow(run, schema)
