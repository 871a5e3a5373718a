import hashlib
import random

from pyspark.sql import functions as F

from listwright.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(docs, fanout):
    """(doc_id, leaf, subroot, root, proof) by building whole trees."""
    cell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    by_source = {}
    for d in docs:
        by_source.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, H("".join(map(cell, d))), d[0]))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for j, i in enumerate(at):
                first = i - i % fanout
                paths[j].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
                at[j] = i // fanout
            nodes = [H("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        return nodes[0] if nodes else None, paths

    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([leaf for _, _, leaf, _ in sorted(by_source[s])]) for s in names}
    root, upper = tree([built[s][0] for s in names])
    out = []
    for s, rest in zip(names, upper):
        for (_, _, leaf, doc_id), path in zip(sorted(by_source[s]), built[s][1]):
            out.append((doc_id, leaf, built[s][0], root, tuple(path + rest)))
    return sorted(out, key=repr)


def check(spark, docs, fanout=3, depth=1, **options):
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, source string, lang string, n_chars int, text string, `a.b` int, TEXT string").repartition(4)
    found = merkle.manifest(df, None, fanout, depth, **options).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("siblings", merkle.siblings(F.col("proof"))).collect()
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in found), key=repr)
    assert got == plain(docs, fanout)
    assert all(r.folded == r.root and r.siblings == "".join(a + b for a, b in r.proof) for r in found)


def test_many_sizes_of_sources(spark):
    docs, i = [], 0
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 29, 55, 81, 82, 100, 163]):
        for _ in range(n):
            docs.append((i, f"s{s}", "en", 3, f"t{i}"))
            i += 1
    random.Random(1).shuffle(docs)
    check(spark, docs)
    check(spark, docs, fanout=2, depth=2, limit=50)
    check(spark, docs, fanout=16, depth=2)


def test_nulls_ties_repeats_empty_and_long_texts(spark):
    docs = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "de", 0, ""), (1, "ä", "de", 1, "a"), (1, "ä", "de", 1, "b"), (1, "ä", "de", 1, "b"), (2, "z", None, 9, "-"), (3, "", "x", 1, "y" * 2_000_000), (4, "😀", "x", 1, "ü")]
    check(spark, docs)
    check(spark, docs[:1])


def test_no_rows(spark):
    check(spark, [])


def test_a_changed_text_is_found(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"Text {i}") for i in range(40)], "doc_id long, source string, lang string, n_chars int, text string")
    tampered = merkle.leaf({**{f: F.col(f) for f in merkle.FIELDS}, "text": F.lower("text")})
    rows = merkle.manifest(df, {"other": tampered}, 4, 1).withColumn("folded", merkle.fold(F.col("other"), F.col("proof"))).collect()
    assert len(rows) == 40 and all(r.folded != r.root for r in rows)


def test_partitions_agree_on_the_root(spark):
    leaves = spark.range(200).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("place"), F.lit(200).cast("long").alias("n"), F.floor(F.col("id") / 2).cast("long").alias("part"), merkle.digest(F.col("id").cast("string")).alias("digest"))
    states = merkle.climb(leaves, 2, 1).collect()
    assert len(states) == 100 and len({r.node for r in states}) == 1
