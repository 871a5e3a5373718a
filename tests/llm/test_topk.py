from math import floor, inf, isfinite, nan

import numpy as np

from listwright.llm import topk


def brute(rows, asked, k):
    whole = [(i, [floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q, a in {i: a for i, a in sorted(whole, reverse=True) if i in asked}.items():
        best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b)))[:k]
        out += [(q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def check(spark, rows, asked, k=3, kind="float", **options):
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string").repartition(3)
    got = topk.top(vectors, vectors.where(vectors.vec_id.isin(asked)), k, **options)
    assert sorted(map(tuple, got.collect())) == brute(rows, set(asked), k)


def test_equals_brute_force_in_blocks(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(size=8).astype("float32")]) for i in range(300)]
    check(spark, rows, [0, 50, 100, 150, 200], k=5, query_block=2)


def test_groups_and_long_vectors(spark):
    random = np.random.default_rng(2)
    middles = random.normal(size=(12, 32))
    rows = [(i, [float(x) for x in middles[i % 12] * random.uniform(0.1, 4) + random.normal(size=32) * 0.1]) for i in range(500)]
    check(spark, rows, list(range(0, 500, 50)), k=5)
    check(spark, [(i, [-abs(x) for x in v] if i % 3 else v) for i, v in rows], list(range(0, 500, 50)), k=7, lists=3)


def test_ties_repeats_nulls_and_lengths(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(9)] + [(3, same), (3, [0.0, 0.0, 0.0]), (20, None), (21, []), (22, [nan, 1.0, 1.0]), (23, [inf, 0.0, 0.0]), (24, [None, 0.0, 0.0]), (None, same), (25, [1.0, 2.0]), (26, [1.0]), (27, [-0.5, 0.25, -0.125])]
    check(spark, rows, [0, 3, 20, 22, 24, 25, 26, 27])


def test_different_vectors_under_one_id(spark):
    check(spark, [(0, [1.0] * 4), *((i, [3.0] * 4) for i in range(1, 5)), (5, [10.0, 0.0, 0.0, 0.0]), (5, [0.0, 10.0, 0.0, 0.0])], [0], k=5)


def test_huge_components_stay_exact(spark):
    rows = [(i, [1e6 + i, 3.0 - i, -1e6 * i]) for i in range(12)]
    check(spark, rows, [0, 5], kind="double")


def test_empty(spark):
    check(spark, [], [1])
    check(spark, [(1, [1.0])], [1])
