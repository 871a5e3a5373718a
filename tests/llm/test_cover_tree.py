from math import inf, nan

import numpy as np
from brute import linked

from listwright.llm import cover_tree


def near(random, base, spread, n):
    return [(base + random.normal(scale=spread, size=len(base))) for _ in range(n)]


def data(n=150, seed=5):
    random = np.random.default_rng(seed)
    vectors = list(random.normal(size=(n, 12)))
    for spread in (0.02, 0.08, 0.2):
        vectors += near(random, random.normal(size=12), spread, 25)
    return [list(map(float, v)) for v in vectors]


def brute(rows, limit=0.95):
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    link = lambda i, j: i in unit and j in unit and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or float(unit[i] @ unit[j]) >= limit)
    n = len(rows)
    links = [sum(link(i, j) for j in range(n) if j != i) for i in range(n)]
    roots = linked(n, link)
    smallest = {}
    for (k, _), r in zip(rows, roots):
        if k is not None:
            smallest[r] = min(k, smallest.get(r, k))
    return [(k, n, None if k is None else smallest[r], k is not None and smallest[r] == k) for (k, _), n, r in zip(rows, links, roots)]


def test_traversal_finds_exactly_the_pairs():
    vectors = np.array(data())
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    half = len(vectors) // 2
    a, b = (cover_tree.Tree(list(range(s, s + len(v))), [1] * len(v), v) for s, v in ((0, vectors[:half]), (half, vectors[half:])))
    for left, right in ((a, b), (a, a), (b, b)):
        for limit in (0.3, 0.8, 0.95, 0.999):
            found = cover_tree.traverse(left, right, limit)
            got = {(int(left.nodes[found[0][i]]), int(right.nodes[found[1][j]])) for i, j in zip(*np.nonzero(found[2]))} if found else set()
            cosines = left.points @ right.points.T
            assert got == {(int(left.nodes[i]), int(right.nodes[j])) for i, j in zip(*np.nonzero(cosines >= limit)) if left is not right or i != j}


def test_radii_cover_and_halve():
    vectors = np.array(data())
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    tree = cover_tree.Tree(list(range(len(vectors))), [1] * len(vectors), vectors)
    for depth, radius in enumerate(cover_tree.RADII, 1):
        centres, reach, _ = tree.levels[depth]
        assert reach.max() <= radius + 1e-3 and set(tree.levels[depth - 1][0]) <= set(centres)
    assert [b / a for a, b in zip(cover_tree.RADII, cover_tree.RADII[1:])] == [0.5, 0.5]


def compare(spark, rows, **options):
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, weight int").repartition(3)
    got = cover_tree.link(vectors, **options).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_link_in_small_trees_and_blocks(spark):
    vectors = data()
    rows = list(enumerate(vectors)) + [(900 + i, vectors[3]) for i in range(20)]
    compare(spark, rows, tree=16, grid=60, pivots=4)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, [2.0, 4.0, 6.0]), (3, [-1.0, -2.0, -3.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 0.0, 0.0]), (9, [None, 1.0, 2.0]), (10, [1.0, 2.0]), (11, [1e300, 2e300, 3e300]), (12, [1e-300, 2e-300, 3e-300]), (None, one), (1, one), (13, one)]
    compare(spark, rows)
    assert cover_tree.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
