import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listwright.llm import quality
from listwright.llm.common import fold


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=30))
def test_isotonic_is_the_least_squares_fit(bins):
    weights, sums = np.array([float(w) for w, _ in bins]), np.array([float(min(s, w)) for w, s in bins])
    got = quality.isotonic(weights, sums)
    assert (np.diff(got) >= -1e-12).all()
    held = np.flatnonzero(weights)
    for at, i in enumerate(held):  # the min-max formula
        want = max(min(sums[held[a : b + 1]].sum() / weights[held[a : b + 1]].sum() for b in range(at, len(held))) for a in range(at + 1))
        assert got[i] == pytest.approx(want)


def test_features_approximate_the_gaussian_kernel():
    random = np.random.default_rng(0)
    kernel = quality.Kernel(np.zeros(5), np.ones(5), 20_000, 2.0)
    x = random.normal(size=(6, 5))
    z = kernel.features(x)[:, :20_000]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert z @ z.T == pytest.approx(np.exp(-distance / 8), abs=0.03)


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a", "a a a a", "ä" * 5000, "!!! ###", "x|y|z\nx|y|z"])
def test_statistics_are_finite(text):
    got = quality.statistics(text)
    assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all()


def rows():
    random = np.random.default_rng(1)
    good = [" ".join("".join(chr(97 + int(c)) for c in random.integers(0, 26, int(random.integers(2, 9)))) for _ in range(int(random.integers(20, 80)))) + "." for _ in range(150)]
    return [(i, (t.upper().replace(" ", "!! ") if i % 3 == 0 else t), "x", 0.1) for i, t in enumerate(good)]


def test_learns_what_labels_mark(spark):
    docs = spark.createDataFrame([*rows(), (None, None, "x", 0.0), (900, None, "x", 0.0), (901, "", "x", 0.0), (5, rows()[5][1], "x", 0.0)], "doc_id long, text string, lang string, score double").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)] + [(None, 0), (7, None), (12345, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels, fold(F.col("doc_id"), 5) == 0).collect()
    assert len(got) == 154 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 150]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held)
    same = {r["score"] for r in got if r["doc_id"] == 5}
    assert len(same) == 1


def test_documents_of_one_level_are_ranked(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)], "doc_id long, quality int")
    scores = [r["score"] for r in quality.score(docs, labels, F.lit(False)).collect()]
    assert len(set(scores)) > 140 and 0 <= min(scores) and max(scores) <= 1


def test_sums_over_tasks_equal_one_solve(spark):
    table = [(quality.statistics(t).tobytes(), int(i % 3 != 0)) for i, t, _, _ in rows()]
    model = quality.fit(spark.createDataFrame(table, "statistics binary, quality int").repartition(7))
    x, y = np.array([np.frombuffer(s) for s, _ in table]), np.array([float(q) for _, q in table])
    kernel = quality.Kernel(x.mean(axis=0), x.std(axis=0), quality.FEATURES, quality.WIDTH)
    z = kernel.features(x)
    raw = z @ np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    order = np.argsort(raw)
    assert (np.diff(model(x)[order]) >= 0).all() and (model(x) >= 0.5).tolist() == (raw >= 0.5).tolist()


def test_without_labels_or_documents(spark):
    docs, empty = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert [(r["score"], r["predicted"]) for r in quality.score(docs, empty, F.lit(False)).collect()] == [(0.5, 1)]
    assert quality.score(docs.limit(0), empty, F.lit(False)).count() == 0
