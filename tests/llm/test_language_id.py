import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import language_id
from listwright.llm.common import fold

WORDS = {"aa": ["lorema", "ipsuma", "dolora", "sita"], "bb": ["quix", "foxx", "jumpx", "lazyx"], "cc": ["übero", "straßo", "größo"]}


def chain():
    random = np.random.default_rng(2)
    runs = {k: [[w[int(i)] for i in random.integers(0, len(w), 20)] for _ in range(30)] for k, w in WORDS.items()}
    return language_id.fit(runs)


CHAIN = chain()


def brute(scores, moves):
    """Posteriors by adding up all labellings."""
    n = scores.shape[1]
    out = np.zeros_like(scores)
    for before in range(n):
        for labels in itertools.product(range(n), repeat=len(scores)):
            weight = np.exp(sum(scores[t, k] for t, k in enumerate(labels)) + sum(moves[a, b] for a, b in zip((before, *labels), labels)))
            for t, k in enumerate(labels):
                out[t, k] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_posteriors_equal_all_labellings(monkeypatch):
    monkeypatch.setattr(language_id, "STEP", 3)
    random = np.random.default_rng(4)
    model = language_id.Chain(["a", "b", "c"], [])
    model.moves = random.normal(size=(3, 3))
    lengths = np.array([1, 7, 3, 2, 6])
    scores = random.normal(size=(lengths.sum(), 3)) * 3
    got = model.posteriors(scores, lengths)
    for start, n in zip(np.cumsum(lengths) - lengths, lengths):
        assert got[start : start + n] == pytest.approx(brute(scores[start : start + n], model.moves))


def test_code_switched_words_are_labelled_where_they_stand():
    words = WORDS["aa"] * 5 + WORDS["bb"] * 5 + WORDS["cc"] * 4
    labels = CHAIN.posteriors(CHAIN.score(words), np.array([len(words)])).argmax(axis=1)
    assert labels.tolist() == [0] * 20 + [1] * 20 + [2] * 12
    assert CHAIN.moves.diagonal().min() > (CHAIN.moves - np.eye(3) * 99).max()


def test_labels_of_odd_texts():
    texts = [None, "", "123 !?", "½ ²", "lorema", "lorema " * 30_000, "Übero STRASSO größo", "foxx 12 quix"]
    got = list(language_id.Labeller(CHAIN).label(texts))
    assert [g[0] for g in got] == ["und"] * 4 + ["aa", "aa", "cc", "bb"]
    assert all(g == ("und", 0.0) for g in got[:4]) and all(0 < s <= 1 for _, s in got[4:])
    assert list(language_id.Labeller(None).label(["x", None])) == [("und", 0.0)] * 2


def test_tables(spark):
    random = np.random.default_rng(6)
    rows = [(i, " ".join(WORDS[k][int(j)] for j in random.integers(0, len(WORDS[k]), 12)), k, 0.5) for i in range(120) for k in ("aa", "bb")[i % 2 : i % 2 + 1]]
    rows += [(500, "quix lazyx", None, 0.0), (None, "quix lazyx", "zz", 0.0), (501, None, "aa", 0.0), (502, "", "bb", 0.0), (500, "quix lazyx", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    model = language_id.learn(docs, fold(F.col("doc_id"), 3) != 1)
    assert model.languages == ["aa", "bb"]
    got = sorted(map(tuple, language_id.predict(docs, model).select("doc_id", "lang_pred").collect()), key=repr)
    assert got == sorted([(i, k) for i, _, k, _ in rows[:120]] + [(500, "bb"), (500, "bb"), (None, "bb"), (501, "und"), (502, "und")], key=repr)
    kept = language_id.identified(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.learn(empty, F.lit(True)) is None and language_id.predict(empty, None).count() == 0
