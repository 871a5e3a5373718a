import numpy as np
import pytest
from brute import jaccard as brute
from brute import shingles

from listwright.llm import jaccard
from listwright.operators import graph

SCHEMA = "doc_id long, text string, n long, node string, `group` int"


def compare(spark, docs):
    got = jaccard.join(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(docs), key=repr)


def text(random, words):
    return " ".join(f"w{x}" for x in random.integers(0, 10**6, words))


def edited(random, base, share):
    words = base.split(" ")
    for i in range(len(words)):
        if random.random() < share:
            words[i] = f"e{random.integers(0, 10**6)}"
    return " ".join(words)


def test_families_hot_passages_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "SHARE", 2)
    random = np.random.default_rng(3)
    passage = text(random, 40)
    docs = [(i, text(random, int(random.integers(1, 60)))) for i in range(60)]
    for family in range(4):
        base = text(random, 80)
        docs += [(100 * (family + 1) + i, edited(random, base, 0.005 * (i % 12))) for i in range(40)]
    docs += [(1000 + i, passage + " " + text(random, int(random.integers(1, 60)))) for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (None, passage), (None, "one two"), (1000, docs[-1][1]), (1005, docs[-5][1])]
    docs += [(3000 + i, "same text said again and again here") for i in range(30)]
    compare(spark, docs)


def test_threshold_is_met_exactly(spark):
    # 3 shared shingles of 4, 6 of 8 and the same less one word.
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words[:7])), (2, " ".join(words[:8])), (3, " ".join(words[10:20])), (4, " ".join(words[8:20])), (5, " ".join(words[21:30])), (6, " ".join([*words[21:29], "x", "y"])), (7, "a b c d e f"), (8, "a b c d e f")]
    assert brute(docs)[1][2] == 1 and brute(docs)[3][2] == 3
    compare(spark, docs)


def test_empty_tables_and_the_kept_rows(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, "x"), (None, "a b c d e f"), (4, None), (5, "other words stand in this one")]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "node", "group"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, "a b c d e f"), (3, "x"), (None, "a b c d e f"), (4, None), (5, "other words stand in this one")], key=repr)


def test_rows_of_one_doc_id_are_decided_each_for_itself(spark):
    random = np.random.default_rng(9)
    a, b, c, d, e = (text(random, 60) for _ in range(5))
    docs = [(3, a), (3, b), (1, b + " more"), (7, a + " more")]  # 1 stands for b and 3 for a
    docs += [(20, c), (20, d), (20, d.upper()), (21, d + " more"), (22, e), (22, e), (23, e)]
    docs += [(7, None), (30, ""), (30, " \t"), (22, None), (22, None), (None, c), (None, c)]
    kept = jaccard.one_of_each(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA).repartition(5))
    want = [(3, a), (1, b + " more"), (20, c), (20, d.upper()), (22, e)]
    want += [(7, None), (30, ""), (30, " \t"), (22, None), (22, None), (None, c), (None, c)]
    assert kept.columns == ["doc_id", "text", "n", "node", "group"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("sample", ["", "a", "a b c d", "A b C d e", "a b a b a b a b", "x\x1cy z\x85w q r s t u"])
def test_shingles_count_like_tuples(sample):
    assert len(jaccard.shingles(sample.encode())) == len(shingles(sample))


def test_prefixes_reach_every_pair():
    for n in range(1, 200):
        for m in range(-(-3 * n // 4), n + 1):
            least = -(-3 * (n + m) // 7)
            assert jaccard.prefix(n) >= n - least + 1 and jaccard.prefix(m) >= m - least + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (5, 5), (400, 400)] + [(1000, 1001 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100} | {i: 1000 for i in range(1000, 1051)}
    assert got == want


def test_near_copies_that_missed_their_centre_join_the_large_group_before_pairs_are_made(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 4, raising=False)
    random, pairs, crowded = np.random.default_rng(8), [], jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *args: pairs.append(crowded(*args)) or pairs[-1])
    base = text(random, 140)
    docs = [(i, base if i == 0 else edited(random, base, 0.018)) for i in range(300)]
    docs += [(1000 + i, text(random, 60)) for i in range(20)]
    compare(spark, docs)
    assert pairs[0].count() < 40
