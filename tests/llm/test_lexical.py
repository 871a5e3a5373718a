import random
import re
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from listwright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: TERM.findall((t or "").translate(LOWER))


def plain(docs, items, k):
    counts = [(d, words(t)) for d, t in docs]
    N, L = sum(1 for _, w in counts if w), sum(len(w) for _, w in counts)
    df = {}
    for _, w in counts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    weight = {t: floor(1000 * log((2 * N + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, w in counts:
            m = 50 + (50 * len(w) * N) // L if L else 0
            score = sum(weight[t] * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(words(text)) if t in w)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=4, parts=3, **options):
    table = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, Score int, TEXT string").repartition(parts)
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, `a.b` string").repartition(2)
    got = lexical.rank(table, asked, k, **options)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, k)


def corpus(n, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 90)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for i in range(20)]
    items[3] = (3, docs[5][1])
    return docs, items


def test_equals_plain_ranking(spark):
    docs, items = corpus(500)
    check(spark, docs, items, head=40)
    check(spark, docs, items, k=50, parts=7, head=0)
    check(spark, docs, items, most_terms=30)


def test_small_buckets_prune_and_stay_exact(spark):
    docs, items = corpus(400, 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        check(spark, docs, items, k=3, head=64)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_bounds_spare_work_and_lose_nothing():
    rng = np.random.default_rng(3)
    often = 1 / np.arange(1, 201)
    weight = (1000 * np.log(2 / np.minimum(1, often * 12 / often.sum()) + 1)).astype(int)
    rows = [sorted(rng.choice(200, 12, replace=False, p=often / often.sum()).tolist()) for _ in range(500)]
    values = [[int(weight[t] * rng.integers(50, 100)) for t in r] for r in rows]
    norm = [float(np.sqrt(sum(x * x for x in v))) for v in values]
    batch = pa.RecordBatch.from_arrays([pa.array(norm), pa.array(rows, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], ["norm", "terms", "impacts"])
    bucket = lexical._Bucket(batch, 200)
    query = np.sort(rng.choice(200, 30, replace=False))
    scores = np.array([sum(v for t, v in zip(r, vs) if t in set(query.tolist())) for r, vs in zip(rows, values)])
    for least in (1, 300, int(np.sort(scores)[-10]), int(scores.max()), int(scores.max()) + 1):
        docs, found, _ = lexical.search_bucket(bucket, query, least)
        assert docs.tolist() == np.flatnonzero(scores >= least).tolist() and found.tolist() == scores[scores >= least].tolist()
    scored = lexical.search_bucket(bucket, query, int(np.sort(scores)[-3]))[2]
    assert 3 <= scored < (scores > 0).sum() / 5
    assert lexical.search_bucket(bucket, query, int(np.sqrt(30) * max(norm) * 1.01) + 1)[2] == 0


def test_nulls_ties_repeats_long_terms_and_case(spark):
    long = "Ä" * 500
    docs = [(1, "Apple apple ÄPFEL"), (1, "Apple apple ÄPFEL"), (None, "apple"), (2, None), (3, ""), (4, "..,- !"), (5, f"x {long} y"), (6, f"{long}b"), (7, "apple"), (8, "apple"), (9, "ÄPFEL äpfel"), (10, "i̇ İ K")]
    items = [(1, "APPLE"), (1, "APPLE"), (None, "apple ÄPFEL"), (2, None), (3, "?"), (4, long), (5, "nothing here"), (6, "äpfel"), (7, "İ i̇ k K")]
    check(spark, docs, items, k=3)
    check(spark, docs, items, k=50)


def test_a_text_of_megabytes(spark):
    docs = [(0, "rare " + "common word " * 300_000), (1, "rare common"), (2, "word")]
    check(spark, docs, [(0, "rare word"), (1, "common " * 1000)])


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None)], [(1, "a")])
