import os
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from brute import jaccard, taken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from listwright.llm import language_id, packing, pii

SF = "/root/testdata/sf0.001"


def run(spark, docs):
    """The stages as run() chains them, over given documents."""
    for _, step in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = step(spark, docs, "")
        assert docs.columns == before
    return corpus_pipeline.STAGES[-1][1](spark, docs, "")


def brute(spark, docs):
    rows = docs.collect()
    kept = lambda texts: spark.createDataFrame(texts, docs.schema)
    labels = language_id.Labeller(language_id.learn(docs, F.lit(True))).label([r["text"] for r in rows])
    rows = [r.asDict() for r, (lang, share) in zip(rows, labels) if lang != "und" and share >= corpus_pipeline.LEAST_SHARE]
    rows = [r for r, (doc_id, _, component) in zip(rows, jaccard([(r["doc_id"], r["text"]) for r in rows])) if doc_id == component]
    field = pii.learn(kept(rows))
    rows = [r | {"text": pii.redacted(r["text"], field)} for r in rows]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    out = Counter()
    for r, words in zip(rows, taken([(r["doc_id"], r["source"], r["text"]) for r in rows])):
        size = len(r["text"].split())
        for n in [size] * (words // size) + [words % size] * (words % size > 0):
            text = r["text"] if n == size else "".join(re.findall(r"\s*\S+", r["text"])[:n])
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
            start = 0
            for length in packing.lengths(len(ids), packing.MAX):
                out[r["doc_id"], start, length, crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
                start += length
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).drop("ids").collect())
    assert got == brute(spark, docs)


def test_odd_rows_and_extra_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, size string, `row` int, bit int, keep boolean"
    rows = [(i, f"some words of text number{i} stand here and there", "en", "s", 3, "x", 1, 2, True) for i in range(12)]
    rows += [(50, None, None, None, None, None, None, None, None), (51, "", "en", "s", 0, "x", 1, 2, True), (None, "words without a key", "en", None, 1, "x", 1, 2, False), (3, rows[3][1], "en", "s", 3, "x", 1, 2, True)]
    pieces = run(spark, spark.createDataFrame(rows, schema))
    assert {r["doc_id"] for r in pieces.collect()} <= {*range(12), None}
    assert run(spark, spark.createDataFrame([], schema)).count() == 0


def test_names_with_dots_and_backticks(spark):
    docs = spark.createDataFrame([(i, f"some words of text number{i} stand here and there", "en", "s", 3, "x", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, `c``.d` int")
    assert {r["doc_id"] for r in run(spark, docs).collect()} == set(range(12))


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
