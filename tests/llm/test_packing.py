from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.llm import packing

ENCODER = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
plain = lambda text: ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text("abZ'’sStTéÉßÜÿŸΣςİıﬁ²½ª́.,!?-_<|>@#$ \x1c\x1f\x85\xa0\t\n09<|endoftext|>", max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == plain(text)


@given(st.integers(1, 10**6))
def test_lengths_are_the_binary_form(n):
    got = packing.lengths(n, 2048)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)
    assert len(set(x for x in got if x < 2048)) == len([x for x in got if x < 2048])


def test_round_trip(spark, tmp_path):
    docs = [(1, "The quick brown fox", 0), (2, None, 0), (3, "", 0), (4, "wörd " * 3000, 0), (1, "The quick brown fox", 0), (None, "x", 0), (2**60 + 1, "y" * 50_000, 0)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, length int").repartition(3))
    rows = pieces.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for r in rows:
        assert len(r["ids"]) == r["length"] and crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] & (r["length"] - 1) == 0
    for doc_id, text, _ in docs:
        want = [*plain(text), 1]
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == doc_id)
        times = sum(d[0] == doc_id for d in docs)
        assert [i for start, ids in own[::times] for i in ids] == want and {r["doc_tokens"] for r in rows if r["doc_id"] == doc_id} == {len(want)}
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    assert {r["length"] for r in spark.read.parquet(str(tmp_path / "buckets")).select("length").distinct().collect()} == {r["length"] for r in rows}


def test_empty_table_and_wrong_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, most=1000)
