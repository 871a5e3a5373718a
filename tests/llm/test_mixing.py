import pytest
from brute import taken, targets

from listwright.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, n int, row string, lang string"
FILL = ("x", 1, "y", "en")


def corpus(rows):
    return [(i, s, t, *FILL) for i, s, t in rows]


ROWS = [(i, "abcde"[i % 3 if i % 2 else 0], "w " * (i % 17)) for i in range(200)] + [(1000, None, "one two"), (1001, None, None), (1002, "z", ""), (1003, "e", "long " * 900), (1004, "", "a b c")]


def test_equals_the_plain_version(spark):
    got = {r["doc_id"]: r for r in mixing.assign(spark.createDataFrame(corpus(ROWS), SCHEMA).repartition(7)).collect()}
    assert [got[i]["taken"] for i, _, _ in ROWS] == taken(ROWS)
    sizes = {}
    for i, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + got[i]["size"]
    want = targets(sizes)
    for i, s, _ in ROWS:
        assert got[i]["source_size"] == sizes[s] and got[i]["target"] == pytest.approx(want[s])
        assert got[i]["taken"] <= 2 * got[i]["size"] and (got[i]["position"] is None) == (got[i]["taken"] == 0)
    for s in sizes:
        assert abs(sum(got[i]["taken"] for i, x, _ in ROWS if x == s) - want[s]) <= 1


def test_mix_is_sorted_and_keeps_columns(spark):
    docs = spark.createDataFrame(corpus(ROWS), SCHEMA)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert [words.get(i, 0) for i, _, _ in ROWS] == taken(ROWS)


def test_a_cut_copy_is_the_start_of_its_text(spark):
    text = " \t one\ttwo\nthree  four\r\n five \n"
    docs = spark.createDataFrame(corpus([(1, "a", text), (2, "b", "x " * 9), (3, "c", "y " * 40)]), SCHEMA)
    for repeats, budget in ((1, 0.3), (1, 0.5), (2, 0.4), (2, 1.5)):
        for r in mixing.mix(docs, budget=budget, repeats=repeats).where("doc_id = 1").collect():
            assert text.startswith(r["text"]) and r["text"].split() == text.split()[: len(r["text"].split())]


def test_positions_follow_the_schedules(spark):
    rows = [(i, "abc"[i % 3], "w") for i in range(900)]
    early = {r["source"]: r["p"] for r in mixing.assign(spark.createDataFrame(corpus(rows), SCHEMA)).groupBy("source").agg({"position": "avg"}).toDF("source", "p").collect()}
    assert early["a"] < early["b"] < early["c"]


def test_moment_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for kind, (a, b) in enumerate(mixing.SCHEDULES):
        for share, t in spark.range(11).select((F.col("id") / 10).alias("y"), mixing.moment(F.col("id") / 10, F.lit(kind))).collect():
            assert (a * t + (b - a) * t * t / 2) / ((a + b) / 2) == pytest.approx(share)


def test_empty_and_wordless(spark):
    assert mixing.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = mixing.assign(spark.createDataFrame(corpus([(1, "a", None), (2, None, " \t")]), SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_repeated_rows_share_the_target(spark):
    rows = mixing.assign(spark.createDataFrame(corpus([(7, "a", "x y z")] * 4 + [(8, "b", "x " * 30)]), SCHEMA)).collect()
    assert sum(r["taken"] for r in rows if r["doc_id"] == 7) == 24 and max(r["taken"] for r in rows if r["doc_id"] == 7) <= 6


def test_assign_adds_up_copies_in_training_order(spark, monkeypatch):
    staged = {}

    def stage(df, name):
        staged[name] = (mixing_stage(df, name), [p for p in df.collect()] if name == "mix-order" else None)
        return staged[name][0]

    mixing_stage = mixing.stage
    monkeypatch.setattr(mixing, "stage", stage)
    rows = {r["doc_id"]: r for r in mixing.assign(spark.createDataFrame(corpus(ROWS), SCHEMA)).collect()}
    copies = staged["mix-order"][1]
    positions = [r["position"] for r in copies if r["position"] is not None]
    assert positions == sorted(positions) and all(r["words"] == 0 for r in copies[len(positions):])
    for i in rows:
        assert rows[i]["taken"] == sum(r["words"] for r in copies if r["doc_id"] == i)
    mixed = [r["doc_id"] for r in mixing.mix(spark.createDataFrame(corpus(ROWS), SCHEMA)).collect()]
    assert mixed == [r["doc_id"] for r in copies[:len(positions)]]
