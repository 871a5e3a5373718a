import random

import pytest
from pyspark.sql import functions as F

from listwright.sources import landing

HEAD = " Name ,url,\"Notes\",price\n"
CELLS = ["plain", "", '""', '"a, b"', '"two\nlines"', '"three\n\nlines"', '"say ""hi""\n""there"""', '  "padded\nquote"  ', '5" screen', '"\n"', '"x"y', "ünï", '"1,""\n"",2"', " spaced "]


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def submission(seed):
    pick = random.Random(seed)
    rows = [[pick.choice(CELLS) for _ in range(pick.choice((4, 4, 4, 3, 5)))] for _ in range(60)]
    for i, row in enumerate(rows):
        row[0] = f"row {i}"  # no row is empty
    text = HEAD + "".join(",".join(r) + pick.choice(("\n", "\n", "\n\n")) for r in rows)
    return text.replace("\n", "\r\n") if seed % 2 else text


def single(spark, path):
    """One reader per file."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = reader.csv(path).toDF("name", "url", "notes", "price")
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_splits_give_the_records_of_one_reader(spark, tmp_path, tiny_splits, seed):
    path = tmp_path / "s.csv"
    path.write_bytes(submission(seed).encode())
    got = landing.read_csv(spark, str(path)).orderBy("record_no").collect()
    want = [tuple(r) for r in single(spark, str(path)).collect()]
    assert spark.read.text(str(path)).select(F.col("_metadata.file_block_start")).distinct().count() > 10
    assert [(r["name"], r["url"], r["notes"], r["price"]) for r in got] == want
    assert [r["record_no"] for r in got] == [r["line_no"] for r in got] == list(range(2, len(want) + 2))


def test_a_cell_longer_than_many_splits(spark, tmp_path, tiny_splits):
    cell = "\n".join(f'line {i}, with "quotes"' for i in range(80))
    path = tmp_path / "s.csv"
    path.write_text(HEAD + 'a,,"' + cell.replace('"', '""') + '",1\nb,u,n,2\n')
    assert [(r["name"], r["notes"], r["record_no"]) for r in landing.read_csv(spark, str(path)).orderBy("record_no").collect()] == [("a", cell, 2), ("b", "n", 3)]


def test_an_unclosed_quote_stays_in_its_file(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text(HEAD + 'a,u,"never\nclosed\n')
    (tmp_path / "b.csv").write_text(HEAD + "b,u,n,2\n")
    assert [(r["name"], r["record_no"], r["line_no"]) for r in landing.read_csv(spark, str(tmp_path / "*.csv")).orderBy("record_no").collect()] == [("a", 2, 2), ("b", 3, 2)]


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffName,url,Name,\nx,y,z,w\n")
    rows = landing.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["name0", "url", "name2", "_c3", "file", "record_no", "line_no"] and tuple(rows.first())[:4] == ("x", "y", "z", "w")
    (tmp_path / "b.csv").write_text("url,name\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        landing.read_csv(spark, str(tmp_path / "*.csv"))


def test_header_only_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD)
    assert landing.read_csv(spark, str(tmp_path / "a.csv")).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert landing.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
