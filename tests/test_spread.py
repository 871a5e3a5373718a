"""Work on one row group is dealt among tasks."""

import pyarrow as pa
import pyarrow.parquet as pq

from listwright import binding_raw, binding_tracker
from listwright.operators import skew
from listwright.queries import imports


def parts(folder, n):
    columns = {
        "p_partkey": pa.array(range(n), pa.int64()), "p_name": ["red ring"] * n, "p_brand": ["Brand#1"] * n, "p_type": ["SMALL"] * n,
        "p_size": pa.array([i % 50 for i in range(n)], pa.int32()), "p_retailprice": [1.0] * n,
    }
    pq.write_table(pa.table(columns), f"{folder}/part.parquet", row_group_size=n)
    return str(folder)


def test_one_row_group_becomes_many_tasks(spark, tmp_path):
    sf = parts(tmp_path, 3 * skew.TASK_ROWS + 1)
    for rows in (binding_raw.raw(spark, sf, binding_raw.LISTING), binding_raw.stored(spark, sf), binding_tracker.products(spark, sf)):
        assert rows.rdd.getNumPartitions() == 4
    held = binding_raw.raw(spark, sf, {"name": "p_name"})
    sizes = held.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 3 * skew.TASK_ROWS + 1 and max(sizes) < 1.1 * skew.TASK_ROWS
    assert held.select("record_no").distinct().count() == sum(sizes)


def test_small_and_empty_tables_stay_as_they_are(spark):
    for n in (0, 7):
        assert skew.spread(spark.range(n)).count() == n
    assert skew.spread(spark.range(0, 10, 1, 1), 4).rdd.getNumPartitions() == 3


def test_filters_read_standardized_rows(spark, tmp_path):
    sf = parts(tmp_path, 50)
    for query in (imports.standardize_listings, imports.standardize_research, imports.validate_listings, imports.validate_research, imports.field_ledger):
        assert all("/standardized-" in path for path in query(spark, sf).inputFiles())
