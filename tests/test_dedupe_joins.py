"""Deduplication joins tables that grow with the batch without sending them through the driver."""

from listwright.operators import dedupe


def test_dedupe_broadcasts_nothing(spark, monkeypatch):
    plans, written = [], dedupe.stage

    def stage(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(dedupe, "stage", stage)
    chain = spark.range(40).selectExpr("id AS record_no", "concat('i', floor(id / 2)) AS identity_key", "concat('n', floor((id + 1) / 2)) AS name_key")
    out = dedupe.split_duplicates(chain)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["record_no"] for r in out.where("NOT is_duplicate").collect()} == set(range(0, 40, 2))
    assert not any("Broadcast" in plan for plan in plans)
