"""Tables between stages: enough files for all cores, sizes that tell rows from compressed files, cuts that move no rows."""

from emberlog import session as s
from emberlog.operators.outlier import label_by_quantile


def test_a_table_from_one_task_is_read_by_many(spark, monkeypatch):
    monkeypatch.setattr(s, "FILE_ROWS", 10)
    rows = spark.range(35).coalesce(1)
    stage = s.StageTable(spark, "few")
    for table in (s.written(rows), stage.put(rows), stage.put(rows.filter("id > 3"))):
        assert len(table.inputFiles()) == 4
    assert sorted(r.id for r in s.written(rows).collect()) == list(range(35))


def test_a_table_that_compresses_well_is_not_sent_through_the_driver(spark):
    s.prepare(spark)
    rows = s.written(spark.range(400_000).selectExpr("id", "repeat('ab', 200) AS log"))
    other = s.written(spark.range(400_000).selectExpr("id", "repeat('cd', 200) AS text"))
    plan = rows.join(other, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_rows_of_a_group_stay_where_they_are_for_its_quantile(spark):
    rows = s.cut_lineage(spark.createDataFrame([(i, "f", float(i)) for i in range(100)], "row_id long, source_file string, _factor double"))
    marked = label_by_quantile(rows, ["source_file"], 0.05)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.row_id for r in marked.filter("lof_label = -1").collect()) == [0, 1, 2, 3, 4]
