"""Sources that neither corrupt nor hide data."""

import os

import pytest

from hazardspark.session import discard, materialize, new_path, shared_dir
from hazardspark.sources import tables


def test_text_with_line_breaks(spark):
    df = spark.createDataFrame([(1, "one\ntwo"), (2, 'quote " and, comma')], "id long, text string")
    path = new_path(spark, "csv")
    tables.write_table(df, path, "csv")
    back = tables.read_table(spark, path, "id long, text string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_table(spark, path, "id long, text string").collect()


def test_health_reports_a_corrupt_file(spark, tmp_path):
    good, bad = str(tmp_path / "good"), tmp_path / "bad"
    spark.range(3).write.parquet(good)
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"PAR1 not a footer PAR1")
    rows = {r.dataset: (r.present, r.rows, r.error) for r in tables.dataset_health(spark, {"a": good, "b": str(bad), "c": str(tmp_path / "no")}).collect()}
    assert rows == {"a": (True, 3, None), "b": (True, 0, "unreadable"), "c": (False, 0, "missing")}


def test_health_opens_footers_only(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(0, 1000, 1, 3).selectExpr("id", "id AS a", "CAST(id AS string) AS b").write.parquet(path)
    spark.range(0).write.parquet(str(tmp_path / "none"))
    counted = tables._row_count(spark, path, "parquet")
    assert "ReadSchema: struct<>" in counted._jdf.queryExecution().executedPlan().toString()
    report = tables.dataset_health(spark, {"wide": path, "none": str(tmp_path / "none")})
    assert [tuple(r) for r in report.collect()] == [("wide", True, 1000, None), ("none", True, 0, None)]
    assert tables.health_status(report).first().status == "degraded"
    assert tables.dataset_health(spark, {}).count() == 0
    lines = str(tmp_path / "lines")
    spark.range(4).coalesce(1).write.csv(lines, header=True)
    assert tables.dataset_health(spark, {"l": lines}, "csv").first().rows == 4


def test_ragged_fragments(spark):
    rows = [(0, 0, ["sl.no", "name"]), (0, 1, ["1"]), (0, 2, ["2", "b", "extra"]), (0, 3, ["3", "c"])]
    got = tables.merge_fragments(spark.createDataFrame(rows, "fragment int, row_no long, cells array<string>")).sort("row_no").collect()
    assert [(r["sl.no"], r["name"]) for r in got] == [("1", None), ("2", "b"), ("3", "c")]


def test_intermediate_tables_can_be_dropped(spark):
    stored = materialize(spark.range(5), "test")
    path = stored._stored_at.removeprefix("file:")
    assert stored.count() == 5 and os.path.isdir(path) and shared_dir(spark)
    discard(stored)
    assert not os.path.exists(path)
