import json

from pyspark.sql import functions as F

from sparkloom import frame
from sparkloom.functions.temporal import Duration
from sparkloom.operators import window as W
from sparkloom.sources import files


def test_fluent_frame(spark, tmp_path):
    f = frame.Frame(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long"))
    assert f.group_by("k").sum("v").sort("k").collect() == [{"k": "a", "v_sum": 3}, {"k": "b", "v_sum": 3}]
    assert f.filter(F.col("v") > 1).select("v").sort("v").collect() == [{"v": 2}, {"v": 3}]
    assert f.over("r", W.row_number(), W.Spec().partition_by("k").order_by("v")).sort("v").collect()[1]["r"] == 2
    assert f.join(frame.Frame(spark.createDataFrame([("a", 9)], "k string, w int")), "k").shape() == (2, 3)
    assert f.aggregate(n=F.count(F.lit(1))).collect() == [{"n": 3}] and frame.concat([f, f]).shape() == (6, 2)
    f.write_parquet(str(tmp_path / "p"))
    plan = frame.scan_parquet(spark, str(tmp_path / "p")).filter(F.lit(True) & (F.col("v") + 0 > 1)).select("v").explain()
    assert "ReadSchema: struct<v:bigint>" in plan and "true AND" not in plan
    f.write_json(str(tmp_path / "j"), orient="columns")
    part = next((tmp_path / "j").glob("part-*"))
    assert json.loads(part.read_text()) == {"k": ["a", "a", "b"], "v": [1, 2, 3]}
    assert files.to_arrow(files.from_arrow(spark, files.to_arrow(f.df))).num_rows == 3
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    assert frame.scan_csv(spark, str(tmp_path / "c.csv")).columns == ["x", "y"]


def test_duration_text():
    assert str(Duration.parse("1y 2mo 3d 4h 5min 6s")) == "1y 2mo 3d 4h 5min 6s" and str(Duration()) == "0s"
    assert str(-Duration.parse("90s")) == "-1min 30s" and str(Duration.of(1500, "ms")) == "1.5s"
