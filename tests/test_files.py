import gzip
import json

import pytest

from sparkloom.operators import resample as Z
from sparkloom.sources import files as IO
from sparkloom.streaming import windows as S


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("name,age,score,ok\nAnn,30,1.5,true\nBob,,x,false\nCid,41\n")
    df = IO.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "score": "string", "ok": "boolean"}
    assert [r["ok"] for r in df.collect()] == [True, False, None]
    df = IO.read_csv(spark, str(p), types={"score": "f64"}, columns=["name", "score"])
    assert [tuple(r) for r in df.collect()] == [("Ann", 1.5), ("Bob", None), ("Cid", None)]
    p.write_text("# note\nx;NA\n2;3\n")
    df = IO.read_csv(spark, str(p), header=False, delimiter=";", comment="#", null_values=["NA"])
    assert df.columns == ["column_0", "column_1"] and [tuple(r) for r in df.collect()] == [("x", None), ("2", 3)]
    p.write_text("junk\na,b\n1,2\n")
    assert [tuple(r) for r in IO.read_csv(spark, str(p), skip_rows=1).collect()] == [(1, 2)]
    p.write_text("")
    assert IO.read_csv(spark, str(p)).columns == []
    p.write_text("a,b\n")
    assert IO.read_csv(spark, str(p)).columns == ["a", "b"] and IO.read_csv(spark, str(p)).count() == 0
    src = spark.createDataFrame([(1, 'q"uo,te', 1.25), (2, None, None)], "i long, s string, d double")
    IO.write_csv(src, str(tmp_path / "out"), float_format="%.1f", single_file=True)
    back = IO.read_csv(spark, str(tmp_path / "out"), schema=src.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'q"uo,te', 1.3), (2, None, None)]


def test_parquet(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id * 2 as v", "cast(id as string) as s")
    for codec in ("none", "snappy", "gzip", "zstd"):
        IO.write_parquet(df, str(tmp_path / codec), codec)
        assert IO.read_parquet(spark, str(tmp_path / codec), ["v"], limit=7).columns == ["v"]
    from pyspark.sql import functions as F

    plan = IO.read_parquet(spark, str(tmp_path / "zstd"), ["v"], where=F.col("id") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "s:string" not in plan
    with pytest.raises(ValueError):
        IO.read_parquet(spark, str(tmp_path / "zstd"), ["nope"])


def test_json(spark, tmp_path):
    records = [{"a": 1, "n": {"x": 1.5, "l": [1, 2]}}, {"a": 2, "n": {"x": None, "l": []}}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(records, f)
    flat = IO.read_json(spark, str(tmp_path / "r.json.gz"), flat=True)
    assert set(flat.columns) == {"a", "n.x", "n.l"} and flat.where("a = 1").first()["n.l"] == "[1,2]"
    (tmp_path / "r.ndjson").write_text('{"a": 1}\n{"a": oops\n{"a": 3}\n')
    assert sorted(r["a"] for r in IO.read_ndjson(spark, str(tmp_path / "r.ndjson"), schema=IO.from_records(spark, [{"a": 1}]).schema, skip_invalid=True).collect()) == [1, 3]
    calls = []
    assert IO.read_chunks(spark.range(5), 2, calls.append) == 3 and [len(c) for c in calls] == [2, 2, 1]
    df = IO.from_records(spark, [{"a": 1, "b": "x"}, {"a": None}])
    assert json.loads(IO.to_json_text(df, "columns")) == {"a": [1, None], "b": ["x", None]}
    assert json.loads(IO.to_json_text(df, "values", pretty=True)) == [[1, "x"], [None, None]]
    IO.write_ndjson(df, str(tmp_path / "nd"), "gzip")
    assert IO.read_ndjson(spark, str(tmp_path / "nd")).count() == 2


def test_constructors(spark):
    df = IO.from_columns(spark, {"i": [1, 2], "f": [1, 2.5], "s": ["a", None], "n": [None, None]})
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "s": "string", "n": "string"}
    with pytest.raises(ValueError):
        IO.from_columns(spark, {"a": [1], "b": [1, 2]})


def test_resample_and_streams(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02}:15:00", float(h) if h % 5 else None) for h in range(24)]
    df = spark.createDataFrame(rows, "t string, v double").selectExpr("cast(t as timestamp) ts", "v")
    out = {r["ts"].hour: r for r in Z.resample(df, "ts", "6h", "v", ["sum", "count", "first", "last", "mean"]).collect()}
    assert out[0]["v_count"] == 6 and out[0]["v_sum"] == 10.0 and out[0]["v_first"] == 1.0 and out[0]["v_last"] == 4.0 and out[18]["v_count"] == 6
    assert Z.resample(df, "ts", "1mo", "v", ["count"]).first()["v_count"] == 24
    with pytest.raises(ValueError):
        Z.resample(df, "ts", "6 moons", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    q = S.for_each_chunk(S.resample_stream(stream, "ts", "12 hours", "v").where("v_count > 0"), lambda b, _: got.extend(b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert all(r["v_count"] == 12 for r in got)
    (tmp_path / "nd").mkdir()
    for i in range(3):
        (tmp_path / "nd" / f"{i}.json").write_text(f'{{"a": {i}}}\n')
    chunks = []
    q = S.for_each_chunk(S.read_ndjson_stream(spark, str(tmp_path / "nd"), IO.from_records(spark, [{"a": 1}]).schema), lambda b, _: chunks.append(b.count()), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert sum(chunks) == 3 and len(chunks) == 3
