import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import agg as A
from sparkloom.operators import missing as M
from sparkloom.operators import reshape as P
from sparkloom.operators import rows as R
from sparkloom.operators import stats as T
from sparkloom.operators import window as W


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


def column(df, name, by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_rows(spark):
    df = make(spark, [("c", 3, None), ("a", 1, 2.0), ("b", 2, 1.0)], "name string, age int, v double")
    assert [r["v"] for r in R.sort(df, "v").collect()] == [1.0, 2.0, None]
    assert [r["v"] for r in R.sort(df, "v", descending=True).collect()] == [2.0, 1.0, None]
    assert [r["name"] for r in R.slice_rows(df, 1, 3, ["age"]).collect()] == ["b", "c"]
    assert [r["name"] for r in R.take(df, [2, 0, 2], ["age"]).collect()] == ["c", "a", "c"]
    assert [r["name"] for r in R.tail(df, 2, ["age"]).collect()] == ["b", "c"]
    assert R.get_row(df, 0, ["age"])["name"] == "a"
    for bad in (lambda: R.select(df, "x"), lambda: R.drop(df, "x"), lambda: R.rename(df, "x", "y"), lambda: R.rename(df, "age", "name"), lambda: R.sort(df), lambda: R.slice_rows(df, 2, 1, ["age"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        R.take(df, [3], ["age"])
    out = R.with_columns(make(spark, [(1,)], "a int"), {"c": F.col("b") + 1, "b": F.lit(5)})
    assert out.first().asDict() == {"a": 1, "c": 6, "b": 5}
    with pytest.raises(ValueError):
        R.with_columns(df, {"p": F.col("q"), "q": F.col("p")})


def test_group_by(spark):
    df = make(spark, [("A", 1, 1.0), ("B", 2, None), ("A", 3, 3.0), ("A", 4, 8.0), (None, 5, 5.0)], "k string, i int, v double")
    g = A.group_by(df, "k")
    assert {r["k"]: r["count"] for r in g.count().collect()} == {"A": 3, "B": 1, None: 1}
    assert dict(g.sum("i").dtypes)["i_sum"] == "int"
    out = {r["k"]: r for r in g.agg({"m": A.median("v"), "s": A.std("v"), "f": A.first("v", "i"), "l": A.last("v", "i")}).collect()}
    assert out["A"]["m"] == 3.0 and math.isclose(out["A"]["s"], math.sqrt(13)) and out["A"]["f"] == 1.0 and out["A"]["l"] == 8.0
    assert out["B"]["m"] is None and out["B"]["f"] is None and out[None]["s"] is None
    assert {r["k"]: r["i_topk"] for r in A.group_top_k(df, ["k"], "i", 2).collect()}["A"] == [4, 3]
    assert df.agg(A.corr("i", "v").alias("c")).first()["c"] is not None
    assert make(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(A.corr("a", "b").alias("c")).first()["c"] is None
    with pytest.raises(ValueError):
        A.group_by(df)


@pytest.mark.parametrize("order", [[("o_orderdate", True), ("o_orderkey", True)], [("s", False)], [("o_custkey % 7", True)]])
@pytest.mark.parametrize("frame", [None, ("rows", None, 0), ("rows", -3, 2), ("rows", 1, 4), ("rows", None, None)])
def test_windows_over_ranges(spark, monkeypatch, order, frame):
    """Cut into ranges and blocks, a table without partition_by gives what one task does."""
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"))
    df = df.withColumn("v", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey"))).repartition(4)
    spec = W.Spec(ordering=tuple((F.expr(c) if "%" in c else c, up) for c, up in order), frame=frame)
    ties = len(order) == 1
    functions = {"rank": W.rank(), "dense": W.dense_rank(), "pr": W.percent_rank(), "n_all": W.count_rows(), "v": W.sum_("v"), "avg": W.avg("v"), "mn": W.min_("v"), "mx": W.max_("v"), "n": W.count("v")}
    if ties and frame and frame[1:] != (None, None):
        functions = {n: f for n, f in functions.items() if n in ("rank", "dense", "pr", "n_all")}  # the others go by the order within ties
    if not ties:
        functions |= {"rn": W.row_number(), "tile": W.ntile(7), "lag": W.lag("v", 3, -1), "lead": W.lead("s", 2), "first": W.first_value("s"), "last": W.last_value("v")}
        functions |= {"nth": W.nth_value("v", 5)} if frame != ("rows", None, 0) else {}
    one = W.over_all(df, functions, spec)
    monkeypatch.setattr(W, "ONE_TASK", 0)
    monkeypatch.setattr(W, "BLOCK", 40)
    cut = W.over_all(df, functions, spec)
    assert cut.schema.simpleString() == one.schema.simpleString()
    assert "SinglePartition" in one._jdf.queryExecution().executedPlan().toString()
    plain = lambda rows: {r["o_orderkey"]: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}
    assert plain(cut.collect()) == plain(one.collect())


def test_windows(spark):
    df = make(spark, [(1, 10), (2, 20), (3, 20), (4, 30)], "i int, v int")
    s = W.Spec().order_by("v")
    out = W.over_all(df, {"r": W.rank(), "d": W.dense_rank(), "p": W.percent_rank()}, s)
    assert column(out, "r") == [1, 2, 2, 4] and column(out, "d") == [1, 2, 2, 3] and column(out, "p") == [0.0, 1 / 3, 1 / 3, 1.0]
    assert dict(out.dtypes)["r"] == "bigint"
    s = W.Spec().order_by("i")
    assert column(W.over(df, "x", W.last_value("v"), s), "x") == [30] * 4
    assert column(W.over(df, "x", W.nth_value("v", 2), s), "x") == [20] * 4
    assert column(W.over(df, "x", W.sum_("v"), s.unbounded_preceding().current_row()), "x") == [10, 30, 50, 80]
    assert column(W.over(df, "x", W.lag("v", 1, 0), s), "x") == [0, 10, 20, 20]
    g = W.Spec().order_by("v")
    assert column(W.over(df, "x", W.sum_("v"), g.groups_between(-1, 0)), "x") == [10, 50, 50, 70]
    assert column(W.over(df, "x", W.sum_("v"), g.range_between(-10, 0)), "x") == [10, 50, 50, 70]
    assert column(W.over(df, "x", W.count_rows(), W.Spec().groups_between(-1, 1)), "x") == [4] * 4
    with pytest.raises(ValueError):
        W.over(df, "x", W.rank(), W.Spec())
    with pytest.raises(ValueError):
        W.over(df, "x", W.sum_("nope"), s)
    with pytest.raises(ValueError):
        W.nth_value("v", 0)


def test_missing(spark):
    df = make(spark, list(enumerate([1.0, None, None, 4.0, None, 6.0, None])), "i int, v double")
    at = {"order_by": ["i"]}
    assert column(M.forward_fill(df, ["v"], **at), "v") == [1, 1, 1, 4, 4, 6, 6]
    assert column(M.backward_fill(df, ["v"], **at), "v") == [1, 4, 4, 4, 6, 6, None]
    assert column(M.forward_fill(df, ["v"], limit=1, **at), "v") == [1, 1, None, 4, 4, 6, 6]
    assert column(M.interpolate(df, ["v"], **at), "v") == [1, 2, 3, 4, 5, 6, None]
    assert column(M.interpolate(df, ["v"], limit=1, **at), "v") == [1, None, None, 4, 5, 6, None]
    assert column(M.interpolate(df, ["v"], method="nearest", **at), "v") == [1, 1, 4, 4, 4, 6, None]
    assert column(M.interpolate(df, ["v"], method="zero", area="both", **at), "v") == [1, 1, 1, 4, 4, 6, 6]
    ints = make(spark, [(0, 10), (1, None), (2, None), (3, 41)], "i int, v long")
    assert column(M.interpolate(ints, ["v"], **at), "v") == [10, 20, 31, 41]
    assert column(M.fill_null(df, ["v"], value=0.0), "v") == [1, 0, 0, 4, 0, 6, 0]
    with pytest.raises(ValueError):
        M.interpolate(df, ["v"], method="spline", **at)
    c = make(spark, [(0, 1), (1, None), (2, 3), (3, None), (4, 5)], "i int, v long")
    assert column(M.cum_sum(c, ["v"], **at), "v") == [1, 1, 4, 4, 9]
    assert column(M.cum_sum(c, ["v"], skip_nulls=False, **at), "v") == [1, None, 4, None, 9]
    assert column(M.cum_count(c, ["v"], **at), "v") == [1, 1, 2, 2, 3]
    assert column(M.cum_prod(c, ["v"], **at), "v") == [1, 1, 3, 3, 15]
    d = make(spark, [(1, "x", 1), (1, "x", 2), (2, "y", 3)], "a int, b string, i int")
    for keep, want in (("first", [1, 3]), ("last", [2, 3]), ("none", [3])):
        assert column(M.drop_duplicates(d, ["a", "b"], keep, ["i"]), "i") == want


def test_reshape(spark):
    s = make(spark, [("d1", "A", 10), ("d1", "B", 20), ("d2", "A", 30)], "date string, product string, sales long")
    assert sorted(tuple(r) for r in P.pivot(s, "date", "product", "sales", "sum", 0).collect()) == [("d1", 10, 20), ("d2", 30, 0)]
    wide = make(spark, [("x", 1, 2.5)], "name string, math long, art double")
    assert [tuple(r) for r in P.melt(wide, ["name"]).collect()] == [("x", "math", "1"), ("x", "art", "2.5")]
    st = P.stack(make(spark, [("A", 1, 3), ("B", 2, 4)], "id string, x long, y long"), "x", "y")
    assert [tuple(r) for r in st.collect()] == [("A", "x", 1), ("A", "y", 3), ("B", "x", 2), ("B", "y", 4)]
    assert sorted(tuple(r) for r in P.unstack(st, "level_1").collect()) == [("A", 1, 3), ("B", 2, 4)]
    t = P.transpose(make(spark, [("p", 1), ("q", 2)], "name string, age int"), ["age"])
    assert [tuple(r) for r in t.collect()] == [("name", "p", "q"), ("age", "1", "2")]
    a, b = make(spark, [(1, "x")], "a int, b string"), make(spark, [(2, 3.0)], "a int, c double")
    assert P.concat([a, b]).columns == ["a", "b", "c"] and P.concat([a, b], join="inner").columns == ["a"]
    with pytest.raises(ValueError, match="mismatch"):
        P.concat([a, make(spark, [("z",)], "a string")], verify_schema=True)
    with pytest.raises(ValueError):
        P.concat([])
    assert P.concat_columns([a, a], [["a"], ["a"]]).columns == ["a", "b", "a_1", "b_1"]
    with pytest.raises(ValueError, match="heights"):
        P.concat_columns([a, P.concat([a, a])], [["a"], ["a"]])
    e = make(spark, [(1, [1, 2]), (2, [])], "i int, l array<int>")
    assert P.explode(e, "l").count() == 2 and P.explode(e, "l", keep_empty=True).count() == 3


def test_stats(spark):
    df = make(spark, [(float(x), 2.0 * x, 7.0) for x in (1, 2, 3, 4)], "a double, b double, c double")
    got = {m: T.quantile(df, [0.5], m, ["a"]).first()["a"] for m in T.QUANTILE_METHODS}
    assert got == {"linear": 2.5, "lower": 2.0, "higher": 3.0, "midpoint": 2.5, "nearest": 2.0}
    with pytest.raises(ValueError):
        T.quantile(df, [1.5])
    for method in ("pearson", "spearman", "kendall"):
        m = {r["column"]: r for r in T.correlation(df, ["a", "b"], method).collect()}
        assert math.isclose(m["a"]["b"], 1.0) and m["b"]["b"] == 1.0
    assert math.isnan(T.correlation(df, ["a", "c"]).first()["c"])
    assert math.isclose(T.covariance(df, ["a", "b"]).first()["b"], 10 / 3)
    x = make(spark, [(v,) for v in (3.0, 1.0, 4.0, 1.0, 5.0, None)], "v double").withColumn("i", F.monotonically_increasing_id())
    assert column(T.rank(x, ["v"]), "v") == [3, 1.5, 4, 1.5, 5, None]
    assert column(T.rank(x, ["v"], "dense", ascending=False), "v") == [3, 4, 2, 4, 1, None]
    assert column(T.rank(x, ["v"], "max", nulls="bottom"), "v") == [3, 2, 4, 2, 5, 6]
    assert column(T.rank(x, ["v"], "min", pct=True), "v") == [0.6, 0.2, 0.8, 0.2, 1.0, None]
    assert T.mode(x, ["v"]).first()["v"] == 1.0 and T.n_unique(x, ["v"]).first()["v"] == 4 and T.n_unique(x, ["v"], drop_null=False).first()["v"] == 5
    assert math.isnan(T.skew(x.limit(2), ["v"]).first()["v"])


def test_one_series_over_many_ranges(spark):
    """Without `by`, scans carry over between the ranges of the order."""
    import random

    rng = random.Random(3)
    data = [(i, rng.choice([None, None, float(rng.randint(-5, 9))])) for i in range(400)]
    df = make(spark, data, "i int, v double").repartition(7)
    one = df.withColumn("g", F.lit(1))
    for f in (M.cum_sum, M.cum_max, M.cum_min, M.cum_count):
        assert column(f(df, ["v"], ["i"]), "v") == column(f(one, ["v"], ["i"], ["g"]), "v"), f
    for k in (None, 1, 3):
        for f in (M.forward_fill, M.backward_fill):
            assert column(f(df, ["v"], ["i"], limit=k), "v") == column(f(one, ["v"], ["i"], ["g"], limit=k), "v")
        assert column(M.interpolate(df, ["v"], ["i"], limit=k, area="both"), "v") == column(M.interpolate(one, ["v"], ["i"], ["g"], limit=k, area="both"), "v")
    assert column(R.with_row_index(df, ["i"]), "row_index") == list(range(400))


def test_rank_of_a_whole_table(spark):
    """Without `by` as with one group."""
    import random

    rng = random.Random(8)
    df = make(spark, [(i, rng.choice([None, *range(12)])) for i in range(120)], "i int, v int").repartition(5)
    one = df.withColumn("g", F.lit(1))
    for method in ("average", "min", "max", "dense", "ordinal"):
        for nulls in ("keep", "top", "bottom"):
            up = method != "max"
            a = T.rank(df, ["v"], method, up, nulls, pct=method == "min", order_by=["i"])
            b = T.rank(one, ["v"], method, up, nulls, pct=method == "min", by=["g"], order_by=["i"])
            assert column(a, "v") == column(b, "v"), (method, nulls)


def test_kendall_against_all_pairs(spark):
    import random

    import numpy as np

    from sparkloom.operators import stats

    deal = random.Random(6)
    for size, spread in ((400, 30), (1500, 10**6), (300, 3)):
        rows = [(deal.randint(0, spread), deal.randint(0, spread) / 4, None if deal.random() < 0.05 else deal.randint(0, 5)) for _ in range(size)]
        got = {r["column"]: r for r in stats.correlation(spark.createDataFrame(rows, "a long, b double, c int"), method="kendall").collect()}
        full = [r for r in rows if None not in r]
        for i, m in enumerate("abc"):
            for j, n in enumerate("abc"):
                x, y = (np.array([r[k] for r in full], float) for k in (i, j))
                sx, sy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
                want = (sx * sy).sum() / ((sx**2).sum() * (sy**2).sum()) ** 0.5
                assert abs(got[m][n] - want) < 1e-9, (size, m, n)
