import pytest

from sparkloom.operators import joins as J


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_equi_join_kinds_and_null_keys(spark):
    a = make(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id long, x string")
    b = make(spark, [(2, "p"), (2, "q"), (3, "r"), (None, "s")], "id long, y string")
    assert rows(J.join(a, b, "id")) == [(2, "b", "p"), (2, "b", "q"), (2, "c", "p"), (2, "c", "q")]
    assert len(rows(J.join(a, b, "id", "left"))) == 6
    assert rows(J.join(a, b, "id", "right"))[-2:] == [(3, None, "r"), (None, None, "s")]
    assert J.join(a, b, "id", "outer").count() == 8
    assert rows(J.join(a, b, "id", "semi")) == [(2, "b"), (2, "c")]
    assert rows(J.join(a, b, "id", "anti")) == [(1, "a"), (None, "d")]
    assert J.join(a, b, how="cross").columns == ["id", "x", "id_right", "y"]


def test_join_validation_and_suffix(spark):
    a, b = make(spark, [(1, 2)], "id long, v long"), make(spark, [(1, 3)], "id long, v long")
    assert J.join(a, b, "id", suffix="_r").columns == ["id", "v", "v_r"]
    with pytest.raises(ValueError, match="not found"):
        J.join(a, b, "nope")
    with pytest.raises(ValueError, match="incompatible types"):
        J.join(a, make(spark, [("1",)], "id string"), "id")
    with pytest.raises(ValueError):
        J.join(a, b, "id", "sideways")


TRADES, QUOTES = [(1,), (5,), (10,), (15,), (20,)], [(0, 10.0), (3, 11.0), (7, 12.0), (12, 13.0), (18, 14.0)]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, [10.0, 11.0, 12.0, 13.0, 14.0]),
        ({"direction": "forward"}, [11.0, 12.0, 13.0, 14.0, None]),
        ({"direction": "nearest"}, [10.0, 11.0, 13.0, 13.0, 14.0]),
        ({"tolerance": 2}, [10.0, 11.0, None, None, 14.0]),
    ],
)
def test_asof(spark, options, want):
    left, right = make(spark, TRADES, "time long"), make(spark, QUOTES, "time long, bid double")
    assert [r[1] for r in sorted(J.asof_join(left, right, on="time", **options).collect())] == want
    by = J.asof_join(left.selectExpr("*", "'x' as s"), right.selectExpr("*", "'x' as s"), on="time", by=["s"], **options)
    assert [r[2] for r in sorted(by.collect())] == want


def test_asof_ties_exact_and_nulls(spark):
    left = make(spark, [(3,), (7,), (11,), (None,)], "time long")
    right = make(spark, [(1, 1), (5, 2), (10, 3), (15, 4), (None, 5)], "time long, v long")
    assert rows(J.asof_join(left, right, on="time", direction="nearest")) == [(11, 3), (3, 1), (7, 2), (None, None)]
    same = make(spark, [(5,)], "time long")
    assert rows(J.asof_join(same, right, on="time", allow_exact=False)) == [(5, 1)]
    assert rows(J.asof_join(same, right, on="time", allow_exact=False, direction="forward")) == [(5, 3)]
    assert rows(J.asof_join(same.withColumnRenamed("time", "t"), right, left_on="t", right_on="time")) == [(5, 2)]
    assert J.asof_join(same, right.limit(0), on="time").first()[1] is None
    with pytest.raises(ValueError, match="must be sorted"):
        J.check_sorted(make(spark, [(1, 3), (2, 1)], "i long, time long"), "time", ["i"])


def test_asof_plan_has_no_nested_loop(spark):
    left, right = make(spark, TRADES, "time long").selectExpr("*", "1 as g"), make(spark, QUOTES, "time long, bid double").selectExpr("*", "1 as g")
    plan = J.asof_join(left, right, on="time", by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_join_where_matches_plain_condition(spark, monkeypatch):
    a = spark.range(300).selectExpr("id as i", "cast(id * 7919 % 101 as double) as x", "id % 13 as u")
    b = spark.range(200).selectExpr("id as j", "cast(id * 104729 % 103 as double) as y", "id % 17 as w")
    for few in (100_000, 10):
        monkeypatch.setattr(J, "BROADCAST_ROWS", few)
        for op, sql in (("<", "x < y"), (">=", "x >= y")):
            got = J.join_where(a, b, [("x", op, "y"), ("w", "<", "u")]).select("i", "j")
            from pyspark.sql import functions as F

            assert rows(got) == rows(a.join(b, F.expr(f"{sql} and u > w")).select("i", "j"))
    with pytest.raises(ValueError):
        J.join_where(a, b, [("x", "!=", "y")])


def test_rolling_join(spark):
    left = make(spark, [(5, "a"), (10, "b"), (30, "c"), (None, "d")], "time long, e string")
    right = make(spark, [(1, 1.0), (2, 2.0), (5, 3.0), (9, 4.0), (12, 5.0)], "time long, value double")
    get = lambda **k: sorted((r["e"], r["value"]) for r in J.rolling_join(left, right, "time", 3, **k).collect() if r["value"] is not None)
    assert get() == [("a", 3.0), ("b", 4.0)]
    assert get(closed="both") == [("a", 2.0), ("a", 3.0), ("b", 4.0)]
    assert get(closed="neither") == [("b", 4.0)]
    assert get(direction="forward") == [("b", 5.0)]
    assert get(direction="forward", closed="both") == [("a", 3.0), ("b", 5.0)]
    assert get(min_periods=2, closed="both") == [("a", 2.0), ("a", 3.0)]
    assert J.rolling_join(left, right, "time", 3).count() == 4
    with pytest.raises(ValueError):
        J.rolling_join(left, right, "time", 0)


def test_frequent_keys_are_cut_into_ranges(spark, monkeypatch):
    """The same rows come out however long a series may be before it is cut."""
    import random

    from pyspark.sql import functions as F

    from sparkloom.operators import missing

    deal = random.Random(3)
    rows = [(i, deal.choice(["hot", "hot", "hot", "a", "b", None]), deal.randint(0, 400), deal.choice([None, deal.randint(0, 9)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    right = df.where("id % 3 = 0").select("k", "t", F.col("id").alias("hit"))

    def results():
        out = []
        for direction in ("backward", "forward", "nearest"):
            out.append(sorted(map(repr, J.asof_join(df, right, on="t", by=["k"], direction=direction, right_order=["hit"]).select("id", "hit").collect())))
        order = {"order_by": ["t", "id"], "by": ["k"]}
        for f in (missing.forward_fill, missing.backward_fill, missing.cum_sum, missing.cum_count):
            out.append(sorted(map(repr, f(df, ["v"], **order).collect())))
        out.append(sorted(map(repr, missing.forward_fill(df, ["v"], limit=1, **order).collect())))
        out.append(sorted(map(repr, missing.interpolate(df, ["v"], limit=2, area="both", **order).collect())))
        return out

    whole = results()
    monkeypatch.setattr(J, "HOT_ROWS", 300)
    monkeypatch.setattr(missing, "HOT_ROWS", 300)
    assert results() == whole


def test_inequalities_by_ranges(spark, monkeypatch):
    import random

    deal = random.Random(4)
    left = [(i, deal.choice([None, deal.randint(0, 50)]), deal.randint(0, 50)) for i in range(200)]
    right = [(i, deal.randint(0, 50), deal.choice([None, deal.randint(0, 50)])) for i in range(150)]
    a, b = spark.createDataFrame(left, "i long, x long, y long"), spark.createDataFrame(right, "j long, p long, q long")
    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)
    ops = {"<": lambda m, n: m < n, "<=": lambda m, n: m <= n, ">": lambda m, n: m > n, ">=": lambda m, n: m >= n}
    for one in ops:
        for two in ops:
            got = J.join_where(a, b, [("x", one, "p"), ("y", two, "q")]).select("i", "j").collect()
            want = [(i, j) for i, x, y in left for j, p, q in right if None not in (x, q) and ops[one](x, p) and ops[two](y, q)]
            assert sorted(map(tuple, got)) == sorted(want), (one, two)


def test_band_of_a_column_compares_few_pairs_but_matches(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(J, "PIECE_ROWS", 16)
    compared = []
    inner = J._by_pieces
    monkeypatch.setattr(J, "_by_pieces", lambda *args: compared.append(inner(*args)) or compared[-1])
    a = spark.range(0, 3000, 1, 1).selectExpr("id as i", "id * 7919 % 3001 as low", "id * 7919 % 3001 + 60 as high")
    b = spark.range(3000).selectExpr("id as j", "id * 7907 % 3011 as p")
    want = rows(a.join(b, F.expr("low < p and high > p")).select("i", "j"))
    for few in (100_000, 10):
        monkeypatch.setattr(J, "BROADCAST_PIECE_ROWS", few)
        for predicates in ([("low", "<", "p"), ("high", ">", "p")], [("high", ">", "p"), ("low", "<", "p")]):
            assert rows(J.join_where(a, b, predicates).select("i", "j")) == want
            assert compared[-1].count() < 2 * len(want)


def test_left_rows_of_one_file_are_joined_by_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(J, "PIECE_ROWS", 64, raising=False)
    a = spark.range(0, 900, 1, 1).selectExpr("id as i", "id * 7919 % 1009 as x", "id % 25 as m")
    b = spark.range(600).selectExpr("id as j", "id * 7907 % 1013 as p", "id % 23 as n")
    got = J.join_where(a, b, [("x", ">=", "p"), ("m", "<", "n")]).select("i", "j", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted(map(tuple, a.join(b, F.expr("x >= p and m < n")).select("i", "j").collect()))
    per_task = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert len(per_task) >= 16 and max(per_task) < len(got) / 4


def test_pieces_match_all_pairs(spark, monkeypatch):
    """Ties longer than a piece, nulls, NaN and other kinds of numbers on the left; pieces in ranges and not."""
    import random

    from pyspark.sql import functions as F

    deal = random.Random(5)
    number = lambda: deal.choice([None, float("nan"), -0.0, 7.0, 7.0, 7.0, deal.randint(-9, 20) / 2])
    a = spark.createDataFrame([(i, deal.choice([None, 7, deal.randint(-5, 12)]), number(), number()) for i in range(150)], "i long, x int, y double, z double")
    b = spark.createDataFrame([(j, number(), number()) for j in range(160)], "j long, p double, q double")
    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(J, "PIECE_ROWS", 8)
    monkeypatch.setattr(J, "BUCKETS", (2, 6))
    cases = ([("x", "<", "p")], [("y", ">=", "p")], [("x", "<=", "p"), ("y", ">=", "p")], [("y", ">", "q"), ("x", "<", "p"), ("z", ">=", "p")], [("x", ">", "p"), ("y", "<=", "q")])
    for few, predicates in zip((100_000, 10, 10, 10, 100_000), cases, strict=True):
        monkeypatch.setattr(J, "BROADCAST_PIECE_ROWS", few)
        want = a.join(b, F.expr(" and ".join(f"{x} {op} {y}" for x, op, y in predicates))).select("i", "j")
        assert rows(J.join_where(a, b, predicates).select("i", "j")) == rows(want), predicates
    nothing = b.withColumn("p", F.lit(None).cast("double"))
    assert J.join_where(a, nothing, [("x", "<", "p"), ("y", ">", "p")]).count() == 0


def test_check_sorted(spark):
    df = spark.range(2000).selectExpr("id", "id div 3 as v")
    J.check_sorted(df, "v", ["id"])
    with pytest.raises(ValueError, match="sorted"):
        J.check_sorted(df.selectExpr("id", "case when id = 1999 then 0 else v end as v"), "v", ["id"])
