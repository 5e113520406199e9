"""Registered queries over the driver tables, each with its SQL oracle.

Sums and means of doubles depend on the order of addition, so both sides round them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.functions import strings as S
from sparkloom.functions import temporal as D
from sparkloom.operators import agg as A
from sparkloom.operators import joins as J
from sparkloom.operators import missing as M
from sparkloom.operators import reshape as P
from sparkloom.operators import resample as Z
from sparkloom.operators import rows as R
from sparkloom.operators import stats as T
from sparkloom.operators import window as W
from sparkloom.plans import surface
from sparkloom.plans.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES", "surface"]  # surface registers queries of its own

# ---------------------------------------------------------------- projection, filter, expressions


@query("scan_project", "customer", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(c):
    return R.select(c, "c_custkey", "c_name", "c_acctbal")


@query("drop_columns", "customer", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(c):
    return R.drop(c, "c_name")


@query("rename_column", "region", "SELECT r_regionkey AS id, r_name FROM region")
def _(r):
    return R.rename(r, "r_regionkey", "id")


@query("filter_compound", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 30 AND l_discount < 0.05) OR NOT (l_returnflag <> 'R')")
def _(li):
    return R.filter_rows(li, ((F.col("l_quantity") >= 30) & (F.col("l_discount") < 0.05)) | ~(F.col("l_returnflag") != "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_null_dropped", "orders", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') <> 'O'")
def _(o):
    return R.filter_rows(o, F.nullif(F.col("o_orderstatus"), F.lit("F")) != "O").select("o_orderkey")


@query("filter_eq_missing", "orders", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL")
def _(o):
    return o.filter(X.eq_missing(F.nullif(F.col("o_orderstatus"), F.lit("F")), None)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("filter_isin_between", "part", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33')")
def _(p):
    return p.filter(X.between(F.col("p_size"), 10, 20) & X.is_in(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#21", "Brand#33"])).select("p_partkey", "p_size")


@query("with_columns_dep", "supplier", "SELECT s_suppkey, s_acctbal * 2 AS twice, s_acctbal * 2 + 1 AS more, abs(s_acctbal * 2 + 1) AS size FROM supplier")
def _(s):
    new = {"size": F.abs(F.col("more")), "more": F.col("twice") + 1, "twice": F.col("s_acctbal") * 2}
    return R.with_columns(s, new).select("s_suppkey", "twice", "more", "size")


@query("when_then", "customer", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS level, CASE WHEN c_acctbal < 0 THEN 1 END AS debt FROM customer")
def _(c):
    return c.select("c_custkey", X.when(F.col("c_acctbal") > 5000).then("high").otherwise("low").alias("level"), X.when(F.col("c_acctbal") < 0).then(1).build().alias("debt"))


@query("cast_safe", "part", "SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS num, TRY_CAST(p_name AS DOUBLE) AS bad, CAST(p_size AS DOUBLE) AS size FROM part")
def _(p):
    return p.select("p_partkey", X.cast(F.substring("p_brand", 7, 100), "i64").alias("num"), X.cast(F.col("p_name"), "f64").alias("bad"), X.cast(F.col("p_size"), "f64").alias("size"))


@query("arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber % 3 AS m, -l_quantity AS neg, CASE WHEN l_linenumber <> 3 THEN l_quantity / (l_linenumber - 3) END AS q FROM lineitem")
def _(li):
    n = F.col("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), X.mod(n, 3).alias("m"), X.negate(F.col("l_quantity")).alias("neg"), X.div(F.col("l_quantity"), n - 3).alias("q"))


# ---------------------------------------------------------------- aggregation


@query("groupby_multi", "lineitem", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def _(li):
    return A.group_by(li, "l_returnflag", "l_linestatus").agg({"sum_qty": F.round(F.sum("l_quantity"), 4), "avg_price": F.round(F.avg("l_extendedprice"), 6), "n": F.count(F.lit(1))})


@query("groupby_helpers", "lineitem", "SELECT l_suppkey, sum(l_linenumber)::INTEGER AS l_linenumber_sum FROM lineitem GROUP BY ALL")
def _(li):
    return A.group_by(li, "l_suppkey").sum("l_linenumber")


@query("groupby_min_max", "lineitem", "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS spread, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem GROUP BY ALL")
def _(li):
    return A.group_by(li, "l_returnflag").agg({"spread": F.max("l_quantity") - F.min("l_quantity"), "first_day": F.min("l_shipdate"), "last_day": F.max("l_shipdate")})


@query("groupby_median_std", "lineitem", "SELECT l_suppkey, median(l_quantity) AS median_qty, round(stddev_samp(l_extendedprice), 4) AS sd, round(var_samp(l_discount), 8) AS vr FROM lineitem GROUP BY ALL")
def _(li):
    return A.group_by(li, "l_suppkey").agg({"median_qty": A.median("l_quantity"), "sd": F.round(A.std("l_extendedprice"), 4), "vr": F.round(A.var("l_discount"), 8)})


@query("groupby_count_col", "orders", "SELECT o_orderpriority, count(nullif(o_orderstatus, 'O')) AS n_closed, count(*) AS n FROM orders GROUP BY ALL")
def _(o):
    return o.withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("O"))).groupBy("o_orderpriority").agg(A.count("s").alias("n_closed"), F.count(F.lit(1)).alias("n"))


@query("groupby_corr_sq", "lineitem", "SELECT l_returnflag, round(pow(corr(l_quantity, l_extendedprice), 2), 8) AS r2 FROM lineitem GROUP BY ALL")
def _(li):
    r = A.corr("l_quantity", "l_extendedprice")
    return A.group_by(li, "l_returnflag").agg({"r2": F.round(r * r, 8)})


@query("groupby_first_last", "orders", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_p, arg_max(o_orderpriority, o_orderkey) AS last_p FROM orders GROUP BY ALL")
def _(o):
    return A.group_by(o, "o_custkey").agg({"first_p": A.first("o_orderpriority", "o_orderkey"), "last_p": A.last("o_orderpriority", "o_orderkey")})


@query("groupby_topk_explode", "lineitem", """SELECT l_suppkey, l_extendedprice_topk FROM (SELECT l_suppkey, l_extendedprice AS l_extendedprice_topk, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 2""")
def _(li):
    return P.explode(A.group_top_k(li, ["l_suppkey"], "l_extendedprice", 2), "l_extendedprice_topk")


@query("groupby_bottomk", "orders", """SELECT o_custkey, min(o_totalprice) AS least FROM orders GROUP BY ALL""")
def _(o):
    return A.group_top_k(o, ["o_custkey"], "o_totalprice", 1, largest=False, name="b").select("o_custkey", F.get("b", F.lit(0)).alias("least"))


@query("groupby_null_key", "orders", "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS count FROM orders GROUP BY ALL")
def _(o):
    return A.group_by(o.withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("F"))), "s").count()


@query("reduce_columns", "part", "SELECT sum(p_size) AS p_size_sum, avg(p_size) AS p_size_mean, min(p_size) AS p_size_min, max(p_size) AS p_size_max, count(p_size) AS p_size_count, round(stddev_samp(p_size), 8) AS p_size_std, round(var_samp(p_size), 8) AS p_size_var, median(p_size) AS p_size_median FROM part")
def _(p):
    return A.reduce_columns(p, "p_size").withColumns({"p_size_std": F.round("p_size_std", 8), "p_size_var": F.round("p_size_var", 8)})


# ---------------------------------------------------------------- sort and position


@query("sort_nulls_last", "orders", "SELECT o_orderkey, s, row_number() OVER (ORDER BY s DESC NULLS LAST, o_orderkey) - 1 AS row_index FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)")
def _(o):
    return R.with_row_index(o.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s")), ["s", "o_orderkey"], descending=[True, False])


@query("topk_rows", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(o):
    return R.sort(o, "o_totalprice", "o_orderkey", descending=[True]).limit(25).select("o_orderkey", "o_totalprice")


@query("slice_rows", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 100")
def _(c):
    return R.slice_rows(c.select("c_custkey", "c_name"), 100, 140, ["c_custkey"])


@query("tail_rows", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10")
def _(c):
    return R.tail(c.select("c_custkey", "c_acctbal"), 10, ["c_acctbal", "c_custkey"])


@query("row_index", "orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
def _(o):
    return R.with_row_index(o.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_index")


@query("take_rows", "nation", "SELECT n.n_nationkey, n_name FROM (VALUES (3), (0), (3), (24)) t(i) JOIN (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) n ON r = i")
def _(n):
    return R.take(n.select("n_nationkey", "n_name"), [3, 0, 3, 24], ["n_nationkey"])


@query("arg_sort", "nation", "SELECT row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS position, row_number() OVER (ORDER BY n_nationkey) - 1 AS index FROM nation")
def _(n):
    return R.arg_sort(n, "n_name", order_by=["n_nationkey"])


# ---------------------------------------------------------------- joins

# Shifted keys leave customers and orders without a match.

_SHIFTED_C = "(SELECT c_custkey + 40 AS c_custkey, c_name FROM customer)"


def _shifted(c: DataFrame) -> DataFrame:
    return c.select((F.col("c_custkey") + 40).alias("c_custkey"), "c_name")


@query("join_inner", ("orders", "customer"), "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(o, c):
    return J.join(o.select("o_orderkey", "o_custkey"), c.select("c_custkey", "c_name"), left_on=["o_custkey"], right_on=["c_custkey"])


@query("join_left", ("customer", "orders"), f"SELECT c_custkey, o_orderkey FROM {_SHIFTED_C} LEFT JOIN orders ON c_custkey = o_custkey")
def _(c, o):
    return J.join(_shifted(c).select("c_custkey"), o.select("o_custkey", "o_orderkey"), how="left", left_on=["c_custkey"], right_on=["o_custkey"])


@query("join_right", ("orders", "customer"), f"SELECT o_orderkey, c_custkey AS o_custkey FROM orders RIGHT JOIN {_SHIFTED_C} ON o_custkey = c_custkey")
def _(o, c):
    return J.join(o.select("o_orderkey", "o_custkey"), _shifted(c).select("c_custkey"), how="right", left_on=["o_custkey"], right_on=["c_custkey"])


@query("join_outer", ("nation", "supplier"), "SELECT coalesce(k, s_suppkey) AS k, n_name, s_name FROM (SELECT n_nationkey::BIGINT + 90 AS k, n_name FROM nation) FULL JOIN supplier ON k = s_suppkey")
def _(n, s):
    return J.join(n.select((F.col("n_nationkey").cast("bigint") + 90).alias("k"), "n_name"), s.select("s_suppkey", "s_name"), how="outer", left_on=["k"], right_on=["s_suppkey"])


@query("join_semi", ("customer", "orders"), f"SELECT c_custkey, c_name FROM {_SHIFTED_C} WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(c, o):
    return J.join(_shifted(c), o, how="semi", left_on=["c_custkey"], right_on=["o_custkey"])


@query("join_anti", ("customer", "orders"), f"SELECT c_custkey, c_name FROM {_SHIFTED_C} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(c, o):
    return J.join(_shifted(c), o, how="anti", left_on=["c_custkey"], right_on=["o_custkey"])


@query("join_cross", ("region", "nation"), "SELECT r_name, n_name FROM region, nation")
def _(r, n):
    return J.join(r.select("r_name"), n.select("n_name"), how="cross")


@query("join_multi_key", ("lineitem", "lineitem"), "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
def _(a, b):
    return J.join(a.select("l_orderkey", "l_suppkey", "l_linenumber"), b.select("l_orderkey", "l_suppkey", "l_quantity"), on=["l_orderkey", "l_suppkey"]).drop("l_suppkey")


@query("join_suffix", ("nation", "nation"), "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_r, b.n_regionkey AS n_regionkey_r FROM nation a JOIN nation b USING (n_nationkey)")
def _(a, b):
    return J.join(a, b, on="n_nationkey", suffix="_r")


@query("join_null_keys", ("orders", "nation"), "SELECT o_orderkey, n_name FROM (SELECT o_orderkey, nullif(o_custkey % 25, 3)::INTEGER AS k FROM orders) LEFT JOIN (SELECT nullif(n_nationkey, 4) AS k, n_name FROM nation) USING (k)")
def _(o, n):
    left = o.select("o_orderkey", F.nullif(F.col("o_custkey") % 25, F.lit(3)).cast("int").alias("k"))
    right = n.select(F.nullif(F.col("n_nationkey"), F.lit(4)).alias("k"), "n_name")
    return J.join(left, right, on="k", how="left").drop("k")


@query("join_where_1", ("supplier", "nation"), "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")
def _(s, n):
    return J.join_where(s.select("s_suppkey", "s_nationkey"), n.select("n_nationkey"), [("s_nationkey", "<", "n_nationkey")]).drop("s_nationkey")


@query("join_where_2", ("customer", "supplier"), "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_nationkey < s_nationkey")
def _(c, s):
    return J.join_where(c.select("c_custkey", "c_acctbal", "c_nationkey"), s.select("s_suppkey", "s_acctbal", "s_nationkey"), [("c_acctbal", ">=", "s_acctbal"), ("c_nationkey", "<", "s_nationkey")]).select("c_custkey", "s_suppkey")


def _sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = e.where("event_id % 2 = 0").select("event_id", "ts", "user_id")
    right = e.where("event_id % 2 = 1").select("ts", "user_id", F.col("event_id").alias("hit"), F.col("value").alias("hit_value"))
    return left, right


_L = "(SELECT event_id, ts, user_id FROM events WHERE event_id % 2 = 0) l"
_R = "(SELECT ts, user_id, max(event_id) AS hit, arg_max(value, event_id) AS hit_value FROM events WHERE event_id % 2 = 1 GROUP BY ts, user_id) r"
_R1 = "(SELECT ts, max(event_id) AS hit FROM events WHERE event_id % 2 = 1 GROUP BY ts) r"


@query("asof_backward_by", "events", f"SELECT l.event_id, r.hit, r.hit_value FROM {_L} ASOF LEFT JOIN {_R} ON l.user_id = r.user_id AND l.ts >= r.ts")
def _(e):
    left, right = _sides(e)
    return J.asof_join(left, right, on="ts", by=["user_id"], right_order=["hit"]).select("event_id", "hit", "hit_value")


@query("asof_forward_by", "events", "SELECT l.event_id, (SELECT min(r.ts) FROM events r WHERE r.event_id % 2 = 1 AND r.user_id = l.user_id AND r.ts >= l.ts) AS hit_ts FROM events l WHERE l.event_id % 2 = 0")
def _(e):
    left, right = _sides(e)
    right = right.select("ts", "user_id", F.col("ts").alias("hit_ts"))
    return J.asof_join(left, right, on="ts", by=["user_id"], direction="forward").select("event_id", "hit_ts")


@query("asof_backward", "events", f"SELECT l.event_id, r.hit FROM {_L} ASOF LEFT JOIN {_R1} ON l.ts >= r.ts")
def _(e):
    left, right = _sides(e)
    return J.asof_join(left, right.select("ts", "hit"), on="ts", right_order=["hit"]).select("event_id", "hit")


@query("asof_tolerance_strict", "events", f"SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 600000000 THEN r.hit END AS hit FROM {_L} ASOF LEFT JOIN {_R} ON l.user_id = r.user_id AND l.ts > r.ts")
def _(e):
    left, right = _sides(e)
    return J.asof_join(left, right.select("ts", "user_id", "hit"), on="ts", by=["user_id"], tolerance=600, allow_exact=False, right_order=["hit"]).select("event_id", "hit")


@query("asof_nearest_by", "events", """WITH l AS (SELECT event_id, ts, user_id FROM events WHERE event_id % 2 = 0),
    r AS (SELECT DISTINCT ts, user_id FROM events WHERE event_id % 2 = 1),
    m AS (SELECT l.event_id, l.ts AS t, (SELECT max(ts) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS a, (SELECT min(ts) FROM r WHERE r.user_id = l.user_id AND r.ts >= l.ts) AS b FROM l)
    SELECT event_id, CASE WHEN b IS NULL OR epoch_us(t) - epoch_us(a) <= epoch_us(b) - epoch_us(t) THEN a ELSE b END AS hit_ts FROM m""")
def _(e):
    left, right = _sides(e)
    right = right.select("ts", "user_id", F.col("ts").alias("hit_ts"))
    return J.asof_join(left, right, on="ts", by=["user_id"], direction="nearest").select("event_id", "hit_ts")


@query("rolling_join", "events", """SELECT l.event_id, r.event_id AS other FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_id % 2 = 1
    AND epoch_us(r.ts) > epoch_us(l.ts) - 3600000000 AND r.ts <= l.ts WHERE l.event_id % 2 = 0""")
def _(e):
    left = e.where("event_id % 2 = 0").select("event_id", "ts", "user_id")
    right = e.where("event_id % 2 = 1").select("ts", "user_id", F.col("event_id").alias("other"))
    return J.rolling_join(left, right, "ts", 3600, by=["user_id"]).select("event_id", "other")


# ---------------------------------------------------------------- windows

_SPEC = W.Spec().partition_by("o_custkey").order_by("o_totalprice").order_by("o_orderkey")
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"


@query("win_ranks", "lineitem", """SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, percent_rank() OVER v AS pr
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber), v AS (PARTITION BY l_suppkey ORDER BY l_quantity)""")
def _(li):
    w = W.Spec().partition_by("l_suppkey").order_by("l_quantity")
    df = W.over(li, "rn", W.row_number(), w.order_by("l_orderkey").order_by("l_linenumber"))
    return W.over_all(df, {"rk": W.rank(), "dr": W.dense_rank(), "pr": W.percent_rank()}, w).select("l_orderkey", "l_linenumber", "rn", "rk", "dr", "pr")


@query("win_offsets", "orders", f"SELECT o_orderkey, ntile(3) {_OVER} AS nt, lag(o_orderkey, 1) {_OVER} AS lg, lead(o_orderkey, 2, -1) {_OVER} AS ld FROM orders")
def _(o):
    return W.over_all(o, {"nt": W.ntile(3), "lg": W.lag("o_orderkey"), "ld": W.lead("o_orderkey", 2, -1)}, _SPEC).select("o_orderkey", "nt", "lg", "ld")


@query("win_first_last_nth", "orders", """SELECT o_orderkey, first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER w AS lv, nth_value(o_orderkey, 2) OVER w AS nv FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(o):
    return W.over_all(o, {"fv": W.first_value("o_orderkey"), "lv": W.last_value("o_orderkey"), "nv": W.nth_value("o_orderkey", 2)}, _SPEC).select("o_orderkey", "fv", "lv", "nv")


@query("win_running", "orders", f"SELECT o_orderkey, sum(o_orderkey) {_OVER}::BIGINT AS sm, round(avg(o_totalprice) {_OVER}, 6) AS av, min(o_orderkey) {_OVER} AS mn, max(o_orderkey) {_OVER} AS mx, count(*) {_OVER} AS n FROM orders")
def _(o):
    made = W.over_all(o, {"sm": W.sum_("o_orderkey"), "av": W.avg("o_totalprice"), "mn": W.min_("o_orderkey"), "mx": W.max_("o_orderkey"), "n": W.count_rows()}, _SPEC)
    return made.select("o_orderkey", "sm", F.round("av", 6).alias("av"), "mn", "mx", "n")


@query("win_whole_partition", "supplier", "SELECT s_suppkey, max(s_suppkey) OVER (PARTITION BY s_nationkey) AS mx, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def _(s):
    return W.over_all(s, {"mx": W.max_("s_suppkey"), "n": W.count("s_suppkey")}, W.Spec().partition_by("s_nationkey")).select("s_suppkey", "mx", "n")


@query("win_rows_frame", "orders", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS sm FROM orders")
def _(o):
    return W.over(o, "sm", W.sum_("o_orderkey"), _SPEC.rows_between(-2, 1)).select("o_orderkey", "sm")


@query("win_range_frame", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem")
def _(li):
    return W.over(li, "n", W.count_rows(), W.Spec().partition_by("l_suppkey").order_by("l_quantity").range_between(-5, 5)).select("l_orderkey", "l_linenumber", "n")


@query("win_groups_frame", "lineitem", "SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS sm FROM lineitem")
def _(li):
    return W.over(li, "sm", W.sum_("l_linenumber"), W.Spec().partition_by("l_suppkey").order_by("l_quantity").groups_between(-1, 1)).select("l_orderkey", "l_linenumber", "sm")


# ---------------------------------------------------------------- reshaping


@query("concat_outer", ("customer", "supplier"), "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def _(c, s):
    return P.concat([c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")), s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("concat_inner", ("customer", "supplier"), "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(c, s):
    return P.concat([c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "c_mktsegment"), s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "s_acctbal")], join="inner")


@query("concat_columns", ("nation", "nation"), """SELECT a.n_name, b.n_name AS n_name_1 FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) a
    JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name, n_nationkey) AS r FROM nation) b USING (r)""")
def _(a, b):
    return P.concat_columns([a, b], [["n_nationkey"], ["n_name", "n_nationkey"]]).select("n_name", "n_name_1")


@query("pivot_sum", "orders", """SELECT o_orderpriority, sum(o_orderkey) FILTER (o_orderstatus = 'F')::BIGINT AS "F", sum(o_orderkey) FILTER (o_orderstatus = 'O')::BIGINT AS "O", coalesce(sum(o_orderkey) FILTER (o_orderstatus = 'X'), 0)::BIGINT AS "X" FROM orders GROUP BY ALL""")
def _(o):
    return P.pivot(o, "o_orderpriority", "o_orderstatus", "o_orderkey", "sum", 0, ["F", "O", "X"])


@query("melt", "part", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_size::BIGINT AS size, p_partkey * 2 AS twice FROM part) UNPIVOT INCLUDE NULLS (value FOR variable IN (size, twice))")
def _(p):
    return P.melt(p.select("p_partkey", F.col("p_size").cast("bigint").alias("size"), (F.col("p_partkey") * 2).alias("twice")), ["p_partkey"])


@query("stack", "nation", "SELECT n_name, level_1, value FROM nation UNPIVOT INCLUDE NULLS (value FOR level_1 IN (n_nationkey, n_regionkey))")
def _(n):
    return P.stack(n, "n_nationkey", "n_regionkey")


@query("unstack", "nation", f"SELECT n_regionkey, {', '.join(f'max(n_name) FILTER (r = {i}) AS a{i}' for i in range(1, 6))} FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY ALL")
def _(n):
    w = W.over(n, "r", W.row_number(), W.Spec().partition_by("n_regionkey").order_by("n_nationkey"))
    return P.unstack(w.select("n_regionkey", F.concat(F.lit("a"), F.col("r")).alias("level"), "n_name"), "level", names=[f"a{i}" for i in range(1, 6)])


_ROWS = range(5)


@query("transpose", "region", f"""SELECT 'r_regionkey' AS index, {', '.join(f"max(CASE WHEN r_regionkey = {i} THEN '{i}' END) AS row_{i}" for i in _ROWS)} FROM region
    UNION ALL SELECT 'r_name', {', '.join(f"max(CASE WHEN r_regionkey = {i} THEN r_name END) AS row_{i}" for i in _ROWS)} FROM region""")
def _(r):
    return P.transpose(r, ["r_regionkey"])


@query("explode_split", "part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(p):
    return P.explode(p.select("p_partkey", S.split(F.col("p_name"), " ").alias("word")), "word")


@query("union_distinct", ("customer", "supplier"), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(c, s):
    return P.union_distinct(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")))


@query("dedupe_first", "orders", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def _(o):
    return M.drop_duplicates(o.select("o_custkey", "o_orderkey"), ["o_custkey"], "first", ["o_orderkey"])


@query("dedupe_last", "orders", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def _(o):
    return M.drop_duplicates(o.select("o_custkey", "o_orderkey"), ["o_custkey"], "last", ["o_orderkey"])


@query("dedupe_none", "lineitem", "SELECT l_suppkey, l_partkey, max(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) = 1")
def _(li):
    return M.drop_duplicates(li.select("l_suppkey", "l_partkey", "l_orderkey"), ["l_suppkey", "l_partkey"], "none")


# ---------------------------------------------------------------- missing data, cumulative

_HOLES = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM events)"


def _holes(e: DataFrame) -> DataFrame:
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("v"))


_ORDER = {"order_by": ["ts", "event_id"], "by": ["user_id"]}


@query("drop_null", "events", f"SELECT event_id, v FROM {_HOLES} WHERE v IS NOT NULL")
def _(e):
    return M.drop_null(_holes(e), "v").select("event_id", "v")


@query("fill_value", "events", f"SELECT event_id, coalesce(v, -1) AS v FROM {_HOLES}")
def _(e):
    return M.fill_value(_holes(e), -1, ["v"]).select("event_id", "v")


@query("ffill", "events", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM {_HOLES}")
def _(e):
    return M.forward_fill(_holes(e), ["v"], **_ORDER).select("event_id", "v")


@query("bfill", "events", f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_HOLES}")
def _(e):
    return M.backward_fill(_holes(e), ["v"], **_ORDER).select("event_id", "v")


@query("ffill_limit", "events", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM {_HOLES}")
def _(e):
    return M.forward_fill(_holes(e), ["v"], limit=1, **_ORDER).select("event_id", "v")


@query("interpolate_linear", "events", f"""WITH a AS (SELECT *, row_number() OVER w AS i FROM {_HOLES} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS pi, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS pv,
      min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
      first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM a)
    SELECT event_id, CASE WHEN v IS NOT NULL THEN v::DOUBLE WHEN pi IS NULL OR ni IS NULL THEN NULL ELSE pv::DOUBLE + (nv::DOUBLE - pv::DOUBLE) * ((i - pi)::DOUBLE / (ni - pi)) END AS v FROM b""")
def _(e):
    return M.interpolate(_holes(e).withColumn("v", F.col("v").cast("double")), ["v"], **_ORDER).select("event_id", "v")


@query("cumulative", "events", f"""SELECT event_id, sum(v) OVER w::BIGINT AS cs, max(v) OVER w AS cx, min(v) OVER w AS cn, count(v) OVER w AS cc, CASE WHEN v IS NOT NULL THEN sum(v) OVER w END::BIGINT AS cp
    FROM {_HOLES} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(e):
    h = _holes(e).withColumns({n: F.col("v") for n in ("cs", "cx", "cn", "cc", "cp")})
    h = M.cum_min(M.cum_max(M.cum_sum(h, ["cs"], **_ORDER), ["cx"], **_ORDER), ["cn"], **_ORDER)
    return M.cum_sum(M.cum_count(h, ["cc"], **_ORDER), ["cp"], skip_nulls=False, **_ORDER).select("event_id", "cs", "cx", "cn", "cc", "cp")


@query("cumprod", "lineitem", "SELECT l_orderkey, l_linenumber, product(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS p FROM lineitem")
def _(li):
    return M.cum_prod(li.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("p")), ["p"], ["l_linenumber"], ["l_orderkey"])


# ---------------------------------------------------------------- statistics


@query("quantiles", "lineitem", "SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS quantile, unnest(quantile_cont(l_quantity, [0.1, 0.5, 0.9])) AS l_quantity FROM lineitem")
def _(li):
    return T.quantile(li, [0.1, 0.5, 0.9], columns=["l_quantity"])


@query("quantile_lower", "part", "SELECT 0.25::DOUBLE AS quantile, list_sort(list(p_size))[1 + floor(0.25 * (count(*) - 1))::INTEGER]::DOUBLE AS p_size FROM part")
def _(p):
    return T.quantile(p, [0.25], "lower", ["p_size"])


@query("corr_matrix", "lineitem", """SELECT 'l_quantity' AS column, 1.0::DOUBLE AS l_quantity, round(corr(l_quantity, l_extendedprice), 8) AS l_extendedprice FROM lineitem
    UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 8), 1.0 FROM lineitem""")
def _(li):
    return T.correlation(li, ["l_quantity", "l_extendedprice"]).select("column", F.round("l_quantity", 8).alias("l_quantity"), F.round("l_extendedprice", 8).alias("l_extendedprice"))


@query("cov_matrix", "lineitem", """SELECT 'l_quantity' AS column, round(var_samp(l_quantity), 5) AS l_quantity, round(covar_samp(l_quantity, l_discount), 7) AS l_discount FROM lineitem
    UNION ALL SELECT 'l_discount', round(covar_samp(l_quantity, l_discount), 5), round(var_samp(l_discount), 7) FROM lineitem""")
def _(li):
    return T.covariance(li, ["l_quantity", "l_discount"]).select("column", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_discount", 7).alias("l_discount"))


@query("skew_kurt", "orders", "SELECT round(skewness(o_totalprice), 8) AS sk, round(kurtosis(o_totalprice), 8) AS ku FROM orders")
def _(o):
    return o.agg(F.round(T.skewness("o_totalprice"), 8).alias("sk"), F.round(T.excess_kurtosis("o_totalprice"), 8).alias("ku"))


@query("mode", "part", "SELECT p_size FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1")
def _(p):
    return T.mode(p, ["p_size"])


@query("value_counts", "orders", "SELECT o_orderpriority, count(*)::DOUBLE AS count FROM orders GROUP BY ALL")
def _(o):
    return T.value_counts(o, ["o_orderpriority"], sort=False)


@query("value_shares", "orders", "SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders) AS count FROM orders GROUP BY ALL")
def _(o):
    return T.value_counts(o, ["o_orderstatus"], normalize=True, sort=False)


@query("n_unique", "orders", "SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT s) + max((s IS NULL)::INTEGER) AS s FROM (SELECT o_custkey, nullif(o_orderstatus, 'F') AS s FROM orders)")
def _(o):
    return T.n_unique(o.select("o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s")), drop_null=False)


@query("rank_methods", "supplier", """SELECT s_suppkey, rank() OVER w::DOUBLE AS mn, (rank() OVER w + count(*) OVER p - 1)::DOUBLE AS mx, rank() OVER w + (count(*) OVER p - 1) / 2 AS av, dense_rank() OVER w::DOUBLE AS dn, rank() OVER w / count(*) OVER () AS pc
    FROM supplier WINDOW w AS (ORDER BY s_nationkey), p AS (PARTITION BY s_nationkey)""")
def _(s):
    df = s.select("s_suppkey", *[F.col("s_nationkey").alias(n) for n in ("mn", "mx", "av", "dn", "pc")])
    for name, method in (("mn", "min"), ("mx", "max"), ("av", "average"), ("dn", "dense")):
        df = T.rank(df, [name], method)
    return T.rank(df, ["pc"], "min", pct=True)


# ---------------------------------------------------------------- strings


@query("str_lengths", "documents", "SELECT doc_id, strlen(text)::INTEGER AS bytes, length(text)::INTEGER AS runes, reverse(text) AS rev, upper(lang) AS up FROM documents")
def _(d):
    t = F.col("text")
    return d.select("doc_id", S.length(t).alias("bytes"), S.rune_length(t).alias("runes"), S.reverse(t).alias("rev"), S.to_upper(F.col("lang")).alias("up"))


@query("str_search", "documents", "SELECT doc_id, contains(text, 'the') AS has, starts_with(text, 'A') AS st, ends_with(text, '.') AS en, (strpos(text, 'the') - 1)::INTEGER AS at, ((length(text) - length(replace(text, 'th', ''))) / 2)::INTEGER AS n FROM documents")
def _(d):
    t = F.col("text")
    return d.select("doc_id", S.contains(t, "the").alias("has"), S.starts_with(t, "A").alias("st"), S.ends_with(t, ".").alias("en"), S.find(t, "the").alias("at"), S.count(t, "th").alias("n"))


@query("str_regex", "documents", r"SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS m, len(regexp_extract_all(text, '[A-Z][a-z]+'))::INTEGER AS n, CASE WHEN regexp_matches(text, '[a-z]+ing') THEN regexp_extract(text, '[a-z]+ing') END AS x, regexp_replace(text, '[aeiou]', '*', 'g') AS r FROM documents")
def _(d):
    t = F.col("text")
    return d.select("doc_id", S.match(t, "[0-9]{3}").alias("m"), S.count_matches(t, "[A-Z][a-z]+").alias("n"), S.extract(t, "[a-z]+ing").alias("x"), S.replace_regex(t, "[aeiou]", "*").alias("r"))


@query("str_pad_slice", "customer", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS z, rpad(c_mktsegment, 12, '.') AS r, substr(c_name, 3, 4) AS s, right(c_name, 3) AS t, replace(c_name, '0', 'o') AS p FROM customer")
def _(c):
    n = F.col("c_name")
    return c.select("c_custkey", S.zfill(F.col("c_custkey").cast("string"), 8).alias("z"), S.rpad(F.col("c_mktsegment"), 12, ".").alias("r"), S.slice_(n, 2, 4).alias("s"), S.right(n, 3).alias("t"), S.replace(n, "0", "o").alias("p"))


@query("str_parse", "part", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS i, string_split(p_type, ' ')[1] AS first_word, len(string_split(p_type, ' '))::INTEGER AS words, p_brand || '-' || p_size::VARCHAR AS j FROM part")
def _(p):
    b = F.col("p_brand")
    return p.select("p_partkey", S.to_integer(S.extract(b, "[0-9]+")).alias("i"), S.split_first(F.col("p_type"), " ").alias("first_word"), F.size(S.split(F.col("p_type"), " ")).alias("words"), S.join("-", b, F.col("p_size")).alias("j"))


@query("str_encode", "nation", "SELECT n_nationkey, base64(encode(n_name)) AS b, lower(hex(encode(n_name))) AS h, n_name AS back FROM nation")
def _(n):
    c = F.col("n_name")
    return n.select("n_nationkey", S.encode(c, "base64").alias("b"), S.encode(c, "hex").alias("h"), S.decode(S.encode(c, "base64"), "base64").alias("back"))


# ---------------------------------------------------------------- dates


@query("dt_components", "orders", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS mo, day(o_orderdate)::INTEGER AS d, dayofweek(o_orderdate)::INTEGER AS dw, dayofyear(o_orderdate)::INTEGER AS dy, quarter(o_orderdate)::INTEGER AS q, weekofyear(o_orderdate)::INTEGER AS w,
    dayofweek(o_orderdate) IN (0, 6) AS we, o_orderdate::DATE = last_day(o_orderdate) AS me FROM orders""")
def _(o):
    t = F.col("o_orderdate")
    return o.select("o_orderkey", D.year(t).alias("y"), D.month(t).alias("mo"), D.day(t).alias("d"), D.day_of_week(t).alias("dw"), D.day_of_year(t).alias("dy"), D.quarter(t).alias("q"), D.week_of_year(t).alias("w"), D.is_weekend(t).alias("we"), D.is_month_end(t).alias("me"))


@query("dt_truncate", "events", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('month', ts)::TIMESTAMP AS m, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END::TIMESTAMP AS c FROM events")
def _(e):
    t = F.col("ts")
    return e.select("event_id", D.floor(t, "hour").alias("h"), D.floor(t, "week").alias("w"), D.floor(t, "month").alias("m"), D.ceil(t, "day").alias("c"))


@query("dt_arithmetic", "orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 10 DAY AS a, o_orderdate - INTERVAL 90 MINUTE AS s, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS d FROM orders")
def _(o):
    t = F.col("o_orderdate")
    return o.select("o_orderkey", D.add(t, "1mo 10d").alias("a"), D.sub(t, "90min").alias("s"), D.diff_days(t, F.lit("1995-01-01").cast("date")).alias("d"))


@query("dt_format", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f FROM orders")
def _(o):
    return o.select("o_orderkey", D.format_(F.col("o_orderdate"), "%Y/%m/%d %H:%M").alias("f"))


@query("dt_business_days", "orders", """SELECT o_orderkey, (SELECT d FROM (SELECT (o_orderdate::DATE + i::INTEGER) AS d, row_number() OVER (ORDER BY i) AS k FROM range(1, 20) t(i) WHERE dayofweek(o_orderdate::DATE + i::INTEGER) NOT IN (0, 6)) WHERE k = 7) AS b FROM orders""")
def _(o):
    return o.select("o_orderkey", D.add_business_days(F.col("o_orderdate"), 7).cast("date").alias("b"))


@query("dt_range", "region", "SELECT unnest(range(TIMESTAMP '2024-01-30', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)) AS ts")
def _(r):
    return D.date_range(r.sparkSession, "2024-01-30", "2024-03-02", "1d", closed="left")


@query("resample_1h", "events", "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 6) AS value_sum, count(*) AS value_count, max(value) AS value_max FROM events GROUP BY ALL")
def _(e):
    return Z.resample(e, "ts", "1h", "value", ["sum", "count", "max"]).withColumn("value_sum", F.round("value_sum", 6))


@query("resample_week_by", "events", "SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS ts, count(*) AS value_count, min(value) AS value_min FROM events GROUP BY event_type, date_trunc('week', ts)")
def _(e):
    return Z.resample(e, "ts", "1w", "value", ["count", "min"], by=["event_type"])


@query("resample_right", "events", "SELECT time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS ts, count(*) AS value_count FROM events GROUP BY ALL")
def _(e):
    return Z.resample(e, "ts", "6h", "value", ["count"], closed="right", label="right")
