"""Registered queries of files, constructors, frames, expressions, texts and times, beside those of `catalogue`.

Queries of files write a table to the shared folder and read it back, so the oracle is the table itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import frame
from sparkloom.functions import builder as B
from sparkloom.functions import exprs as X
from sparkloom.functions import strings as S
from sparkloom.functions import temporal as D
from sparkloom.operators import joins as J
from sparkloom.operators import rows as R
from sparkloom.operators import window as W
from sparkloom.plans.registry import query
from sparkloom.sources import files as IO
from sparkloom.sources import series as C
from sparkloom.storage import new_path
from sparkloom.streaming import windows as streams
from sparkloom.types import col_type

# ---------------------------------------------------------------- files


@query("io_csv", "customer", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(c):
    path = new_path(c.sparkSession, "csv")
    IO.write_csv(c, path)
    return IO.read_csv(c.sparkSession, path)


@query("io_csv_options", "customer", "SELECT c_custkey::DOUBLE AS c_custkey, c_name || chr(10) || '\"x\"; y' AS c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def _(c):
    path = new_path(c.sparkSession, "csv-options")
    odd = c.select("c_custkey", F.concat("c_name", F.lit('\n"x"; y')).alias("c_name"), "c_mktsegment", "c_acctbal")
    IO.write_csv(odd, path, delimiter=";", quote_all=True)
    return IO.read_csv(c.sparkSession, path, delimiter=";", columns=["c_custkey", "c_name", "c_mktsegment"], types={"c_custkey": "f64"}, null_values=["", "BUILDING"])


@query("io_csv_skip_rows", "nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(n):
    path = new_path(n.sparkSession, "csv-skip")
    lines = n.orderBy("n_nationkey").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    # Two files, each with two lines of junk and a header.
    for i, part in enumerate((lines.limit(10), lines.offset(10))):
        body = "\n".join(["junk", "more, junk", "n_nationkey,n_name", *[r[0] for r in part.collect()]])  # 25 nations
        n.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{path}/{i}")
    return IO.read_csv(n.sparkSession, f"{path}/*", skip_rows=2)


@query("io_scan_csv", "part", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size > 25")
def _(p):
    path = new_path(p.sparkSession, "csv-scan")
    IO.write_csv(p.select("p_partkey", "p_name", "p_size"), path)
    return frame.scan_csv(p.sparkSession, path).filter(F.col("p_size") > 25).select("p_partkey", "p_size").df


@query("io_parquet", "lineitem", "SELECT * FROM lineitem")
def _(li):
    path = new_path(li.sparkSession, "parquet")
    IO.write_parquet(li, path, "zstd", partition_by=["l_returnflag"])
    return IO.read_parquet(li.sparkSession, path, schema=li.schema)


@query("io_parquet_options", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def _(o):
    path = new_path(o.sparkSession, "parquet-options")
    IO.write_parquet(o, path, "gzip", row_group_bytes=1 << 20, dictionary=False)
    return IO.read_parquet(o.sparkSession, path, columns=["o_orderkey", "o_totalprice"], where=F.col("o_totalprice") > 1000, merge_schema=True)


@query("io_ndjson", "events", "SELECT event_id, user_id, event_type, value, nullif(event_type, 'click') AS maybe FROM events")
def _(e):
    path = new_path(e.sparkSession, "ndjson")
    some = e.select("event_id", "user_id", "event_type", "value", F.nullif(F.col("event_type"), F.lit("click")).alias("maybe"))
    IO.write_ndjson(some, path, "gzip")
    return IO.read_ndjson(e.sparkSession, path, schema=some.schema)


@query("io_ndjson_nested", "customer", "SELECT c_custkey, c_name AS \"who.name\", c_nationkey::BIGINT AS \"who.nation\", '[' || c_nationkey || ',1]' AS tags FROM customer")
def _(c):
    path = new_path(c.sparkSession, "ndjson-nested")
    IO.write_ndjson(c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"), F.array("c_nationkey", F.lit(1)).alias("tags")), path)
    return IO.read_ndjson(c.sparkSession, path, flat=True)


@query("io_json", "supplier", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def _(s):
    path = new_path(s.sparkSession, "json")
    IO.write_json(s, path, compress=True)
    return IO.read_json(s.sparkSession, path)


@query("io_json_values", "region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(r):
    path = new_path(r.sparkSession, "json-values")
    IO.write_json(r, path, orient="values")
    text = "".join(x[0] for x in r.sparkSession.read.text(path, wholetext=True).collect())  # five regions
    return IO.from_columns(r.sparkSession, {n: [row[i] for row in json.loads(text)] for i, n in enumerate(r.columns)})


@query("io_json_columns", "region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(r):
    return IO.from_columns(r.sparkSession, json.loads(IO.to_json_text(r, "columns", pretty=True)))


@query("io_stream", "events", "SELECT event_id, value FROM events")
def _(e):
    spark = e.sparkSession
    first, last, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    some = e.select("event_id", "value")
    IO.write_ndjson(some.repartition(3), first)
    streams.write_ndjson_stream(streams.read_ndjson_stream(spark, first, some.schema), last, state).awaitTermination()
    return IO.read_ndjson(spark, last, schema=some.schema)


@query("io_chunks", "nation", "SELECT 3::BIGINT AS calls, 25::BIGINT AS total, max(n_name) AS last_name FROM nation")
def _(n):
    got: list[dict] = []
    calls = IO.read_chunks(n.orderBy("n_nationkey"), 10, got.extend)
    return n.sparkSession.createDataFrame([(calls, len(got), max(r["n_name"] for r in got))], "calls long, total long, last_name string")


@query("io_arrow", "nation", "SELECT * FROM nation")
def _(n):
    return IO.from_arrow(n.sparkSession, IO.to_arrow(n))


# ---------------------------------------------------------------- constructors, frames, expressions


@query("make_records", "region", "SELECT * FROM (VALUES (1, 1.5::DOUBLE, 'x', true), (2, 2.0, NULL, NULL), (3, NULL, 'z', false)) t(a, b, c, d)")
def _(r):
    return IO.from_records(r.sparkSession, [{"a": 1, "b": 1.5, "c": "x", "d": True}, {"a": 2, "b": 2}, {"a": 3, "c": "z", "d": False}], {"a": "i32", "b": "f64", "c": "string", "d": "bool"})


@query("make_columns", "region", "SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE, 'a'), (2, 2.5, NULL)) t(i, f, s)")
def _(r):
    return IO.from_columns(r.sparkSession, {"i": [1, 2], "f": [1, 2.5], "s": ["a", None]})


@query("make_series", "region", """SELECT 'bool' AS kind, 1::BIGINT AS nulls, 'true,null' AS shown UNION ALL SELECT 'i8', 1, '-5,null' UNION ALL SELECT 'i16', 1, '-5,null' UNION ALL SELECT 'i32', 1, '-5,null' UNION ALL SELECT 'i64', 1, '-5,null'
    UNION ALL SELECT 'u8', 1, '200,null' UNION ALL SELECT 'u16', 1, '200,null' UNION ALL SELECT 'u32', 1, '200,null' UNION ALL SELECT 'u64', 1, '200,null' UNION ALL SELECT 'f32', 1, '0.5,null' UNION ALL SELECT 'f64', 1, '0.5,null'
    UNION ALL SELECT 'string', 1, 'x,null' UNION ALL SELECT 'binary', 1, 'x,null'""")
def _(r):
    from decimal import Decimal

    spark = r.sparkSession
    made = {
        "bool": (C.boolean_series, True), "i8": (C.int8_series, -5), "i16": (C.int16_series, -5), "i32": (C.int32_series, -5), "i64": (C.int64_series, -5), "u8": (C.uint8_series, 200), "u16": (C.uint16_series, 200), "u32": (C.uint32_series, 200),
        "u64": (C.uint64_series, Decimal(200)), "f32": (C.float32_series, 0.5), "f64": (C.float64_series, 0.5), "string": (C.string_series, "x"), "binary": (C.binary_series, b"x"),
    }
    out = None
    for kind, (make, value) in made.items():
        s = make(spark, "v", [value, value], validity=[True, False])
        one = s.agg(F.lit(kind).alias("kind"), F.sum(F.col("v").isNull().cast("long")).alias("nulls"), F.concat_ws(",", F.max(F.col("v").cast("string")), F.lit("null")).alias("shown"))
        out = one if out is None else out.unionByName(one)
    return out


@query("add_column", "nation", "SELECT n_nationkey, n_name, 100 - row_number() OVER (ORDER BY n_nationkey) + 1 AS score FROM nation")
def _(n):
    return R.add_column(n.select("n_nationkey", "n_name"), C.series(n.sparkSession, "score", list(range(100, 75, -1))), ["n_nationkey"])


@query("with_columns_frame", ("nation", "nation"), "SELECT n_nationkey, n_name, lead(n_name, 0) OVER (ORDER BY n_nationkey) AS other FROM nation")
def _(a, b):
    return R.hstack(a.select("n_nationkey", "n_name"), b.select(F.col("n_name").alias("other"), F.col("n_nationkey").alias("k")), ["n_nationkey"], ["k"]).drop("k")


@query("with_column", "supplier", "SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def _(s):
    return R.with_column(s.select("s_suppkey", "s_acctbal"), "s_acctbal", F.col("s_acctbal") * 2)


@query("with_columns_ordered", "supplier", "SELECT s_suppkey, s_acctbal + 1 AS a, (s_acctbal + 1) * 3 AS b FROM supplier")
def _(s):
    return R.with_columns_ordered(s, [("a", F.col("s_acctbal") + 1), ("b", F.col("a") * 3)]).select("s_suppkey", "a", "b")


@query("with_columns_literals", "supplier", "SELECT s_suppkey, 'b' AS a, 'a' AS b, sqrt(abs(s_acctbal)) AS abs, abs(s_acctbal) AS sqrt FROM supplier")
def _(s):
    k = F.col("s_acctbal")
    return R.with_columns(s, {"a": F.lit("b"), "b": F.lit("a"), "abs": F.sqrt(F.abs(k)), "sqrt": F.abs(k)}).select("s_suppkey", "a", "b", "abs", "sqrt")


@query("select_wildcard", "nation", "SELECT * FROM nation")
def _(n):
    return R.select(n, "*")


@query("select_by_type", "part", "SELECT p_name, p_brand, p_type, p_partkey FROM part")
def _(p):
    return R.select(p, col_type("string"), "p_partkey")


@query("null_predicates", "orders", "SELECT o_orderkey, s IS NULL AS missing, s IS NOT NULL AS present FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)")
def _(o):
    s = B.Expr(F.nullif(F.col("o_orderstatus"), F.lit("F")))
    return o.select("o_orderkey", s.is_null().alias("missing").build(), s.is_not_null().alias("present").build())


@query("expr_builder", "lineitem", """SELECT l_orderkey, l_linenumber, (l_quantity + 1) * 2 > 50 AND NOT l_linenumber % 2 = 0 AS picked, upper(l_returnflag) AS flag, year(l_shipdate)::INTEGER AS y, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS whole FROM lineitem""")
def _(li):
    picked = B.col("l_quantity").add(1).mul(2).gt(50).and_(B.col("l_linenumber").mod(2).eq(0).not_())
    whole = B.col("l_quantity").sum().over(W.Spec().partition_by("l_orderkey"))
    return li.select("l_orderkey", "l_linenumber", picked.alias("picked").build(), B.col("l_returnflag").str().to_upper().alias("flag").build(), B.col("l_shipdate").dt().year().alias("y").build(), whole.alias("whole").build())


@query("expr_builder_agg", "orders", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n, median(o_totalprice) AS mid, arg_min(o_orderstatus, o_orderkey) AS first_s FROM orders GROUP BY ALL")
def _(o):
    p = B.col("o_totalprice")
    return frame.Frame(o).group_by("o_orderpriority").agg({"lo": p.min().build(), "hi": p.max().build(), "n": p.count().build(), "mid": p.median().build(), "first_s": B.col("o_orderstatus").first("o_orderkey").build()}).df


@query("over_expressions", "events", """SELECT event_id, row_number() OVER w AS r, count(value) OVER (PARTITION BY user_id) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(e):
    by = W.Spec().partition_by("user_id").order_by("ts").order_by("event_id")
    return e.select("event_id", W.row_number().over(by).alias("r"), W.count("value").over(W.Spec().partition_by("user_id")).alias("n"), F.round(W.sum_("value").over(by.current_row().unbounded_following()), 6).alias("ahead"))


@query("win_bounds", "events", """SELECT event_id, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS here
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(e):
    by = W.Spec().partition_by("user_id").order_by("ts").order_by("event_id")
    out = W.over(e.select("event_id", "user_id", "ts"), "before", W.count_rows(), by.unbounded_preceding())
    return W.over(W.over(out, "after", W.count_rows(), by.unbounded_following()), "here", W.count_rows(), by.current_row()).select("event_id", "before", "after", "here")


@query("frame_access", "nation", "SELECT 25::BIGINT AS height, 3::BIGINT AS width, false AS empty, true AS has, (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 3) AS fourth, 'n_name' AS second_column, 25::BIGINT AS cloned, '25 x 3' AS shown")
def _(n):
    height, width = R.shape(n)
    values = (height, width, R.is_empty(n), R.has_column(n, "n_name"), R.get_row(n, 3, ["n_nationkey"])["n_name"], R.column_at(n, 1).columns[0], R.clone(n).count(), R.to_text(n).split("\n")[0])
    return n.sparkSession.createDataFrame([values], "height long, width long, empty boolean, has boolean, fourth string, second_column string, cloned long, shown string")


@query("lazy_frame", "lineitem", "SELECT l_returnflag, l_quantity_sum FROM (SELECT l_returnflag, sum(l_quantity) AS l_quantity_sum FROM lineitem WHERE l_discount < 0.05 GROUP BY ALL)")
def _(li):
    f = frame.Frame(li).filter(F.col("l_discount") < 0.05).group_by("l_returnflag").sum("l_quantity")
    if "PushedFilters" not in f.explain() or "l_comment" in f.explain():
        raise AssertionError("the filter should reach the scan")
    return f.df


@query("set_operations", ("customer", "supplier"), """SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'left', k FROM (SELECT c_custkey % 40 AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def _(c, s):
    left, right = frame.Frame(c.select(F.col("c_nationkey").alias("k"))), frame.Frame(s.select(F.col("s_nationkey").alias("k")))
    more = frame.Frame(c.select((F.col("c_custkey") % 40).cast("int").alias("k")))
    both = left.intersect(right).df.select(F.lit("both").alias("kind"), F.col("k").cast("long").alias("k"))
    return both.unionByName(more.subtract(right).df.select(F.lit("left").alias("kind"), F.col("k").cast("long").alias("k")))


@query("sort_int", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(li):
    return R.sort(li.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")


@query("sort_multi", "lineitem", "SELECT l_returnflag, l_shipdate, l_orderkey FROM lineitem")
def _(li):
    return R.sort(li.select("l_returnflag", "l_shipdate", "l_orderkey"), "l_returnflag", "l_shipdate", descending=[False, True])


# ---------------------------------------------------------------- texts


@query("str_case", "customer", """SELECT c_custkey, upper(left(m, 1)) || lower(substr(m, 2)) AS cap, list_aggregate(list_transform(string_split(x, ''), lambda c: CASE WHEN upper(c) = c THEN lower(c) ELSE upper(c) END), 'string_agg', '') AS swapped,
    list_aggregate(list_transform(string_split(lower(m) || ' ' || lower(m), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ') AS title, lower(m) AS low FROM (SELECT c_custkey, c_mktsegment AS m, c_name AS x FROM customer)""")
def _(c):
    m = F.col("c_mktsegment")
    return c.select("c_custkey", S.capitalize(m).alias("cap"), S.swap_case(F.col("c_name")).alias("swapped"), S.to_title(F.concat(m, F.lit(" "), m)).alias("title"), S.to_lower(m).alias("low"))


_WORDS = "(SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)"


def _words(d: DataFrame) -> DataFrame:
    return d.select(F.explode(F.split("text", " ")).alias("w"))


@query("str_predicates", "documents", rf"""SELECT count(*) AS n, count(*) FILTER (regexp_full_match(w, '\p{{L}}+')) AS alpha, count(*) FILTER (regexp_full_match(w, '\p{{N}}+')) AS num, count(*) FILTER (regexp_full_match(w, '[\p{{L}}\p{{N}}]+')) AS alnum, count(*) FILTER (regexp_full_match(w, '[\x00-\x7F]*')) AS ascii,
    count(*) FILTER (upper(w) = w AND regexp_matches(w, '\p{{L}}')) AS up, count(*) FILTER (lower(w) = w AND regexp_matches(w, '\p{{L}}')) AS low, count(*) FILTER (TRY_CAST(w AS DOUBLE) IS NOT NULL AND regexp_full_match(w, '[0-9.]+')) AS parsed,
    count(*) FILTER (regexp_full_match(w, '[\s]+')) AS space, count(*) AS utf8 FROM {_WORDS}""")
def _(d):
    w = F.col("w")
    number = lambda p: F.count(F.when(p, 1))
    tests = {"alpha": S.is_alpha(w), "num": S.is_numeric(w), "alnum": S.is_alphanumeric(w), "ascii": S.is_ascii(w), "up": S.is_upper(w), "low": S.is_lower(w), "parsed": S.is_numeric_str(w) & w.rlike(r"^[0-9.]+\z"), "space": S.is_space(w), "utf8": S.is_utf8(w)}
    return _words(d).agg(F.count(F.lit(1)).alias("n"), *[number(p).alias(n) for n, p in tests.items()])


@query("str_last_line_break", "region", r"SELECT r_regionkey, false AS alpha, false AS num, false AS alnum, true AS ascii, false AS ascii2, true AS title FROM region")
def _(r):
    k = F.col("r_regionkey").cast("string")
    return r.select("r_regionkey", S.is_alpha(F.concat("r_name", F.lit("\n"))).alias("alpha"), S.is_numeric(F.concat(k, F.lit("\n"))).alias("num"), S.is_alphanumeric(F.concat(k, F.lit("\n"))).alias("alnum"), S.is_ascii(F.concat(k, F.lit("\n"))).alias("ascii"), S.is_ascii(F.concat(k, F.lit("\u0085"))).alias("ascii2"), S.is_title(F.lit("A Title Of Words")).alias("title"))


@query("str_trim", "customer", "SELECT c_custkey, c_name AS t, c_name || '  ' AS l, '  ' || c_name AS r, trim(c_name, 'C0') AS x, CASE WHEN starts_with(c_name, 'Cust') THEN substr(c_name, 5) ELSE c_name END AS p, CASE WHEN ends_with(c_name, '1') THEN left(c_name, length(c_name) - 1) ELSE c_name END AS s FROM customer")
def _(c):
    n = F.col("c_name")
    wide = F.concat(F.lit("  "), n, F.lit("  "))
    return c.select("c_custkey", S.strip(wide).alias("t"), S.ltrim(wide).alias("l"), S.rtrim(wide).alias("r"), S.trim(n, "C0").alias("x"), S.trim_prefix(n, "Cust").alias("p"), S.trim_suffix(n, "1").alias("s"))


@query("str_justify", "nation", """SELECT n_nationkey, CASE WHEN length(n_name) >= 12 THEN n_name ELSE rpad(n_name, 12, '.') END AS l, CASE WHEN length(n_name) >= 12 THEN n_name ELSE lpad(n_name, 12, '.') END AS r,
    CASE WHEN length(n_name) >= 12 THEN n_name ELSE repeat('=', (12 - length(n_name)) // 2) || n_name || repeat('=', 12 - length(n_name) - (12 - length(n_name)) // 2) END AS c, n_name || n_name AS twice, n_name || '-x' AS con, n_name || '/' || n_name AS listed FROM nation""")
def _(n):
    c = F.col("n_name")
    return n.select("n_nationkey", S.ljust(c, 12, ".").alias("l"), S.rjust(c, 12, ".").alias("r"), S.center(c, 12, "=").alias("c"), S.repeat(c, 2).alias("twice"), S.concat(c, F.lit("-x")).alias("con"), S.join_list(F.array(c, c), "/").alias("listed"))


@query("str_regex_lists", "part", r"SELECT p_partkey, regexp_extract_all(p_type, '[A-Z][A-Z]+') AS found, regexp_split_to_array(p_brand, '[#0-2]') AS parts, CASE WHEN regexp_matches(p_brand, '[0-9]') THEN (length(regexp_extract(p_brand, '^[^0-9]*')))::INTEGER ELSE -1 END AS at, string_split(p_type, ' ')[1] AS head FROM part")
def _(p):
    b, t = F.col("p_brand"), F.col("p_type")
    return p.select("p_partkey", S.extract_all(t, "[A-Z][A-Z]+").alias("found"), S.split_regex(b, "[#0-2]").alias("parts"), S.find_all(b, "[0-9]").alias("at"), F.get(S.split_n(t, " ", 2), F.lit(0)).alias("head"))


@query("str_numbers", "part", "SELECT p_partkey, TRY_CAST(p_retailprice::VARCHAR AS DOUBLE) AS f, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS b, p_size::TINYINT AS narrow FROM part")
def _(p):
    flag = F.element_at(F.array(F.lit("Yes"), F.lit("off"), F.lit("maybe"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    df = p.select("p_partkey", S.to_float(F.col("p_retailprice").cast("string")).alias("f"), S.to_boolean(flag).alias("b"), F.col("p_size").cast("string").alias("narrow"))
    return S.to_integer_column(df, "narrow")


@query("str_times", "orders", """SELECT o_orderkey, o_orderdate AS at, o_orderdate::DATE AS d, (hour(o_orderkey_t) * 3600 + minute(o_orderkey_t) * 60 + second(o_orderkey_t)) * 1000000000 AS t, NULL::TIMESTAMP AS bad
    FROM (SELECT *, TIMESTAMP '2020-01-01' + INTERVAL 1 SECOND * (o_orderkey % 86400) AS o_orderkey_t FROM orders)""")
def _(o):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    clock = F.date_format(F.timestamp_seconds(F.col("o_orderkey") % 86400), "HH:mm:ss")
    return o.select("o_orderkey", S.to_datetime(text).alias("at"), S.to_date(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("d"), S.to_time(clock).alias("t"), S.to_datetime(F.lit("no time"), "%Y-%m-%d").alias("bad"))


@query("str_format", "customer", "SELECT c_custkey, printf('%05d|%s', c_custkey, c_mktsegment) AS f, 'Dear ' || c_name || ', no ' || c_custkey AS t FROM customer")
def _(c):
    return c.select("c_custkey", S.format_("%05d|%s", F.col("c_custkey"), F.col("c_mktsegment")).alias("f"), S.format_template("Dear {{.name}}, no {id}", {"name": F.col("c_name"), "id": F.col("c_custkey")}).alias("t"))


@query("str_tabs", "nation", "SELECT n_nationkey, n_name || repeat(' ', 8 - length(n_name) % 8) || 'x' AS tabs FROM nation")
def _(n):
    return n.select("n_nationkey", S.expand_tabs(F.concat("n_name", F.lit("\tx"))).alias("tabs"))


@query("str_wrap", "part", """SELECT p_partkey, CASE WHEN length(w[1]) + 1 + length(w[2]) <= 14 THEN w[1] || ' ' || w[2] || CASE WHEN length(w[1]) + length(w[2]) + 2 + length(w[3]) <= 14 THEN ' ' ELSE chr(10) END || w[3]
    ELSE w[1] || chr(10) || w[2] || CASE WHEN length(w[2]) + 1 + length(w[3]) <= 14 THEN ' ' ELSE chr(10) END || w[3] END AS wrapped FROM (SELECT p_partkey, string_split(p_name || ' and ' || p_brand, ' ') AS a, [a[1], 'of', p_brand] AS w FROM part)""")
def _(p):
    return p.select("p_partkey", S.wrap(F.concat(F.get(F.split("p_name", " "), F.lit(0)), F.lit(" of "), F.col("p_brand")), 14).alias("wrapped"))


@query("str_normalize", "documents", "SELECT doc_id, nfc_normalize(text) AS c FROM documents")
def _(d):
    return d.select("doc_id", S.normalize_nfc(S.normalize_nfd(F.col("text"))).alias("c"))


# ---------------------------------------------------------------- times


_AT = "(SELECT event_id, ts, ts + INTERVAL 1 MICROSECOND * (event_id % 1000000) AS t FROM events)"


def _at(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000000).alias("t"))


@query("dt_clock", "events", f"""SELECT event_id, hour(t)::INTEGER AS h, minute(t)::INTEGER AS m, second(t)::INTEGER AS s, (epoch_us(t) % 1000000)::INTEGER AS us, (epoch_us(t) % 1000000 // 1000)::INTEGER AS ms, (epoch_us(t) % 1000000 * 1000)::INTEGER AS ns, isoyear(t)::INTEGER AS iy,
    (year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0)) AS leap, day(t) = 1 AS msta, (day(t) = 1 AND month(t) % 3 = 1) AS qsta, (t::DATE = last_day(t) AND month(t) % 3 = 0) AS qend, dayofyear(t) = 1 AS ysta, (month(t) = 12 AND day(t) = 31) AS yend FROM {_AT}""")
def _(e):
    t = F.col("t")
    parts = {"h": D.hour, "m": D.minute, "s": D.second, "us": D.microsecond, "ms": D.millisecond, "ns": D.nanosecond, "iy": D.iso_year, "leap": D.is_leap_year, "msta": D.is_month_start, "qsta": D.is_quarter_start, "qend": D.is_quarter_end, "ysta": D.is_year_start, "yend": D.is_year_end}
    return _at(e).select("event_id", *[f(t).alias(n) for n, f in parts.items()])


@query("dt_round", "events", f"""SELECT event_id, CASE WHEN epoch_us(t) - epoch_us(date_trunc('hour', t)) < 1800000000 THEN date_trunc('hour', t) ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END::TIMESTAMP AS h,
    CASE WHEN epoch_us(t) - epoch_us(date_trunc('day', t)) < 43200000000 THEN date_trunc('day', t) ELSE date_trunc('day', t) + INTERVAL 1 DAY END::TIMESTAMP AS d, date_trunc('minute', t)::TIMESTAMP AS m FROM {_AT}""")
def _(e):
    t = F.col("t")
    return _at(e).select("event_id", D.round_(t, "hour").alias("h"), D.round_(t, "day").alias("d"), D.truncate(t, "minute").alias("m"))


@query("dt_durations", "events", "SELECT event_id, ts + INTERVAL 2 HOUR + INTERVAL 30 MINUTE AS a, ts - INTERVAL 3 DAY AS b, ts + INTERVAL 14 MONTH AS c, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS n FROM events")
def _(e):
    t = F.col("ts")
    hours = D.Duration.parse("1h 15m") * 2
    return e.select("event_id", D.add(t, hours).alias("a"), D.sub(t, D.Duration.of(1, "week") - D.Duration.of(4, "day")).alias("b"), D.add(t, "1y 2mo").alias("c"), D.diff(t, F.lit("2024-01-01").cast("timestamp")).alias("n"))


@query("dt_zones", "events", "SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS ny, timezone('Asia/Tokyo', timezone('UTC', ts)) AS tokyo, ts AS back, 'America/New_York' AS label FROM events")
def _(e):
    t = F.col("ts")
    shown = D.convert_column(e.select("event_id", "ts", t.alias("ny")), "ny", "EST")
    back = D.to_utc(D.in_timezone(t, "Asia/Tokyo"), "Asia/Tokyo")
    return shown.select("event_id", "ny", D.convert_timezone(t, "JST").alias("tokyo"), D.localize(back, "Europe/Paris").alias("back"), F.lit(D.get_timezone(shown, "ny")).alias("label"))


@query("dt_epochs", "events", "SELECT event_id, to_timestamp(event_id)::TIMESTAMP AS s, make_timestamp(event_id * 1000) AS ms, make_timestamp(event_id) AS us FROM events")
def _(e):
    n = F.col("event_id")
    return e.select("event_id", D.from_epoch(n).alias("s"), D.from_epoch(n, "ms").alias("ms"), D.from_epoch(n * 1000, "ns").alias("us"))


@query("dt_range_builder", "region", "SELECT unnest(generate_series(TIMESTAMP '2024-01-31 05:00:00', TIMESTAMP '2024-02-02 05:00:00', INTERVAL 6 HOUR)) AS ts")
def _(r):
    made = D.DateRangeBuilder().start("2024-01-31 00:00:00").frequency("6h").count(9).timezone("EST").build(r.sparkSession)
    return made.select("ts")


@query("dt_business_range", "region", "SELECT d AS ts FROM (SELECT unnest(generate_series(TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) NOT IN (0, 6)")
def _(r):
    return D.date_range(r.sparkSession, "2024-03-01", "2024-03-31", business=True)


@query("join_where_correlated", ("orders", "orders"), "SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_totalprice < b.o_totalprice AND a.o_totalprice + 40 > b.o_totalprice")
def _(a, b):
    left = a.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") + 40).alias("upto"))
    right = b.select(F.col("o_orderkey").alias("other"), F.col("o_totalprice").alias("price"))
    return J.join_where(left, right, [("o_totalprice", "<", "price"), ("upto", ">", "price")]).select("o_orderkey", "other")


@query("cast_types", "part", "SELECT p_partkey, p_size::TINYINT AS i8, p_size::SMALLINT AS u8, p_retailprice::FLOAT AS f32, p_partkey::VARCHAR AS s FROM part")
def _(p):
    size = F.col("p_size")
    return p.select("p_partkey", X.cast(size, "i8").alias("i8"), X.cast(size, "u8").alias("u8"), X.cast(F.col("p_retailprice"), "f32").alias("f32"), X.cast(F.col("p_partkey"), "string").alias("s"))
