"""Equi joins of seven kinds, inequality, as-of and rolling-window joins.

Null keys never match. A side is only broadcast for an inequality after a check of its rows and bytes;
equi joins leave the choice to Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.rows import check_columns, indexed
from sparkloom.storage import fits, materialise

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
#: Rows of a side that every row of the other is compared with, at most.
BROADCAST_ROWS = 5_000
#: Rows of a key of `by` from which on it is cut into ranges.
HOT_ROWS = 5_000_000
#: Ranges that an ungrouped as-of join is dealt over: as many as shuffle partitions, within these bounds. Ranges of an
#: inequality whose predicates have several right columns, at most.
BUCKETS = (32, 256)
#: Rows of the right side of an inequality in a piece, which a left row meets as a whole or not at all.
PIECE_ROWS = 512
#: Rows of a right side whose pieces are broadcast, at most.
BROADCAST_PIECE_ROWS = 250_000


def _few(df: DataFrame) -> bool:
    return fits(df, BROADCAST_ROWS)


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{tag}{i}") for i, c in enumerate(df.columns)])


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, how: str = "inner", left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, suffix: str = "_right") -> DataFrame:
    """Equi join. The right side's keys are dropped (merged with the left's for right and outer
    joins); its other columns that clash get the suffix."""
    if how not in KINDS:
        raise ValueError(f"unknown join type: {how}")
    on = [on] if isinstance(on, str) else on
    lk, rk = list(left_on or on or []), list(right_on or on or [])
    if how != "cross":
        if not lk or len(lk) != len(rk):
            raise ValueError("join columns of both sides are needed, equal in number")
        check_columns(left, lk)
        check_columns(right, rk)
        types_l, types_r = dict(left.dtypes), dict(right.dtypes)
        for a, b in zip(lk, rk, strict=True):
            if types_l[a] != types_r[b]:
                raise ValueError(f"incompatible types: {a} is {types_l[a]}, {b} is {types_r[b]}")
    a, b = _tagged(left, "l"), _tagged(right, "r")
    la = {c: f"l{i}" for i, c in enumerate(left.columns)}
    rb = {c: f"r{i}" for i, c in enumerate(right.columns)}
    if how == "cross":
        joined = a.crossJoin(b)
    else:
        condition = None
        for x, y in zip(lk, rk, strict=True):
            equal = F.col(la[x]) == F.col(rb[y])
            condition = equal if condition is None else condition & equal
        joined = a.join(b, condition, KINDS[how])
    if how in ("semi", "anti"):
        return joined.select(*[F.col(la[c]).alias(c) for c in left.columns])
    merged = dict(zip(lk, rk, strict=True)) if how in ("right", "outer", "full") else {}
    out = [(F.coalesce(la[c], rb[merged[c]]) if c in merged else F.col(la[c])).alias(c) for c in left.columns]
    for c in right.columns:
        if c not in rk:
            out.append(F.col(rb[c]).alias(c + suffix if c in left.columns else c))
    return joined.select(*out)


_SWAPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _bounds(values: DataFrame, column: str) -> list:
    """Distinct quantiles of a numeric column that cut it into the ranges."""
    n = min(max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS[0]), BUCKETS[1])
    found = values.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 4 * n)).first()[0]
    return sorted(set(found or []))


def _bucket(c: Column, bounds: list) -> Column:
    """Number of bounds at or below a value, by a balanced tree of comparisons; null stays null."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(c.isNotNull(), tree(0, len(bounds)))


_COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _leading(n: int, holds: Callable[[Column], Column]) -> Column:
    """Of n places that hold up to some place and not from there on, how many hold. Null doesn't hold."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(holds(at + step - 1), step).otherwise(0))


def _by_pieces(a: DataFrame, b: DataFrame, predicates: list[tuple[str, str, str]], by: str) -> DataFrame:
    """Pairs of rows of a and b, all that match among them. b is sorted along `by` and cut into pieces."""
    small = fits(b, BROADCAST_PIECE_ROWS)
    for x, _, y in predicates:
        a, b = a.where(F.col(x).isNotNull()), b.where(F.col(y).isNotNull())
    columns = b.columns
    placed = indexed(b, [by])
    n = max(1, -(-placed.count() // PIECE_ROWS))
    other = [(x, op, y) for x, op, y in predicates if y != by]
    ranges = min(n, BUCKETS[1]) if other else n
    piece = F.floor(F.col("__i") / PIECE_ROWS)
    placed = placed.withColumn("piece", piece.cast("int")).withColumn("range", F.floor(F.col("piece") * F.lit(ranges).cast("long") / n).cast("int"))
    ends = [f(y).alias(f"{name}_{y}") for y in dict.fromkeys(y for _, _, y in predicates) for name, f in (("least", F.min), ("most", F.max))]
    # The end of b's values that the most left values match.
    best = {(op, y): ("most_" if op[0] == "<" else "least_") + y for _, op, y in predicates}
    # One row: the ends of each range, in order.
    table = placed.groupBy("range").agg(*ends).agg(F.array_sort(F.collect_list(F.struct("range", *best.values()))).alias("ends")).select(F.struct(*[F.col("ends")[name].alias(name) for name in best.values()]))

    def reach(known: Column) -> Column:
        met = lambda x, op, y, i: _COMPARE[op](F.col(x), F.get(known[best[op, y]], i))
        first = [_leading(ranges, lambda i, x=x, op=op: ~met(x, op, by, i)) for x, op, y in predicates if y == by and op[0] == "<"]
        last = [_leading(ranges, lambda i, x=x, op=op: met(x, op, by, i)) - 1 for x, op, y in predicates if y == by and op[0] == ">"]
        span = F.struct(F.greatest(F.lit(0), F.lit(0), *first).alias("first"), F.least(F.lit(ranges - 1), F.lit(ranges - 1), *last).alias("last"))
        found = _let(span, lambda s: F.when(s["first"] <= s["last"], F.sequence(s["first"], s["last"])))
        for x, op, y in other:
            found = F.filter(found, lambda i: met(x, op, y, i))  # noqa: B023
        return found

    pieces = placed.groupBy("range", "piece").agg(F.collect_list(F.struct(*columns)).alias("rows"), *ends)
    # Spark's estimate of a's size is from before its rows go to their ranges: it isn't to choose the join.
    pieces = F.broadcast(pieces) if small else pieces.hint("merge")
    # Places and output take long where a is small: few files would be as few tasks.
    a = a.repartition(min(max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS[0]), BUCKETS[1]))
    # Spark puts the subquery in the column's place, as it is used once, so no row carries the ends.
    a = a.withColumn("known", table.scalar()).select(*a.columns, _let(F.col("known"), reach).alias("reach"))
    # Of explode, Spark would make a filter that finds the places once more.
    joined = a.select("*", F.explode_outer("reach").alias("range")).drop("reach").join(pieces, "range")
    for x, op, y in predicates:
        joined = joined.where(_COMPARE[op](F.col(x), F.col(best[op, y])))
    return joined.select(*a.columns[:-1], F.inline("rows"))


def join_where(left: DataFrame, right: DataFrame, predicates: Sequence[tuple[str, str, str]], suffix: str = "_right") -> DataFrame:
    """Rows of both sides for which all of (left column, operator, right column) hold, operators
    being < <= > >=. All columns of both sides stay. Sides of a name are swapped if only that
    fits. Nulls never match.

    With a small side, it is broadcast. Else the right rows are sorted by one column, one that has bounds on both
    sides if there is any, and cut into pieces by their places. The predicates of that column allow a left row
    the pieces between two places, found by a binary search; all rows of these match them but for the two pieces at
    the ends, so pairs are compared about as many as match. The other predicates leave pieces out by the least and
    greatest values there; with them, a left row goes to 256 ranges of pieces at most. Columns that
    aren't numbers, dates or timestamps have no pieces: then Spark compares all pairs."""
    if not predicates:
        raise ValueError("no predicates")
    plain = []
    for x, op, y in predicates:
        if op not in _SWAPPED:
            raise ValueError(f"unsupported operator: {op}")
        if x in left.columns and y in right.columns:
            plain.append((x, op, y))
        elif y in left.columns and x in right.columns:
            plain.append((y, _SWAPPED[op], x))
        else:
            raise ValueError(f"column not found: {x} or {y}")
    la = {c: f"l{i}" for i, c in enumerate(left.columns)}
    rb = {c: f"r{i}" for i, c in enumerate(right.columns)}
    a, b = _tagged(left, "l"), _tagged(right, "r")
    condition = None
    for x, op, y in plain:
        holds = _COMPARE[op](F.col(la[x]), F.col(rb[y]))
        condition = holds if condition is None else condition & holds
    if _few(right):
        joined = a.join(F.broadcast(b), condition)
    elif _few(left):
        joined = F.broadcast(a).join(b, condition)
    else:
        orderly = [y for _, _, y in plain if isinstance(right.schema[y].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
        bounded = [y for y in orderly if len({op[0] for _, op, d in plain if d == y}) == 2]
        if orderly:
            joined = _by_pieces(a, b, [(la[x], op, rb[y]) for x, op, y in plain], rb[(bounded or orderly)[0]]).where(condition)
        else:
            joined = a.join(b, condition)
    out = [F.col(la[c]).alias(c) for c in left.columns]
    out += [F.col(rb[c]).alias(c + suffix if c in left.columns else c) for c in right.columns]
    return joined.select(*out)


def asof_join(
    left: DataFrame, right: DataFrame, on: str | None = None, by: Sequence[str] = (), left_on: str | None = None, right_on: str | None = None, left_by: Sequence[str] | None = None, right_by: Sequence[str] | None = None,
    direction: str = "backward", tolerance: float | None = None, allow_exact: bool = True, suffix: str = "_y", right_order: Sequence[str] = (),
) -> DataFrame:
    """Each left row with the nearest right row at or before its key (backward), at or after it
    (forward), or the nearer of both (nearest, at a tie the earlier). Numeric or timestamp keys.
    Tolerance is the largest distance, of timestamps in seconds. Left columns, then right
    columns but keys, the suffix where names clash. Null keys match nothing. Of right rows with
    one key the last along right_order counts.

    Both sides are put into one table and sorted by key within `by`; a window carries the last
    right row. Without `by` the key's range is cut at quantiles, and what a range's rows miss
    is carried over from the ranges before or after, one row each."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction is backward, forward or nearest")
    lo, ro = left_on or on, right_on or on
    lb, rb = list(left_by or by), list(right_by or by)
    check_columns(left, [lo, *lb])
    check_columns(right, [ro, *rb])
    carried = [c for c in right.columns if c != ro and c not in rb]
    kind = dict(left.dtypes)[lo]
    span = (lambda a, b: (_micros(a) - _micros(b)) / 1e6) if kind.startswith("timestamp") else (lambda a, b: a - b)
    rank = F.struct(*right_order).alias("turn") if right_order else F.lit(0).alias("turn")
    l = left.select(F.col(lo).alias("k"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(lb)], F.struct("*").alias("row"))  # noqa: E741
    r = right.where(F.col(ro).isNotNull()).select(F.col(ro).alias("k"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(rb)], F.struct(F.col(ro).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).alias("right"), rank)
    for i in range(len(rb)):
        r = r.where(F.col(f"b{i}").isNotNull())
    keys = [f"b{i}" for i in range(len(lb))]
    bounds: list = []
    hot = None
    if keys:
        often = l.select(*keys).unionByName(r.select(*keys)).groupBy(*keys).count().where(F.col("count") > HOT_ROWS).select(*keys)
        hot = None if often.isEmpty() else materialise(often, "asof-frequent")
    if hot is not None:
        bounds = _bounds(r.select(_number("k", kind).alias("k")), "k")
        flag = F.broadcast(hot.withColumn("hot", F.lit(True)))  # all rows / HOT_ROWS at most
        cut = F.when(F.col("hot"), F.coalesce(_bucket(_number("k", kind), bounds), F.lit(0))).otherwise(F.lit(0))
        l, r = (side.join(flag, keys, "left").withColumn("bucket", cut) for side in (l, r))
        keys = [*keys, "bucket"]
    elif not keys:
        bounds = _bounds(r.select(_number("k", kind).alias("k")), "k")
        l = l.withColumn("bucket", F.coalesce(_bucket(_number("k", kind), bounds), F.lit(0)))  # noqa: E741
        r = r.withColumn("bucket", _bucket(_number("k", kind), bounds))
        keys = ["bucket"]
    both = l.drop("hot").unionByName(r.drop("hot"), allowMissingColumns=True)
    # Exact matches count if the right row comes first in the sense of the scan.
    left_last = F.col("row").isNotNull().cast("int") if allow_exact else -F.col("row").isNotNull().cast("int")
    back = Window.partitionBy(*keys).orderBy(F.col("k").asc(), left_last, "turn").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("k").desc(), left_last, F.col("turn").asc()).rowsBetween(Window.unboundedPreceding, 0)
    ways = [w for w in (("before", back), ("after", ahead)) if direction == "nearest" or w[0] == ("before" if direction == "backward" else "after")]
    found = both.withColumns({name: F.last("right", ignorenulls=True).over(w) for name, w in ways}).where(F.col("row").isNotNull())
    if keys and keys[-1] == "bucket" and bounds:
        series = keys[:-1]
        ends = (r.where("hot") if series else r).groupBy(*keys).agg(F.max_by("right", F.struct("k", "turn")).alias("last"), F.max_by("right", F.struct(-_number("k", kind), "turn")).alias("first"))
        every = left.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"))
        if series:
            every = hot.crossJoin(F.broadcast(every))  # a row for each range of a frequent key
        every = every.join(F.broadcast(ends), keys, "left")
        up = Window.partitionBy(*series).orderBy("bucket")
        ends = every.select(*keys, F.last("last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("last"), F.first("first", ignorenulls=True).over(up.rowsBetween(1, Window.unboundedFollowing)).alias("first"))
        found = found.join(F.broadcast(ends), keys, "left")  # a row for each range
        for name, _ in ways:
            found = found.withColumn(name, F.coalesce(name, "last" if name == "before" else "first"))
    for name, _ in ways:
        near = F.col("k").isNotNull() & F.col(f"{name}.at").isNotNull()
        if tolerance is not None:
            near = near & (F.abs(span(F.col("k"), F.col(f"{name}.at"))) <= tolerance)
        found = found.withColumn(name, F.when(near, F.col(name)))
    if direction == "nearest":
        d_before, d_after = span(F.col("k"), F.col("before.at")), span(F.col("after.at"), F.col("k"))
        hit = F.when(F.col("after").isNull() | (d_before <= d_after), F.col("before")).otherwise(F.col("after"))
    else:
        hit = F.col(ways[0][0])
    found = found.select("row", hit.alias("hit"))
    out = [F.col(f"row.`{c}`").alias(c) for c in left.columns]
    out += [F.col(f"hit.c{i}").alias(c + suffix if c in left.columns else c) for i, c in enumerate(carried)]
    return found.select(*out)


def _micros(c: Column) -> Column:
    """Of timestamps with or without a zone."""
    return F.unix_micros(c.cast("timestamp"))


def _number(c: str, kind: str) -> Column:
    return _micros(F.col(c)) if kind.startswith("timestamp") else F.col(c)


def check_sorted(df: DataFrame, column: str, order_by: Sequence[str]) -> None:
    """ValueError unless a column doesn't fall along the order. Ranges of the order are looked at one by one, and
    then their ends."""
    at = indexed(df.select(*dict.fromkeys([*order_by, column])), order_by).withColumn("__v", F.col(column))
    lag = F.lag("__v").over(Window.partitionBy("__part").orderBy("__i"))
    ends = at.groupBy("__part").agg(F.min_by("__v", "__i").alias("__v"), F.max_by("__v", "__i").alias("__last"))
    before = F.lag("__last").over(Window.orderBy("__part"))  # a row for each range
    falls = at.select("__v", lag.alias("__p")).unionByName(ends.select("__v", before.alias("__p"))).where("__v < __p")
    if not falls.isEmpty():
        raise ValueError(f"{column} must be sorted")


def rolling_join(
    left: DataFrame, right: DataFrame, on: str, window: float, by: Sequence[str] = (), direction: str = "backward", closed: str = "right", center: bool = False, min_periods: int = 1, suffix: str = "_right",
) -> DataFrame:
    """Each left row with every right row in a window about its key: [t - w, t] backward, [t, t + w]
    forward, [t - w, t + w] both; with center [t - w/2, t + w/2]. closed: left, right, both or
    neither bound belongs to the window. With fewer than min_periods rows, or none, there is one
    row without right values. Timestamps are measured in seconds.

    Keys are cut into cells as wide as the window; a left row meets the two or three cells that
    its window touches, so the join is on equality of cells."""
    if direction not in ("backward", "forward", "both"):
        raise ValueError("direction is backward, forward or both")
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError("closed is left, right, both or neither")
    if window <= 0 or min_periods < 0:
        raise ValueError("window must be positive")
    check_columns(left, [on, *by])
    check_columns(right, [on, *by])
    before, after = (window / 2, window / 2) if center else {"backward": (window, 0), "forward": (0, window), "both": (window, window)}[direction]
    kind = dict(left.dtypes)[on]
    t = (lambda c: _micros(F.col(c)) / 1e6) if kind.startswith("timestamp") else (lambda c: F.col(c).cast("double"))
    width = float(before + after)
    carried = [c for c in right.columns if c not in by]
    l = left.select(F.struct("*").alias("row"), t(on).alias("lt"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(by)]).withColumn("uid", F.monotonically_increasing_id())  # noqa: E741
    low, high = F.floor((F.col("lt") - before) / width), F.floor((F.col("lt") + after) / width)
    probes = l.select("*", F.explode_outer(F.sequence(low, high)).alias("cell"))
    r = right.select(t(on).alias("rt"), F.floor(t(on) / width).alias("rcell"), *[F.col(c).alias(f"rb{i}") for i, c in enumerate(by)], F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).alias("hit"))
    condition = F.col("cell") == F.col("rcell")
    for i in range(len(by)):
        condition = condition & (F.col(f"b{i}") == F.col(f"rb{i}"))
    start, end = F.col("lt") - before, F.col("lt") + after
    condition = condition & ((F.col("rt") >= start) if closed in ("left", "both") else (F.col("rt") > start))
    condition = condition & ((F.col("rt") <= end) if closed in ("right", "both") else (F.col("rt") < end))
    # An outer join keeps the left row; of its cells without a match one row is kept if all are empty.
    met = probes.join(r, condition, "left")
    per_row = Window.partitionBy("uid")
    met = met.select("row", "hit", F.count("hit").over(per_row).alias("n"), F.row_number().over(per_row.orderBy(F.col("hit").isNull(), "cell")).alias("nth"))
    enough = F.col("n") >= max(1, min_periods)
    kept = met.where((enough & F.col("hit").isNotNull()) | (~enough & (F.col("nth") == 1)))
    kept = kept.withColumn("hit", F.when(enough, F.col("hit")))
    out = [F.col(f"row.`{c}`").alias(c) for c in left.columns]
    out += [F.col(f"hit.c{i}").alias(c + suffix if c in left.columns else c) for i, c in enumerate(carried)]
    return kept.select(*out)
