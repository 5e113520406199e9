"""Missing data, duplicates, interpolation and cumulative operators.

Directional operators take order_by, a total order, and by, the columns of independent series.
Without by there is one series. It isn't brought to one task: it is cut into ranges of the order,
each range is scanned, and what a scan carries over from the ranges before (or after) comes from
a summary of one row for each range. If a series of by has more than HOT_ROWS rows, series and order
are cut likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.rows import check_columns, indexed, orders

#: Rows of a series from which on it is cut into ranges.
HOT_ROWS = 5_000_000


@dataclass(frozen=True)
class _Scan:
    """A running aggregate: of a window, of a whole range, and of what comes before with what is here."""

    running: Callable[[Column], Column]
    whole: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    back: bool = False


def _either(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


_LAST = _Scan(lambda v: F.last(v, ignorenulls=True), lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("__i"))), lambda a, b: F.coalesce(b, a))
_NEXT = _Scan(lambda v: F.first(v, ignorenulls=True), lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("__i"))), lambda a, b: F.coalesce(b, a), True)
_SUM = _Scan(F.sum, F.sum, _either(lambda a, b: a + b))
_COUNT = _Scan(F.count, F.count, _either(lambda a, b: a + b))
_PRODUCT = _Scan(F.product, F.product, _either(lambda a, b: a * b))
_MAX = _Scan(F.max, F.max, _either(F.greatest))
_MIN = _Scan(F.min, F.min, _either(F.least))


def _scan(df: DataFrame, order_by: Sequence[str], by: Sequence[str], make: Callable[[], dict[str, tuple[_Scan, Column]]]) -> DataFrame:
    """df with __i, the position in the series, and the scans that make() names, of values that may use __i."""
    check_columns(df, [*order_by, *by])
    if by and not df.groupBy(*by).count().where(F.col("count") > HOT_ROWS).isEmpty():
        return _scan_cut(df, order_by, by, make)
    if by:
        w = Window.partitionBy(*by).orderBy(*orders(order_by))
        at = df.withColumn("__i", F.row_number().over(w))
    else:
        at = indexed(df, order_by)
        w = Window.partitionBy("__part").orderBy("__i")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    scans = make()
    out = at.withColumns({n: s.running(v).over(after if s.back else before) for n, (s, v) in scans.items()})
    if by:
        return out
    totals = at.groupBy("__part").agg(*[s.whole(v).alias(n) for n, (s, v) in scans.items()])
    line = Window.orderBy("__part")
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    # Sums of counts, not counts of sums: a count is carried over as a sum.
    fold = lambda n, s: (_SUM if s is _COUNT else s).running(F.col(n)).over(later if s.back else earlier).alias(f"__c_{n}")
    carried = totals.select("__part", *[fold(n, s) for n, (s, _) in scans.items()])
    out = out.join(F.broadcast(carried), "__part")  # a row for each range
    return out.withColumns({n: s.combine(F.col(f"__c_{n}"), F.col(n)) for n, (s, _) in scans.items()})


def _scan_cut(df: DataFrame, order_by: Sequence[str], by: Sequence[str], make: Callable[[], dict[str, tuple[_Scan, Column]]]) -> DataFrame:
    """_scan of series that may be longer than a task should read. __i numbers the rows of all series, one after the other."""
    at = indexed(df, [*by, *order_by])
    w = Window.partitionBy(*by, "__part").orderBy("__i")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    scans = make()
    out = at.withColumns({n: s.running(v).over(after if s.back else before) for n, (s, v) in scans.items()})
    totals = at.groupBy(*by, "__part").agg(*[s.whole(v).alias(n) for n, (s, v) in scans.items()])
    # Only series that go on from one range to the next carry anything over: two rows for each range at most.
    totals = totals.withColumn("__in", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("__in") > 1)
    line = Window.partitionBy(*by).orderBy("__part")
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    fold = lambda n, s: (_SUM if s is _COUNT else s).running(F.col(n)).over(later if s.back else earlier).alias(f"__c_{n}")
    carried = totals.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], *[fold(n, s) for n, (s, _) in scans.items()])
    same = F.col("__part") == F.col("__of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    out = out.join(F.broadcast(carried), same, "left")
    return out.withColumns({n: F.when(F.col("__of").isNull(), F.col(n)).otherwise(s.combine(F.col(f"__c_{n}"), F.col(n))) for n, (s, _) in scans.items()})


def _here(c: str) -> Column:
    """Position and value where there is one."""
    return F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).alias("v")))


def drop_null(df: DataFrame, *subset: str) -> DataFrame:
    check_columns(df, subset)
    return df.dropna(how="any", subset=list(subset) or None)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """Of rows that agree in subset the first or last along order_by, or none of them."""
    subset = list(subset or df.columns)
    check_columns(df, subset)
    if keep == "none":
        return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*subset))).where("__n = 1").drop("__n")
    if keep not in ("first", "last"):
        raise ValueError("keep is first, last or none")
    if not order_by and set(subset) == set(df.columns):
        return df.dropDuplicates()
    by = orders(order_by or subset) if keep == "first" else [F.col(c).desc_nulls_first() for c in order_by or subset]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*subset).orderBy(*by))).where("__n = 1").drop("__n")


def fill_value(df: DataFrame, value: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """One value, or one by column; only columns of a fitting type are filled."""
    if isinstance(value, dict):
        check_columns(df, list(value))
        return df.fillna(value)
    return df.fillna(value, subset=list(columns) if columns else None)


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The last value before; of a run of nulls at most `limit` rows are filled. Leading nulls stay."""
    return _fill(df, columns, order_by, by, limit, _LAST)


def backward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    return _fill(df, columns, order_by, by, limit, _NEXT)


def _fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str], limit: int | None, scan: _Scan) -> DataFrame:
    at = _scan(df, order_by, by, lambda: {f"__f_{c}": (scan, _here(c)) for c in columns})
    near = lambda c: F.lit(True) if limit is None else F.abs(F.col("__i") - F.col(f"__f_{c}.i")) <= limit
    return at.withColumns({c: F.when(near(c), F.col(f"__f_{c}.v")) for c in columns}).select(*df.columns)


def fill_null(df: DataFrame, columns: Sequence[str] | None = None, value: Any = None, method: str | None = None, limit: int | None = None, order_by: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    if method in ("forward", "ffill"):
        return forward_fill(df, columns or df.columns, order_by, by, limit)
    if method in ("backward", "bfill"):
        return backward_fill(df, columns or df.columns, order_by, by, limit)
    if method is not None:
        raise ValueError(f"unknown method: {method}")
    return fill_value(df, value, columns)


def interpolate(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), method: str = "linear", limit: int | None = None, area: str = "inside") -> DataFrame:
    """Values between the neighbours that are there, by row position. Methods: linear (slinear,
    quadratic and cubic are the same), nearest (a tie takes the previous), zero (the previous).
    A run of more than `limit` nulls is left as it is. inside: only between two values; outside:
    only before the first and after the last, with their values; both. Integers are rounded."""
    if method not in ("linear", "slinear", "quadratic", "cubic", "nearest", "zero"):
        raise ValueError(f"unknown method: {method}")
    if area not in ("inside", "outside", "both"):
        raise ValueError("area is inside, outside or both")
    types = {f.name: f.dataType for f in df.schema.fields}
    names = df.columns
    at = _scan(df, order_by, by, lambda: {f"__p_{c}": (_LAST, _here(c)) for c in columns} | {f"__n_{c}": (_NEXT, _here(c)) for c in columns})
    new = {}
    for c in columns:
        if not isinstance(types[c], T.NumericType):
            raise ValueError(f"{c} isn't numeric")
        p, n, i = F.col(f"__p_{c}"), F.col(f"__n_{c}"), F.col("__i")
        inner = p.isNotNull() & n.isNotNull()
        if method == "nearest":
            value = F.when(i - p["i"] <= n["i"] - i, p["v"]).otherwise(n["v"])
        elif method == "zero":
            value = p["v"]
        else:
            value = p["v"].cast("double") + (n["v"].cast("double") - p["v"].cast("double")) * F.try_divide(i - p["i"], n["i"] - p["i"])
            if isinstance(types[c], T.IntegralType):
                value = F.round(value)
        value = value.cast(types[c])
        short = F.lit(True) if limit is None else (n["i"] - p["i"] - 1 <= limit)
        filled = F.when(F.col(c).isNotNull(), F.col(c))
        if area in ("inside", "both"):
            filled = filled.when(inner & short, value)
        if area in ("outside", "both"):
            filled = filled.when(p.isNull() != n.isNull(), F.coalesce(p["v"], n["v"]))
        new[c] = filled
    return at.withColumns(new).select(*names)


def _cumulative(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str], skip_nulls: bool, scan: _Scan, keep_type: bool = True) -> DataFrame:
    kinds = dict(df.dtypes)
    at = _scan(df, order_by, by, lambda: {f"__s_{c}": (scan, F.col(c)) for c in columns})
    new = {}
    for c in columns:
        value = F.col(f"__s_{c}").cast(kinds[c]) if keep_type else F.col(f"__s_{c}")
        new[c] = value if skip_nulls else F.when(F.col(c).isNotNull(), value)
    return at.withColumns(new).select(*df.columns)


def cum_sum(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), skip_nulls: bool = True) -> DataFrame:
    """Running sum. At a null: the sum so far, or null without skip_nulls; it goes on after either."""
    return _cumulative(df, columns, order_by, by, skip_nulls, _SUM)


def cum_prod(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), skip_nulls: bool = True) -> DataFrame:
    return _cumulative(df, columns, order_by, by, skip_nulls, _PRODUCT)


def cum_max(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), skip_nulls: bool = True) -> DataFrame:
    return _cumulative(df, columns, order_by, by, skip_nulls, _MAX)


def cum_min(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), skip_nulls: bool = True) -> DataFrame:
    return _cumulative(df, columns, order_by, by, skip_nulls, _MIN)


def cum_count(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values so far that aren't null, as bigint."""
    return _cumulative(df, columns, order_by, by, True, _COUNT, keep_type=False)


def null_mask(*columns: str) -> list[Column]:
    return [F.col(c).isNull().alias(c) for c in columns]
