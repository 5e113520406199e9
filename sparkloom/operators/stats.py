"""Descriptive statistics of columns. Nulls are ignored."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.agg import corr
from sparkloom.operators.joins import _bounds, _bucket
from sparkloom.operators.missing import cum_sum
from sparkloom.operators.rows import check_columns, indexed
from sparkloom.storage import materialise, small_side

QUANTILE_METHODS = ("linear", "lower", "higher", "midpoint", "nearest")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def quantile(df: DataFrame, quantiles: Sequence[float] = (0.5,), method: str = "linear", columns: Sequence[str] | None = None) -> DataFrame:
    """`quantile` and a column for each numeric column; exact. Spark's percentile keeps a count for each
    distinct value. nearest: a tie takes the lower."""
    if method not in QUANTILE_METHODS:
        raise ValueError(f"unknown method: {method}")
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles are from 0 to 1")
    columns = list(columns or numeric_columns(df))
    check_columns(df, columns)
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]
    if method == "linear":
        parts = df.agg(*[F.percentile(c, F.array(*map(F.lit, quantiles))).alias(f"v{i}") for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(float(q)).alias("quantile"), *[F.get(f"v{i}", F.lit(k)).alias(c) for i, c in enumerate(columns)]) for k, q in enumerate(quantiles)]
        return parts.select(F.inline(F.array(*rows)))
    # The values at the two ranks around a position are percentiles at exact ranks.
    ns = df.agg(*counts).first()
    wanted: list[list[tuple[float, float, float]]] = []
    for i in range(len(columns)):
        n = ns[i]
        own = []
        for q in quantiles:
            at = q * (n - 1) if n else 0.0
            low, high = int(at), min(int(at) + (at > int(at)), max(n - 1, 0))
            d = max(n - 1, 1)
            own.append((low / d, high / d, at - low))
        wanted.append(own)
    parts = df.agg(*[F.percentile(c, F.array(*[F.lit(x) for lo, hi, _ in wanted[i] for x in (lo, hi)])).alias(f"v{i}") for i, c in enumerate(columns)])

    def value(i: int, k: int) -> Column:
        lo, hi, share = F.get(f"v{i}", F.lit(2 * k)), F.get(f"v{i}", F.lit(2 * k + 1)), wanted[i][k][2]
        return {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": hi if share > 0.5 else lo}[method]

    rows = [F.struct(F.lit(float(q)).alias("quantile"), *[value(i, k).alias(c) for i, c in enumerate(columns)]) for k, q in enumerate(quantiles)]
    return parts.select(F.inline(F.array(*rows)))


def percentile(df: DataFrame, percents: Sequence[float], method: str = "linear", columns: Sequence[str] | None = None) -> DataFrame:
    return quantile(df, [p / 100 for p in percents], method, columns)


def _matrix(df: DataFrame, columns: Sequence[str], cell, diagonal, min_valid: int) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = {p: F.count(F.when(F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull(), 1)) for p in pairs}
    nan = F.lit(float("nan"))
    values = [F.when(both[p] >= min_valid, F.coalesce(diagonal(p[0]) if p[0] == p[1] else cell(*p), nan)).otherwise(nan).alias(f"c{i}") for i, p in enumerate(pairs)]
    one = df.agg(*values)
    at = {p: f"c{i}" for i, p in enumerate(pairs)}
    rows = [F.struct(F.lit(a).alias("column"), *[F.col(at.get((a, b)) or at[(b, a)]).alias(b) for b in columns]) for a in columns]
    return one.select(F.inline(F.array(*rows)))


def correlation(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", min_valid: int = 1) -> DataFrame:
    """Matrix: `column` and a column for each; pairs of rows in which both are there. NaN where one
    is constant or fewer than min_valid pairs are. spearman: of average ranks over the rows where all
    columns are there; kendall: tau-b of the same rows, from counts of the distinct value pairs."""
    columns = list(columns or numeric_columns(df))
    check_columns(df, columns)
    if method == "kendall":
        return _kendall(df.dropna(subset=columns), columns, min_valid)
    if method == "spearman":
        df = rank(df.dropna(subset=columns).select(*columns), columns)
    elif method != "pearson":
        raise ValueError(f"unknown method: {method}")
    spread = lambda c: F.when(F.max(F.col(c).cast("double")) > F.min(F.col(c).cast("double")), F.lit(1.0))
    return _matrix(df, columns, corr, spread, min_valid)


def _concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum of the sign of y's difference times both numbers, over pairs whose x rises: halves are counted against
    one another by binary search, small stretches pair by pair."""
    by = np.argsort(x, kind="stable")
    x, y, n = x[by], y[by], n[by].astype(np.float64)
    total, todo = 0.0, [(0, len(x))]
    while todo:
        i, j = todo.pop()
        if j - i < 2 or x[i] == x[j - 1]:
            continue
        if j - i <= 128:
            rises = x[i:j, None] < x[None, i:j]
            sign = (y[i:j, None] < y[None, i:j]).astype(np.int8) - (y[i:j, None] > y[None, i:j])
            total += float((rises * sign * n[i:j, None] * n[None, i:j]).sum())
            continue
        middle = x[(i + j) // 2]
        cut = i + int(np.searchsorted(x[i:j], middle, "left"))
        if cut == i:
            cut = i + int(np.searchsorted(x[i:j], middle, "right"))
        low = np.argsort(y[i:cut], kind="stable")
        sorted_y, sums = y[i:cut][low], np.concatenate([[0.0], np.cumsum(n[i:cut][low])])
        less = sums[np.searchsorted(sorted_y, y[cut:j], "left")]
        more = sums[-1] - sums[np.searchsorted(sorted_y, y[cut:j], "right")]
        total += float((n[cut:j] * (less - more)).sum())
        todo += [(i, cut), (cut, j)]
    return total


def _sum_of_signs(t: DataFrame) -> float:
    """_concordance of a table of distinct x, y with numbers n, at any size. Both columns are cut into ranges. Pairs in
    one range of x are counted there, other pairs in one range of y there, and pairs of different ranges from
    the numbers in the cells."""
    plain = lambda c: F.col(c).cast("long" if isinstance(t.schema[c].dataType, T.IntegralType) else "double")
    t = t.select(plain("x").alias("x"), plain("y").alias("y"), "n")
    cells = materialise(t.select("*", _bucket(F.col("x"), _bounds(t, "x")).alias("bx"), _bucket(F.col("y"), _bounds(t, "y")).alias("by")), "kendall-cells")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_concordance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy())]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_concordance(pdf["bx"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy())]})

    parts = cells.groupBy("bx").applyInPandas(inside, "s double").unionByName(cells.groupBy("by").applyInPandas(across, "s double"))
    grid = cells.groupBy("bx", "by").agg(F.sum("n").alias("n")).toPandas()  # a row for each pair of ranges
    return (parts.agg(F.sum("s")).first()[0] or 0.0) + _concordance(grid["bx"].to_numpy(), grid["by"].to_numpy(), grid["n"].to_numpy())


def _kendall(df: DataFrame, columns: Sequence[str], min_valid: int) -> DataFrame:
    """From the table of distinct value pairs with their numbers."""
    found: dict[tuple[str, str], float] = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            t = materialise(df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n")), "kendall-pairs")
            ties = lambda c: t.groupBy(c).agg(F.sum("n").cast("double").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0.0  # noqa: E731, B023
            every = t.agg(F.sum("n")).first()[0] or 0
            pairs = every * (every - 1) / 2
            room = (pairs - ties("x")) * (pairs - ties("y"))
            if every >= min_valid and room > 0:
                found[a, b] = found[b, a] = _sum_of_signs(t) / room**0.5
    rows = [(a, *[1.0 if a == b else found.get((a, b), float("nan")) for b in columns]) for a in columns]
    return df.sparkSession.createDataFrame(rows, ["column", *columns])


def covariance(df: DataFrame, columns: Sequence[str] | None = None, min_valid: int = 1) -> DataFrame:
    """Of the sample (n - 1)."""
    columns = list(columns or numeric_columns(df))
    check_columns(df, columns)
    return _matrix(df, columns, F.covar_samp, F.var_samp, min_valid)


def skew(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected, one row; NaN for fewer than 3 values."""
    return df.agg(*[skewness(c).alias(c) for c in columns or numeric_columns(df)])


def kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected excess, one row; NaN for fewer than 4 values."""
    return df.agg(*[excess_kurtosis(c).alias(c) for c in columns or numeric_columns(df)])


def skewness(c: str) -> Column:
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).otherwise(F.lit(float("nan")))


def excess_kurtosis(c: str) -> Column:
    n = F.count(c)
    fixed = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
    return F.when(n >= 4, fixed).otherwise(F.lit(float("nan")))


def mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most frequent value of each column; of equally frequent ones the least."""
    return df.agg(*[F.mode(c, True).alias(c) for c in columns or df.columns])


def value_counts(df: DataFrame, columns: Sequence[str], normalize: bool = False, sort: bool = True, ascending: bool = False, drop_null: bool = True) -> DataFrame:
    """columns and `count`, a double, or the share of all."""
    check_columns(df, columns)
    df = df.dropna(subset=list(columns)) if drop_null else df
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("count"))
    if normalize:
        total = df.agg(F.count(F.lit(1)).cast("double").alias("__total"))
        counts = counts.join(F.broadcast(total)).withColumn("count", F.col("count") / F.col("__total")).drop("__total")  # one row
    if not sort:
        return counts
    return counts.orderBy(F.col("count").asc() if ascending else F.col("count").desc(), *[F.col(c).asc_nulls_last() for c in columns])


def n_unique(df: DataFrame, columns: Sequence[str] | None = None, drop_null: bool = True, approximate: bool = False) -> DataFrame:
    """Distinct values of each column, one row; null counts as one unless drop_null."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    extra = lambda c: F.lit(0) if drop_null else F.max(F.col(c).isNull().cast("int"))
    return df.agg(*[(count(c) + F.coalesce(extra(c), F.lit(0))).cast("bigint").alias(c) for c in columns or df.columns])


def rank(df: DataFrame, columns: Sequence[str], method: str = "average", ascending: bool = True, nulls: str = "keep", pct: bool = False, by: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """Ranks as doubles in place of the values: average, min, max, dense or ordinal (along order_by).
    nulls: keep (null), top (ranked first) or bottom (ranked last). pct: rank by number of ranked rows."""
    if method not in ("average", "min", "max", "dense", "ordinal"):
        raise ValueError(f"unknown method: {method}")
    if nulls not in ("keep", "top", "bottom"):
        raise ValueError("nulls is keep, top or bottom")
    check_columns(df, [*columns, *by])
    if not by:
        for c in columns:
            df = _rank_all(df, c, method, ascending, nulls, pct, order_by)
        return df
    new = {}
    for c in columns:
        missing = F.col(c).isNull()
        place = -missing.cast("int") if nulls == "top" else missing.cast("int")
        value = F.col(c).asc() if ascending else F.col(c).desc()
        w = Window.partitionBy(*by).orderBy(place, value)
        peers = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
        least = F.rank().over(w)
        r = {
            "min": least, "max": least + peers - 1, "average": least + (peers - 1) / 2, "dense": F.dense_rank().over(w),
            "ordinal": F.row_number().over(Window.partitionBy(*by).orderBy(place, value, *order_by)),
        }[method].cast("double")
        if pct:
            whole = Window.partitionBy(*by)
            r = r / (F.count(c).over(whole) if nulls == "keep" else F.count(F.lit(1)).over(whole))
        new[c] = F.when(~missing, r) if nulls == "keep" else r
    return df.withColumns(new)


def _rank_all(df: DataFrame, c: str, method: str, ascending: bool, nulls: str, pct: bool, order_by: Sequence[str]) -> DataFrame:
    """Ranks over the whole table, without bringing it to one task: running sums of the distinct values'
    counts along a range partition, joined back by value."""
    n, missing, distinct = df.agg(F.count(c), F.count(F.lit(1)) - F.count(c), F.count_distinct(c)).first()
    if method == "ordinal":
        flag = {"top": -1, "bottom": 1, "keep": 1}[nulls]
        at = indexed(df.withColumn("__null", F.col(c).isNull().cast("int") * flag), ["__null", c, *order_by], [False, not ascending])
        out, r = at, F.col("__i") + 1.0
    else:
        values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
        values = indexed(cum_sum(values.withColumn("__s", F.col("__m")), ["__s"], ["__v"]), ["__v"])
        least = F.col("__s") - F.col("__m") + 1 if ascending else F.lit(n) - F.col("__s") + 1
        place = F.col("__i") + 1 if ascending else F.lit(distinct) - F.col("__i")
        before = (missing if method != "dense" else min(missing, 1)) if nulls == "top" else 0
        by_method = {"min": least, "max": least + F.col("__m") - 1, "average": least + (F.col("__m") - 1) / 2, "dense": place}
        ranked = values.select("__v", (by_method[method] + before).cast("double").alias("__r"))
        out = df.join(small_side(ranked, 100_000), df[c] == F.col("__v"), "left")
        start = 0 if nulls == "top" else distinct if method == "dense" else n
        of_null = {"min": start + 1, "max": start + missing, "average": start + (missing + 1) / 2, "dense": start + 1}[method]
        r = F.coalesce("__r", F.lit(float(of_null)))
    if pct:
        r = r / F.lit(float(n if nulls == "keep" else n + missing) or 1.0)
    return out.withColumn(c, F.when(F.col(c).isNotNull(), r) if nulls == "keep" else r).select(*df.columns)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(columns or numeric_columns(df))).summary()
