"""Aggregates and group-by. Nulls are a group of their own; aggregates skip nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.rows import check_columns


def total(c: str) -> Column:
    return F.sum(c)


def mean(c: str) -> Column:
    return F.avg(c)


def minimum(c: str) -> Column:
    return F.min(c)


def maximum(c: str) -> Column:
    return F.max(c)


def count(c: str) -> Column:
    """Values that aren't null."""
    return F.count(c)


def std(c: str) -> Column:
    """Of the sample (n - 1); null for a single value."""
    return F.stddev_samp(c)


def var(c: str) -> Column:
    return F.var_samp(c)


def median(c: str) -> Column:
    """Exact; the mean of the middle two if their number is even."""
    return F.median(c)


def first(c: str, by: str) -> Column:
    """First value along `by` that isn't null; rows without a place in the order don't count."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by)))


def last(c: str, by: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by)))


def corr(a: str, b: str) -> Column:
    """Pearson's correlation of the rows in which both are there; null if one is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


class GroupBy:
    """Grouping by one or more columns that must exist."""

    def __init__(self, df: DataFrame, *keys: str):
        if not keys:
            raise ValueError("no group columns")
        check_columns(df, keys)
        self.df, self.keys = df, keys

    def _each(self, columns: Sequence[str], function, suffix: str) -> DataFrame:
        check_columns(self.df, columns)
        kinds = dict(self.df.dtypes)
        out = []
        for c in columns:
            value = function(c)
            # Sums and extrema keep the column's type.
            out.append((value if suffix == "mean" else value.cast(kinds[c])).alias(f"{c}_{suffix}"))
        return self.df.groupBy(*self.keys).agg(*out)

    def sum(self, *columns: str) -> DataFrame:
        return self._each(columns, F.sum, "sum")

    def mean(self, *columns: str) -> DataFrame:
        return self._each(columns, F.avg, "mean")

    def min(self, *columns: str) -> DataFrame:
        return self._each(columns, F.min, "min")

    def max(self, *columns: str) -> DataFrame:
        return self._each(columns, F.max, "max")

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("count"))

    def agg(self, named: dict[str, Column]) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in named.items()])


def group_by(df: DataFrame, *keys: str) -> GroupBy:
    return GroupBy(df, *keys)


def group_top_k(df: DataFrame, keys: Sequence[str], column: str, k: int, largest: bool = True, name: str | None = None) -> DataFrame:
    """keys and the list of the k largest (smallest) values that aren't null, in order.

    The rows of a group are cut to k by a rank before they are gathered; Spark pushes the limit
    below the exchange (WindowGroupLimit), so a task sends k rows a group at most."""
    from pyspark.sql import Window

    order = F.col(column).desc() if largest else F.col(column).asc()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    kept = df.where(F.col(column).isNotNull()).select(*keys, column).withColumn("__rank", rank).where(F.col("__rank") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(column), asc=not largest).alias(name or f"{column}_{'topk' if largest else 'bottomk'}"))


def reduce_columns(df: DataFrame, *columns: str) -> DataFrame:
    """One row: sum, mean, min, max, count, std, var and median of each column."""
    functions = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": F.median}
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in functions.items()])
