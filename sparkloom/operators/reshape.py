"""Pivot, melt, stack, unstack, transpose, explode and concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.rows import check_columns, with_row_index

_FUNCTIONS = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "median": F.median}


def pivot(df: DataFrame, index: str | Sequence[str], columns: str, values: str, agg: str = "first", fill: Any = None, names: Sequence[Any] | None = None) -> DataFrame:
    """A column for each value of `columns`. names: those values, if known; otherwise Spark looks for
    them first, up to spark.sql.pivotMaxValues. Missing combinations are null or `fill`."""
    index = [index] if isinstance(index, str) else list(index)
    if not index or not columns or not values:
        raise ValueError("index, columns and values are needed")
    check_columns(df, [*index, columns, values])
    if agg not in _FUNCTIONS:
        raise ValueError(f"unknown aggregate: {agg}")
    grouped = df.groupBy(*index).pivot(columns, list(names)) if names is not None else df.groupBy(*index).pivot(columns)
    out = grouped.agg(_FUNCTIONS[agg](values))
    return out.fillna(fill, subset=[c for c in out.columns if c not in index]) if fill is not None else out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """A row for each row and value column. Columns of different types become strings."""
    values = [c for c in df.columns if c not in ids] if values is None else list(values)
    if not values:
        raise ValueError("no value columns")
    check_columns(df, [*ids, *values])
    kinds = {dict(df.dtypes)[v] for v in values}
    if len(kinds) > 1:
        df = df.withColumns({v: F.col(v).cast("string") for v in values})
    return df.unpivot(list(ids), values, variable_name, value_name)


unpivot = melt


def stack(df: DataFrame, *columns: str) -> DataFrame:
    """melt with the columns level_1 and value."""
    return melt(df, [c for c in df.columns if c not in columns], columns, "level_1", "value")


def unstack(df: DataFrame, level: str, fill: Any = None, names: Sequence[Any] | None = None) -> DataFrame:
    """The last column's values by the values of `level`."""
    check_columns(df, [level])
    value = [c for c in df.columns if c != level][-1]
    return pivot(df, [c for c in df.columns if c not in (level, value)], level, value, "first", fill, names)


def transpose(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """index (the column's name), row_0, row_1 and so on, all strings. There is a column for each row,
    so this is for tables of few rows, up to spark.sql.pivotMaxValues."""
    at = with_row_index(df, order_by, "__row")
    n = at.count()
    texts = at.select("__row", *[F.col(c).cast("string").alias(c) for c in df.columns])
    long = texts.unpivot("__row", df.columns, "index", "__value")
    wide = long.groupBy("index").pivot("__row", list(range(n))).agg(F.first("__value"))
    place = F.array_position(F.array(*map(F.lit, df.columns)), F.col("index"))
    return wide.orderBy(place).select("index", *[F.col(str(i)).alias(f"row_{i}") for i in range(n)])


def explode(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """A row for each element; rows with a null or empty list go unless keep_empty."""
    check_columns(df, [column])
    return df.withColumn(column, (F.explode_outer if keep_empty else F.explode)(column))


def concat(frames: Sequence[DataFrame], join: str = "outer", sort: bool = False, verify_schema: bool = False) -> DataFrame:
    """Rows of all frames, duplicates kept. outer: all columns, null where one lacks them; inner: common ones."""
    if not frames:
        raise ValueError("no frames")
    if verify_schema:
        first = dict(frames[0].dtypes)
        for f in frames[1:]:
            bad = [c for c, t in f.dtypes if c in first and first[c] != t]
            if bad:
                raise ValueError(f"data type mismatch: {', '.join(bad)}")
    if join == "inner":
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*common) for f in frames]
    elif join != "outer":
        raise ValueError("join is outer or inner")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns)) if sort else out


def concat_columns(frames: Sequence[DataFrame], order_bys: Sequence[Sequence[str]]) -> DataFrame:
    """Frames side by side along their orders; equal heights. A name seen before gets _1, _2 and so on."""
    if not frames:
        raise ValueError("no frames")
    if len({f.count() for f in frames}) > 1:
        raise ValueError("different heights")
    seen: set[str] = set()
    parts = []
    for f, by in zip(frames, order_bys, strict=True):
        at = with_row_index(f, by, "__row")
        for c in f.columns:
            name, k = c, 0
            while name in seen:
                k += 1
                name = f"{c}_{k}"
            seen.add(name)
            at = at.withColumnRenamed(c, name) if name != c else at
        parts.append(at)
    return reduce(lambda a, b: a.join(b, "__row"), parts).orderBy("__row").drop("__row")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def lists_of(df: DataFrame, keys: Sequence[str], column: str, order: Column) -> DataFrame:
    """keys and the list of a column's values along an order."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(column).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["v"]).alias(column))
