"""Projection, filter, sorting and access by position.

A DataFrame has no row order of its own, so whatever depends on positions takes order_by,
columns whose order is total. Positions are numbered by a range partition along that order,
not by a window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.storage import materialise
from sparkloom.types import ColType, columns_of_type


def check_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column not found: {', '.join(missing)}")


def orders(by: Sequence[str], descending: bool | Sequence[bool] = False, nulls_first: bool = False) -> list[Column]:
    """Sort columns, nulls last unless told otherwise; missing directions are ascending."""
    flags = [descending] * len(by) if isinstance(descending, bool) else [*descending, *[False] * len(by)][: len(by)]
    out = []
    for name, down in zip(by, flags, strict=True):
        c = F.col(name)
        out.append((c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()))
    return out


def select(df: DataFrame, *columns: str | Column | ColType) -> DataFrame:
    """Names, "*", expressions, and `col_type` for all columns of a type in the schema's order."""
    check_columns(df, [c for c in columns if isinstance(c, str) and c != "*"])
    out: list[str | Column] = []
    for c in columns:
        out += [F.col(f"`{n}`") for n in columns_of_type(df.schema, c.kind)] if isinstance(c, ColType) else [c]
    return df.select(*out)


def drop(df: DataFrame, *columns: str) -> DataFrame:
    check_columns(df, columns)
    return df.drop(*columns)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    check_columns(df, [old])
    if new in df.columns and new != old:
        raise ValueError(f"column exists: {new}")
    return df.withColumnRenamed(old, new)


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; null is not."""
    return df.filter(condition)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def _names_in(c: Column) -> set[str]:
    """Names of the columns that an expression refers to, from its tree: literals, function names and
    lambda variables are none."""
    found, todo = set(), [c._jc.node()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            parts = node.nameParts()
            names = [parts.apply(i) for i in range(parts.size())]
            found |= {names[0], ".".join(names)}
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns that may refer to one another, in the order of their dependencies; a cycle is a
    ValueError. A name that only refers to itself means the old column."""
    needs = {n: (_names_in(c) & set(new)) - {n} for n, c in new.items()}
    try:
        order = list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        raise ValueError(f"columns depend on one another in a circle: {e.args[1]}") from e
    while order:
        # Each pass adds all columns that depend on none of those left, in one projection.
        ready = [n for n in order if not needs[n] & set(order)]
        df = df.withColumns({n: new[n] for n in ready})
        order = [n for n in order if n not in ready]
    return df


def with_columns_ordered(df: DataFrame, new: Sequence[tuple[str, Column]]) -> DataFrame:
    for name, c in new:
        df = df.withColumn(name, c)
    return df


def sort(df: DataFrame, *by: str, descending: bool | Sequence[bool] = False, nulls_first: bool = False) -> DataFrame:
    if not by:
        raise ValueError("no sort columns")
    check_columns(df, by)
    return df.orderBy(*orders(by, descending, nulls_first))


def indexed(df: DataFrame, order_by: Sequence[str], descending: bool | Sequence[bool] = False) -> DataFrame:
    """df with __i, the row's 0-based position along an order, and __part, the number of its range of
    the order.

    Rows are sorted by a range partition; to a row's place in its partition the sizes of the earlier
    ones are added. The sorted rows are written first: splitters are sampled, so a second run of the
    sort could cut elsewhere."""
    check_columns(df, order_by)
    ranged = df.orderBy(*orders(order_by, descending)).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place"))
    ranged = materialise(ranged, "ordered")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("__part", "__first", before.alias("__before"))
    joined = ranged.join(F.broadcast(base), "__part")  # a row for each partition
    return joined.select(*df.columns, (F.col("__before") + F.col("__place") - F.col("__first")).alias("__i"), "__part")


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index", descending: bool | Sequence[bool] = False) -> DataFrame:
    """The row's 0-based position along an order."""
    return indexed(df, order_by, descending).withColumnRenamed("__i", name).drop("__part")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*orders(order_by)).limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last n rows along the order, in that order."""
    back = [F.col(c).desc_nulls_first() for c in order_by]
    return df.orderBy(*back).limit(n).orderBy(*orders(order_by))


def slice_rows(df: DataFrame, start: int, end: int, order_by: Sequence[str]) -> DataFrame:
    """Rows from start up to, not including, end."""
    if start < 0 or end < start:
        raise ValueError("bad range")
    return df.orderBy(*orders(order_by)).offset(start).limit(end - start)


def take(df: DataFrame, indices: Sequence[int], order_by: Sequence[str]) -> DataFrame:
    """Rows at positions, repeats allowed, in the order given; a position outside is an error."""
    n = df.count()
    if any(i < 0 or i >= n for i in indices):
        raise IndexError("index out of bounds")
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "__to long, __from long")
    rows = with_row_index(df, order_by, "__at").join(F.broadcast(wanted), F.col("__at") == F.col("__from"))
    return rows.orderBy("__to").select(*df.columns)


def get_row(df: DataFrame, i: int, order_by: Sequence[str]) -> dict:
    rows = slice_rows(df, i, i + 1, order_by).collect()
    if not rows:
        raise IndexError("index out of bounds")
    return rows[0].asDict()


def arg_sort(df: DataFrame, *by: str, order_by: Sequence[str], descending: bool | Sequence[bool] = False) -> DataFrame:
    """The permutation that sorts: `position` and the `index` of the row that comes there."""
    at = with_row_index(df, order_by, "index")
    flags = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    return with_row_index(at, [*by, "index"], "position", flags + [False]).select("position", "index")


def hstack(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """All columns of both, row by row along their orders; equal heights, different names."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"column exists: {', '.join(sorted(clash))}")
    if left.count() != right.count():
        raise ValueError("different heights")
    a, b = with_row_index(left, left_order, "__row"), with_row_index(right, right_order, "__row")
    return a.join(b, "__row").drop("__row")


def add_column(df: DataFrame, column: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """df with a column of its own (a series), row by row: the n-th of the series, in the order that it was made
    in, to the n-th row along order_by. Equal lengths, a new name."""
    if len(column.columns) != 1:
        raise ValueError("a series has one column")
    name = column.columns[0]
    if name in df.columns:
        raise ValueError(f"column exists: {name}")
    numbered = column.withColumn("__at", F.monotonically_increasing_id())
    return hstack(df, numbered, order_by, ["__at"]).drop("__at")


def column_at(df: DataFrame, i: int) -> DataFrame:
    """The i-th column as a series."""
    if not 0 <= i < len(df.columns):
        raise IndexError("index out of bounds")
    return df.select(F.col(f"`{df.columns[i]}`"))


def column(df: DataFrame, name: str) -> DataFrame:
    check_columns(df, [name])
    return df.select(F.col(f"`{name}`"))


def clone(df: DataFrame) -> DataFrame:
    """The same rows under a frame of its own."""
    return df.select("*")


def to_text(df: DataFrame, rows: int = 10, width: int = 20) -> str:
    """The shape and the first rows as a table of text; only these rows are fetched."""
    head = [[("null" if v is None else str(v))[:width] for v in r] for r in df.limit(rows).collect()]
    lines = [df.columns, *head]
    wide = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    return "\n".join([f"{df.count()} x {len(df.columns)}", *["  ".join(v.ljust(w) for v, w in zip(line, wide, strict=True)).rstrip() for line in lines]])


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def describe_schema(df: DataFrame) -> T.StructType:
    return df.schema
