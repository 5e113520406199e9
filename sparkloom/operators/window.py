"""Window functions over a specification with ROWS, RANGE or GROUPS frames.

    over(df, "r", rank(), Spec().partition_by("k").order_by("v"))

Ranks and row numbers are bigint. first_value and last_value see the whole partition. A GROUPS
frame is a RANGE frame over the dense rank, which is added to the rows first.

Without partition_by a table of more than ONE_TASK rows isn't brought to one task, but cut into ranges of the order
(`_over_ranges`); RANGE and GROUPS frames of offsets, half-open ROWS frames that don't end at the row, and `of` are not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparkloom.operators.rows import indexed

UNBOUNDED = None
#: Rows of a table without partition_by up to which one task numbers them.
ONE_TASK = 5_000_000
#: Rows of a block for frames of a limited reach.
BLOCK = 1_000_000


@dataclass(frozen=True)
class Spec:
    partitions: tuple[Any, ...] = ()
    ordering: tuple[tuple[Any, bool], ...] = ()  # column and ascending; made into Spark's only when used
    frame: tuple[str, Any, Any] | None = None

    def partition_by(self, *columns: Any) -> Spec:
        return replace(self, partitions=self.partitions + columns)

    def order_by(self, column: Any, ascending: bool = True) -> Spec:
        return replace(self, ordering=(*self.ordering, (column, ascending)))

    def rows_between(self, start: int | None, end: int | None) -> Spec:
        """Negative is before the row, 0 the row, None unbounded."""
        return replace(self, frame=("rows", start, end))

    def range_between(self, start: float | None, end: float | None) -> Spec:
        """Offsets of the first order column's value; peers belong to the frame."""
        return replace(self, frame=("range", start, end))

    def groups_between(self, start: int | None, end: int | None) -> Spec:
        """Whole groups of peers before and after the row's own."""
        return replace(self, frame=("groups", start, end))

    def unbounded_preceding(self) -> Spec:
        """From the partition's start to the current row."""
        return replace(self, frame=("rows", None, 0))

    def unbounded_following(self) -> Spec:
        start = self.frame[1] if self.frame else 0
        return replace(self, frame=("rows", start, None))

    def current_row(self) -> Spec:
        start = self.frame[1] if self.frame else 0
        return replace(self, frame=("rows", start, 0))

    def ordered(self) -> WindowSpec:
        by = [(F.col(c) if isinstance(c, str) else c, up) for c, up in self.ordering]
        return Window.partitionBy(*self.partitions).orderBy(*[c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in by])

    def whole(self) -> WindowSpec:
        w = self.ordered() if self.ordering else Window.partitionBy(*self.partitions)
        return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def framed(self) -> WindowSpec:
        """Explicit frame, or up to the row and its peers if ordered, else the whole partition."""
        w = self.ordered() if self.ordering else Window.partitionBy(*self.partitions)
        if not self.frame:
            return w
        kind, start, end = self.frame
        low = Window.unboundedPreceding if start is None else start
        high = Window.unboundedFollowing if end is None else end
        return w.rowsBetween(low, high) if kind == "rows" else w.rangeBetween(low, high)


@dataclass(frozen=True)
class Function:
    """A function and how it gets its window."""

    make: Any
    needs_order: bool = False
    frame: str = "framed"
    cast: str | None = None
    columns: tuple[str, ...] = ()
    kind: str = ""
    k: int = 0

    def over(self, spec: Spec) -> Column:
        """The expression, for use in a projection. A GROUPS frame needs a column that is added first: it has `over`,
        the function."""
        if spec.frame and spec.frame[0] == "groups" and self.frame != "ordered":
            raise ValueError("GROUPS frames: use over(df, name, function, spec)")
        return self.within(spec, spec)

    def within(self, spec: Spec, framed: Spec) -> Column:
        if self.needs_order and not spec.ordering:
            raise ValueError("ORDER BY is required")
        how = self.frame if self.frame != "whole unless framed" else "framed" if spec.frame else "whole"
        if how == "ordered":
            w = spec.ordered() if spec.ordering else Window.partitionBy(*spec.partitions).orderBy(F.lit(1))
        else:
            w = spec.whole() if how == "whole" else framed.framed()
        value = self.make().over(w)
        return value.cast(self.cast) if self.cast else value


def row_number() -> Function:
    return Function(F.row_number, frame="ordered", cast="bigint", kind="row_number")


def rank() -> Function:
    return Function(F.rank, True, "ordered", "bigint", kind="rank")


def dense_rank() -> Function:
    return Function(F.dense_rank, True, "ordered", "bigint", kind="dense_rank")


def percent_rank() -> Function:
    return Function(F.percent_rank, True, "ordered", kind="percent_rank")


def ntile(n: int) -> Function:
    if n <= 0:
        raise ValueError("ntile needs a positive number")
    return Function(lambda: F.ntile(n), frame="ordered", cast="bigint", kind="ntile", k=n)


def lag(column: str, k: int = 1, default: Any = None) -> Function:
    return Function(lambda: F.lag(column, k, default), frame="ordered", columns=(column,), kind="shift", k=-k)


def lead(column: str, k: int = 1, default: Any = None) -> Function:
    return Function(lambda: F.lead(column, k, default), frame="ordered", columns=(column,), kind="shift", k=k)


def first_value(column: str) -> Function:
    return Function(lambda: F.first(column), frame="whole", columns=(column,), kind="first")


def last_value(column: str) -> Function:
    return Function(lambda: F.last(column), frame="whole", columns=(column,), kind="last")


def nth_value(column: str, n: int) -> Function:
    """1-based; without a frame in the whole partition. Nulls count as values."""
    if n <= 0:
        raise ValueError("nth_value counts from 1")
    return Function(lambda: F.nth_value(column, n), frame="whole unless framed", columns=(column,), kind="nth", k=n)


def sum_(column: str) -> Function:
    return Function(lambda: F.sum(column), columns=(column,), kind="sum")


def avg(column: str) -> Function:
    return Function(lambda: F.avg(column), columns=(column,), kind="avg")


def min_(column: str) -> Function:
    return Function(lambda: F.min(column), columns=(column,), kind="min")


def max_(column: str) -> Function:
    return Function(lambda: F.max(column), columns=(column,), kind="max")


def count(column: str) -> Function:
    """Values that aren't null."""
    return Function(lambda: F.count(column), columns=(column,), kind="count")


def count_rows() -> Function:
    return Function(lambda: F.count(F.lit(1)), kind="rows")


def of(expression: Column) -> Function:
    """Any aggregate expression."""
    return Function(lambda: expression)


def over(df: DataFrame, name: str, function: Function, spec: Spec) -> DataFrame:
    return over_all(df, {name: function}, spec)


def over_all(df: DataFrame, functions: dict[str, Function], spec: Spec) -> DataFrame:
    """df with a column for each function; those of one specification share its sort."""
    for f in functions.values():
        missing = [c for c in f.columns if c not in df.columns]
        if missing:
            raise ValueError(f"column not found: {missing[0]}")
        if f.needs_order and not spec.ordering:
            raise ValueError("ORDER BY is required")
    if not spec.partitions and spec.ordering and all(_way(f, spec) for f in functions.values()) and df.count() > ONE_TASK:
        return _over_ranges(df, functions, spec)
    columns = df.columns
    framed = spec
    if spec.frame and spec.frame[0] == "groups":
        if not spec.ordering:
            framed = replace(spec, frame=("rows", None, None))
        else:
            df = df.withColumn("__group", F.dense_rank().over(spec.ordered()))
            framed = Spec(spec.partitions, (("__group", True),), ("range", spec.frame[1], spec.frame[2]))
    new = {name: f.within(spec, framed) for name, f in functions.items()}
    return df.withColumns(new).select(*columns, *[n for n in new if n not in columns])


def _way(f: Function, spec: Spec) -> str:
    """How a function without partition_by is computed from ranges of the order: by the row's position, from what a range
    carries over to the next, from all ranges, or in blocks; "" if it can't be."""
    if f.kind in ("row_number", "rank", "dense_rank", "percent_rank", "ntile"):
        return "position"
    if f.kind == "shift":
        return "block"
    if f.kind in ("first", "last"):
        return "whole"
    kind, start, end = spec.frame or ("range", None, 0)
    if not f.kind or (f.kind == "nth" and spec.frame is None):
        return "whole" if f.kind else ""
    if start is None and end is None:
        return "whole"
    if kind == "rows" and start is not None and end is not None:
        return "block"
    if start is None and end == 0 and kind in ("rows", "range") and f.kind != "nth":
        return "carried"
    return ""


def _over_ranges(df: DataFrame, functions: dict[str, Function], spec: Spec) -> DataFrame:
    """over_all without partition_by. Rows are numbered along the order, in ranges that peers never straddle; what a
    function needs of other ranges comes from one row for each range. Frames of a limited reach are computed in
    blocks of positions, which get copies of the rows next to them."""
    names = [*df.columns, *[n for n in functions if n not in df.columns]]
    kinds = df.withColumns({n: f.within(spec, spec) for n, f in functions.items()}).schema
    keys = {f"__k{i}": F.col(c) if isinstance(c, str) else c for i, (c, _) in enumerate(spec.ordering)}
    downs = [not up for _, up in spec.ordering]
    ways = {n: _way(f, spec) for n, f in functions.items()}
    at = indexed(df.withColumns(keys), list(keys), downs)

    by_key = Window.partitionBy("__part").orderBy(*[F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down in zip(keys, downs, strict=True)])
    by_place = Window.partitionBy("__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    running = by_place if spec.frame and spec.frame[0] == "rows" else by_key
    line = Window.orderBy("__of")
    before, throughout = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # The parts of a function: name, value within the range, its total for a range, fold over ranges.
    here: dict[str, Column] = {"__rank": F.rank().over(by_key), "__dense": F.dense_rank().over(by_key)}
    totals = [F.count(F.lit(1)).alias("__n"), F.max("__dense").alias("__levels")]
    folds = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(throughout).alias("__all"), F.coalesce(F.sum("__levels").over(before), F.lit(0)).alias("__lower")]
    for i, (n, f) in enumerate(functions.items()):
        if ways[n] not in ("whole", "carried"):
            continue
        v = F.col(f"`{f.columns[0]}`") if f.columns else F.lit(1)
        window = before if ways[n] == "carried" else throughout
        if f.kind in ("first", "last", "nth"):
            pick = {"first": F.min_by(v, "__i"), "last": F.max_by(v, "__i"), "nth": F.max_by(v, F.when(F.col("__i") == f.k - 1, 1))}[f.kind]
            totals.append(pick.alias(f"__t{i}"))
            folds.append({"first": F.first, "last": F.last, "nth": F.max}[f.kind](f"__t{i}").over(throughout).alias(f"__c{i}"))
        elif f.kind == "avg":
            for suffix, make in (("s", F.sum), ("n", F.count)):
                here[f"__h{i}{suffix}"] = make(v).over(running)
                totals.append(make(v).alias(f"__t{i}{suffix}"))
                folds.append(F.sum(f"__t{i}{suffix}").over(window).alias(f"__c{i}{suffix}"))
        else:
            make, fold = {"sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}.get(f.kind, (F.count, F.sum))
            here[f"__h{i}"] = make(v).over(running)
            totals.append(make(v).alias(f"__t{i}"))
            folds.append(fold(f"__t{i}").over(window).alias(f"__c{i}"))

    at = at.withColumns(here)
    ranges = at.groupBy(F.col("__part").alias("__of")).agg(*totals).select("__of", *folds)
    at = at.join(F.broadcast(ranges), F.col("__part") == F.col("__of"))  # a row for each range

    def plus(mine: str, carried: str, kind: str) -> Column:
        a, b = F.col(carried), F.col(mine)
        return F.least(a, b) if kind == "min" else F.greatest(a, b) if kind == "max" else F.coalesce(a + b, a, b)

    i0, n_all = F.col("__i"), F.col("__all")
    rank_of = F.col("__before") + F.col("__rank")
    new: dict[str, Column] = {}
    for i, (n, f) in enumerate(functions.items()):
        if f.kind == "row_number":
            new[n] = i0 + 1
        elif f.kind == "rank":
            new[n] = rank_of
        elif f.kind == "dense_rank":
            new[n] = F.col("__lower") + F.col("__dense")
        elif f.kind == "percent_rank":
            new[n] = F.when(n_all > 1, (rank_of - 1) / (n_all - 1)).otherwise(F.lit(0.0))
        elif f.kind == "ntile":
            small, rest = F.floor(n_all / f.k), n_all % f.k
            longer = rest * (small + 1)  # rows in the first, longer tiles
            new[n] = F.when(i0 < longer, F.floor(i0 / (small + 1))).otherwise(rest + F.floor((i0 - longer) / F.greatest(small, F.lit(1)))) + 1
        elif ways[n] == "whole":
            new[n] = F.col(f"__c{i}s") / F.col(f"__c{i}n") if f.kind == "avg" else F.col(f"__c{i}")
        elif ways[n] == "carried":
            new[n] = plus(f"__h{i}s", f"__c{i}s", "") / plus(f"__h{i}n", f"__c{i}n", "") if f.kind == "avg" else plus(f"__h{i}", f"__c{i}", f.kind)
    # Functions replace columns of their names only at the end: others may still read them.
    at = at.withColumns({f"__r{list(functions).index(n)}": v.cast(kinds[n].dataType) for n, v in new.items()})
    blocks = {n: f for n, f in functions.items() if ways[n] == "block"}
    if blocks:
        lows = [f.k if f.kind == "shift" else spec.frame[1] for f in blocks.values()]
        highs = [f.k if f.kind == "shift" else spec.frame[2] for f in blocks.values()]
        low, high = min(0, *lows), max(0, *highs)
        size = max(BLOCK, 4 * (high - low))
        block = lambda place: F.floor(F.greatest(place, F.lit(0)) / size)
        at = at.withColumn("__b", F.explode(F.sequence(block(i0 - high), block(i0 - low))))
        inside = Window.partitionBy("__b").orderBy("__i")
        value = lambda f: f.make().over(inside if f.kind == "shift" else inside.rowsBetween(spec.frame[1], spec.frame[2]))
        at = at.withColumns({f"__r{list(functions).index(n)}": value(f).cast(kinds[n].dataType) for n, f in blocks.items()}).where(F.col("__b") == block(i0))
    results = {n: F.col(f"__r{i}").alias(n) for i, n in enumerate(functions)}
    return at.select(*[results.get(c, F.col(f"`{c}`")) for c in names])
