"""Fluent expressions: every step gives a new one, `build` the Column.

    col("price").mul(2).gt(10).build()
    col("name").str().to_upper().build()
    col("v").sum().over(Spec().partition_by("k")).build()
"""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import exprs, strings, temporal
from sparkloom.operators import window

_plain = lambda x: x.build() if isinstance(x, Expr) else x

#: Name: function of the Column and the arguments.
_STEPS: dict[str, Callable[..., Column]] = {
    "add": exprs.add, "sub": exprs.sub, "mul": exprs.mul, "div": exprs.div, "mod": exprs.mod, "negate": exprs.negate, "eq_missing": exprs.eq_missing, "between": exprs.between, "is_in": exprs.is_in, "cast": exprs.cast,
    "eq": lambda a, b: a == exprs.as_col(b), "ne": lambda a, b: a != exprs.as_col(b), "lt": lambda a, b: a < exprs.as_col(b), "le": lambda a, b: a <= exprs.as_col(b), "gt": lambda a, b: a > exprs.as_col(b), "ge": lambda a, b: a >= exprs.as_col(b),
    "and_": lambda a, b: a & exprs.as_col(b), "or_": lambda a, b: a | exprs.as_col(b), "not_": lambda a: ~a, "is_null": Column.isNull, "is_not_null": Column.isNotNull, "alias": Column.alias,
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": F.median,
    "first": lambda a, by: F.min_by(a, F.when(a.isNotNull(), F.col(by))), "last": lambda a, by: F.max_by(a, F.when(a.isNotNull(), F.col(by))),
}


class Expr:
    def __init__(self, column: Column):
        self._column = column

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        if name not in _STEPS:
            raise AttributeError(name)
        return lambda *args: Expr(_STEPS[name](self._column, *map(_plain, args)))

    def over(self, spec: window.Spec) -> Expr:
        """An aggregate as a window expression."""
        return Expr(window.of(self._column).over(spec))

    def str(self) -> _Functions:
        return _Functions(self._column, strings)

    def dt(self) -> _Functions:
        return _Functions(self._column, temporal)

    def build(self) -> Column:
        return self._column


class _Functions:
    """The functions of a module, of a column."""

    def __init__(self, column: Column, module: ModuleType):
        self._column, self._module = column, module

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        step = getattr(self._module, name, None) or getattr(self._module, f"{name}_", None)
        if not callable(step) or name.startswith("_"):
            raise AttributeError(name)
        return lambda *args, **options: Expr(step(self._column, *map(_plain, args), **options))


def col(name: str) -> Expr:
    return Expr(F.col(name))


def lit(value: Any) -> Expr:
    return Expr(F.lit(value))
