"""Column helpers for predicates, arithmetic, conditionals and casts. All are null-aware."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.types import dtype


def col(name: str) -> Column:
    return F.col(name)


def lit(value: Any) -> Column:
    return F.lit(value)


def as_col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def eq_missing(a: Column, b: Any) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(as_col(b))


def between(a: Column, low: Any, high: Any) -> Column:
    """Both bounds included."""
    return a.between(as_col(low), as_col(high))


def is_in(a: Column, values: Iterable[Any]) -> Column:
    return a.isin(list(values))


def add(a: Column, b: Any) -> Column:
    return a + as_col(b)


def sub(a: Column, b: Any) -> Column:
    return a - as_col(b)


def mul(a: Column, b: Any) -> Column:
    return a * as_col(b)


def div(a: Column, b: Any) -> Column:
    """Division; by zero it is null instead of an error."""
    return F.try_divide(a, as_col(b))


def mod(a: Column, b: Any) -> Column:
    """Remainder with the sign of the dividend; by zero it is null."""
    return F.try_mod(a, as_col(b))


def negate(a: Column) -> Column:
    return -a


class _When:
    def __init__(self, condition: Column):
        self._condition = condition

    def then(self, value: Any) -> _Then:
        return _Then(self._condition, as_col(value))


class _Then:
    def __init__(self, condition: Column, value: Column):
        self._condition, self._value = condition, value

    def otherwise(self, value: Any) -> Column:
        return F.when(self._condition, self._value).otherwise(as_col(value))

    def build(self) -> Column:
        """Without otherwise: null where the condition isn't true."""
        return F.when(self._condition, self._value)


def when(condition: Column) -> _When:
    return _When(condition)


def cast(a: Column, to: Any) -> Column:
    """Cast to a type or a type's name; what can't be converted is null."""
    return a.try_cast(dtype(to))
