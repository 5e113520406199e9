"""Series: frames of one column, with a type and, where wanted, a mask of valid values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.files import from_columns
from sparkloom.types import dtype


def series(spark: SparkSession, name: str, values: Sequence[Any], kind: str | None = None, validity: Sequence[bool] | None = None) -> DataFrame:
    """A column of values, in their order. validity: false where a value counts as null. Without kind the type is
    inferred from the values; an empty name becomes `value`."""
    if validity is not None:
        if len(validity) != len(values):
            raise ValueError("validity differs in length")
        values = [v if ok else None for v, ok in zip(values, validity, strict=True)]
    name = name or "value"
    return from_columns(spark, {name: list(values)}, None if kind is None else {name: kind})


def _typed(kind: str) -> Callable[..., DataFrame]:
    dtype(kind)

    def make(spark: SparkSession, name: str, values: Sequence[Any], validity: Sequence[bool] | None = None) -> DataFrame:
        return series(spark, name, values, kind, validity)

    make.__name__ = f"{kind}_series"
    make.__doc__ = f"A series of type {kind}."
    return make


boolean_series, string_series, binary_series = _typed("bool"), _typed("string"), _typed("binary")
int8_series, int16_series, int32_series, int64_series = _typed("i8"), _typed("i16"), _typed("i32"), _typed("i64")
uint8_series, uint16_series, uint32_series, uint64_series = _typed("u8"), _typed("u16"), _typed("u32"), _typed("u64")
float32_series, float64_series = _typed("f32"), _typed("f64")


def null_count(column: DataFrame) -> int:
    return column.where(f"`{column.columns[0]}` IS NULL").count()
