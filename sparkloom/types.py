"""Logical types by name, and their Spark types.

Spark has no unsigned integers: they widen to the next signed type, the 64-bit one to a
decimal without loss. Timestamps are microseconds; a time of day is kept as nanoseconds
since midnight in a long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "i8": T.ByteType(), "int8": T.ByteType(), "i16": T.ShortType(), "int16": T.ShortType(),
    "i32": T.IntegerType(), "int32": T.IntegerType(), "i64": T.LongType(), "int64": T.LongType(),
    "u8": T.ShortType(), "uint8": T.ShortType(), "u16": T.IntegerType(), "uint16": T.IntegerType(),
    "u32": T.LongType(), "uint32": T.LongType(), "u64": T.DecimalType(20, 0), "uint64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "float32": T.FloatType(), "f64": T.DoubleType(), "float64": T.DoubleType(),
    "str": T.StringType(), "string": T.StringType(), "binary": T.BinaryType(), "bytes": T.BinaryType(),
    "date": T.DateType(), "time": T.LongType(), "datetime": T.TimestampType(), "datetime_ntz": T.TimestampNTZType(),
    "duration": T.DayTimeIntervalType(), "null": T.NullType(),
}


def dtype(name: str | T.DataType) -> T.DataType:
    """The Spark type of a name; Spark types pass through. Unknown names raise ValueError."""
    if isinstance(name, T.DataType):
        return name
    if name.lower() in _NAMES:
        return _NAMES[name.lower()]
    raise ValueError(f"unknown type: {name}")


def array_of(inner: str | T.DataType) -> T.ArrayType:
    return T.ArrayType(dtype(inner))


def struct_of(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, dtype(t)) for n, t in fields.items()])


def decimal(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType))


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.StructType, T.MapType))


def columns_of_type(schema: T.StructType, kind: str | T.DataType) -> list[str]:
    """Names of the columns of a type, in schema order."""
    want = dtype(kind)
    return [f.name for f in schema.fields if f.dataType == want]


@dataclass(frozen=True)
class ColType:
    """A selector of all columns of a type."""

    kind: str | T.DataType


def col_type(kind: str | T.DataType) -> ColType:
    dtype(kind)
    return ColType(kind)
