"""Time-series resampling: a tumbling window over a timestamp, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.temporal import parse_frequency


def bucket(ts: str, frequency: str, closed: str = "left", label: str = "left", origin: str | None = None) -> Column:
    """Start (or end, with label right) of the bucket of a timestamp. Weeks start on Monday, months on
    the first. With closed right, a bucket holds its end and not its start. Buckets of fixed length are
    counted from the origin, by default 1970-01-01 (for weeks the Monday 1970-01-05)."""
    if closed not in ("left", "right") or label not in ("left", "right"):
        raise ValueError("closed and label are left or right")
    step = parse_frequency(frequency)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    if closed == "right":
        t = t - 1
    if step.months:
        at = F.timestamp_micros(t)
        month = (F.year(at) - 1970) * 12 + F.month(at) - 1
        first = F.floor(month / step.months) * step.months
        start = F.make_timestamp(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_interval(months=first.cast("int"))
        return start if label == "left" else start + F.make_interval(months=F.lit(step.months))
    width = step.days * 86_400_000_000 + step.nanoseconds // 1000
    if origin is not None:
        zero = F.unix_micros(F.lit(origin).cast("timestamp"))
    else:
        zero = F.lit(4 * 86_400_000_000 if step.days and step.days % 7 == 0 else 0)
    # Integer arithmetic: pmod is never negative.
    start = t - F.pmod(t - zero, F.lit(width))
    return F.timestamp_micros(start if label == "left" else start + width)


_FUNCTIONS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def resample(df: DataFrame, ts: str, frequency: str, value: str, functions: Sequence[str] = ("sum",), by: Sequence[str] = (), closed: str = "left", label: str = "left", origin: str | None = None) -> DataFrame:
    """by, `ts` (the bucket) and `<value>_<function>` for sum, mean, min, max, first, last and count. Only
    buckets with rows; rows without a timestamp go. count counts rows, also those without a value; the
    others skip nulls. first and last are by time."""
    out: list[Column] = []
    for f in functions:
        if f == "count":
            c = F.count(F.lit(1))
        elif f in ("first", "last"):
            order = F.when(F.col(value).isNotNull(), F.col("__t"))
            c = (F.min_by if f == "first" else F.max_by)(value, order)
        elif f in _FUNCTIONS:
            c = _FUNCTIONS[f](value)
        else:
            raise ValueError(f"unknown function: {f}")
        out.append(c.alias(f"{value}_{f}"))
    rows = df.where(F.col(ts).isNotNull()).withColumn("__t", F.col(ts)).withColumn(ts, bucket(ts, frequency, closed, label, origin))
    return rows.groupBy(*by, ts).agg(*out)
