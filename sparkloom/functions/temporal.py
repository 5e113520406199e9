"""Date and time functions from Column to Column. Timestamps are microseconds; columns named
nanoseconds are microseconds times a thousand. Adding months keeps to the end of a shorter month."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.strings import java_pattern

UNITS = ("nanosecond", "microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
#: Microseconds of the units of fixed length.
_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
_NAMES = {
    "ns": "nanosecond", "us": "microsecond", "µs": "microsecond", "ms": "millisecond", "s": "second", "sec": "second", "m": "minute", "min": "minute", "t": "minute",
    "h": "hour", "d": "day", "w": "week", "mo": "month", "q": "quarter", "y": "year",
}


def _epoch(t: Column) -> Column:
    """Microseconds since 1970 of timestamps with or without a zone."""
    return F.unix_micros(t.cast("timestamp"))


# ---- components


def year(t: Column) -> Column:
    return F.year(t)


def month(t: Column) -> Column:
    return F.month(t)


def day(t: Column) -> Column:
    return F.dayofmonth(t)


def hour(t: Column) -> Column:
    return F.hour(t)


def minute(t: Column) -> Column:
    return F.minute(t)


def second(t: Column) -> Column:
    return F.second(t)


def _micros(t: Column) -> Column:
    return F.pmod(_epoch(t), F.lit(1_000_000))


def millisecond(t: Column) -> Column:
    return F.floor(_micros(t) / 1000).cast("int")


def microsecond(t: Column) -> Column:
    return _micros(t).cast("int")


def nanosecond(t: Column) -> Column:
    return (_micros(t) * 1000).cast("int")


def day_of_week(t: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(t) - 1


def day_of_year(t: Column) -> Column:
    return F.dayofyear(t)


def quarter(t: Column) -> Column:
    return F.quarter(t)


def week_of_year(t: Column) -> Column:
    """ISO week."""
    return F.weekofyear(t)


def iso_year(t: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), t)


def is_leap_year(t: Column) -> Column:
    y = F.year(t)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def is_weekend(t: Column) -> Column:
    return F.dayofweek(t).isin(1, 7)


def is_month_start(t: Column) -> Column:
    return F.dayofmonth(t) == 1


def is_month_end(t: Column) -> Column:
    return F.to_date(t) == F.last_day(t)


def is_quarter_start(t: Column) -> Column:
    return is_month_start(t) & (F.month(t) % 3 == 1)


def is_quarter_end(t: Column) -> Column:
    return is_month_end(t) & (F.month(t) % 3 == 0)


def is_year_start(t: Column) -> Column:
    return F.dayofyear(t) == 1


def is_year_end(t: Column) -> Column:
    return is_month_end(t) & (F.month(t) == 12)


# ---- rounding


def _unit(unit: str) -> str:
    name = _NAMES.get(unit, unit.lower().rstrip("s") if unit.lower() not in UNITS else unit.lower())
    if name not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    return name


def floor(t: Column, unit: str) -> Column:
    """Start of the unit; weeks start on Monday. Nanoseconds are below the resolution."""
    name = _unit(unit)
    return t if name == "nanosecond" else F.date_trunc(name, t)


truncate = floor


def ceil(t: Column, unit: str) -> Column:
    low = floor(t, unit)
    return F.when(low == t, t).otherwise(_plus(low, _unit(unit), 1))


def round_(t: Column, unit: str) -> Column:
    """The nearer of start and next start; halfway goes up."""
    low = floor(t, unit)
    high = _plus(low, _unit(unit), 1)
    return F.when(_epoch(t) - _epoch(low) < _epoch(high) - _epoch(t), low).otherwise(high)


def _plus(t: Column, unit: str, n: int) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return t + F.make_interval(months=F.lit(months[unit] * n))
    if unit == "nanosecond":
        return t
    return F.timestamp_micros(_epoch(t) + _MICROS[unit] * n)


# ---- durations and arithmetic


@dataclass(frozen=True)
class Duration:
    """Months, days and nanoseconds, kept apart."""

    months: int = 0
    days: int = 0
    nanoseconds: int = 0

    @staticmethod
    def of(n: int, unit: str) -> Duration:
        name = _unit(unit)
        if name in ("month", "quarter", "year"):
            return Duration(months=n * {"month": 1, "quarter": 3, "year": 12}[name])
        if name in ("day", "week"):
            return Duration(days=n * {"day": 1, "week": 7}[name])
        return Duration(nanoseconds=n if name == "nanosecond" else n * _MICROS[name] * 1000)

    @staticmethod
    def parse(text: str) -> Duration:
        """As in `2h 30m`, `1y 2mo 3d`, `1.5h`; ValueError if there is anything else."""
        total, at = Duration(), 0
        for m in re.finditer(r"\s*([+-]?\d+(?:\.\d+)?)\s*(ns|us|µs|ms|mo|min|sec|[smhdwyqt])", text.lower()):
            if m.start() != at:
                break
            number, at = float(m[1]), m.end()
            if number == int(number):
                total = total + Duration.of(int(number), m[2])
            elif _unit(m[2]) in _MICROS:
                total = total + Duration(nanoseconds=round(number * _MICROS[_unit(m[2])] * 1000))
            else:
                raise ValueError(f"invalid duration: {text}")
        if not at or text[at:].strip():
            raise ValueError(f"invalid duration: {text}")
        return total

    def __add__(self, other: Duration) -> Duration:
        return Duration(self.months + other.months, self.days + other.days, self.nanoseconds + other.nanoseconds)

    def __neg__(self) -> Duration:
        return Duration(-self.months, -self.days, -self.nanoseconds)

    def __sub__(self, other: Duration) -> Duration:
        return self + -other

    def __mul__(self, n: int) -> Duration:
        return Duration(self.months * n, self.days * n, self.nanoseconds * n)

    def __str__(self) -> str:
        """As in `1y 2mo 3d 4h 5min 6.5s`."""
        sign = "-" if self.months < 0 or self.days < 0 or self.nanoseconds < 0 else ""
        seconds, nanos = divmod(abs(self.nanoseconds), 10**9)
        parts = [(abs(self.months) // 12, "y"), (abs(self.months) % 12, "mo"), (abs(self.days), "d"), (seconds // 3600, "h"), (seconds // 60 % 60, "min")]
        rest = f"{seconds % 60}.{nanos:09}".rstrip("0").rstrip(".")
        text = " ".join([f"{n}{u}" for n, u in parts if n] + ([f"{rest}s"] if rest != "0" else []))
        return sign + text if text else "0s"

    def interval(self) -> Column:
        return F.make_interval(months=F.lit(self.months), days=F.lit(self.days), secs=F.lit(self.nanoseconds / 1e9))


def add(t: Column, d: Duration | str) -> Column:
    """Months first, then days, then the rest."""
    d = Duration.parse(d) if isinstance(d, str) else d
    return t + d.interval()


def sub(t: Column, d: Duration | str) -> Column:
    return add(t, -(Duration.parse(d) if isinstance(d, str) else d))


def diff(a: Column, b: Column) -> Column:
    """a - b of timestamps in nanoseconds."""
    return (_epoch(a) - _epoch(b)) * 1000


def diff_days(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def add_business_days(t: Column, n: int) -> Column:
    """n weekdays later (earlier if negative), in closed form. From a weekend the count starts at
    the weekday before it (after it if negative); n = 0 leaves the date as it is."""
    if n == 0:
        return t
    w = F.weekday(t)  # 0 is Monday
    if n > 0:
        back = F.greatest(w - 4, F.lit(0))  # to Friday
        from_ = F.least(w, F.lit(4))
        days = F.lit(n) + 2 * F.floor((from_ + n) / 5) - back
    else:
        ahead = F.when(w > 4, 7 - w).otherwise(0)  # to Monday
        from_ = F.when(w > 4, 0).otherwise(w)
        days = F.lit(n) - 2 * F.floor((F.lit(4) - from_ - n) / 5) + ahead
    return t + F.make_interval(days=days.cast("int"))


# ---- formats and time zones


def format_(t: Column, fmt: str) -> Column:
    """strftime directives or a pattern of Spark."""
    return F.date_format(t, java_pattern(fmt))


def iso_format(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


#: Abbreviations and their zones.
ZONES = {"EST": "America/New_York", "CST": "America/Chicago", "MST": "America/Denver", "PST": "America/Los_Angeles", "GMT": "Etc/GMT", "UTC": "UTC", "JST": "Asia/Tokyo", "IST": "Asia/Kolkata", "CET": "Europe/Paris"}


def load_timezone(name: str) -> str:
    """The zone's name; ValueError if there is none."""
    from zoneinfo import ZoneInfo

    zone = ZONES.get(name.upper(), name)
    try:
        ZoneInfo(zone)
    except Exception as e:
        raise ValueError(f"unknown time zone: {name}") from e
    return zone


def in_timezone(t: Column, zone: str) -> Column:
    """Wall clock of the instant in a zone, as a timestamp without zone. The instant itself has none."""
    return F.convert_timezone(F.lit("UTC"), F.lit(load_timezone(zone)), t.cast("timestamp_ntz"))


convert_timezone = with_timezone = to_local = in_timezone


def to_utc(t: Column, zone: str) -> Column:
    """The instant of a wall clock in a zone."""
    return F.convert_timezone(F.lit(load_timezone(zone)), F.lit("UTC"), t.cast("timestamp_ntz")).cast("timestamp")


def localize(t: Column, zone: str) -> Column:
    """Only the label: values stay, the zone must exist."""
    load_timezone(zone)
    return t


def with_zone(df: DataFrame, column: str, zone: str) -> DataFrame:
    """df with a zone as the label of a timestamp column, kept in the schema's metadata; values stay."""
    return df.withMetadata(column, {**df.schema[column].metadata, "timezone": load_timezone(zone)})


def get_timezone(df: DataFrame, column: str) -> str:
    """The label of a timestamp column; UTC without one."""
    return df.schema[column].metadata.get("timezone", "UTC")


def convert_column(df: DataFrame, column: str, zone: str) -> DataFrame:
    """df with a timestamp column shown in a zone: its wall clock there, labelled with the zone."""
    return with_zone(df.withColumn(column, in_timezone(F.col(column), zone)), column, zone)


def from_epoch(n: Column, unit: str = "second") -> Column:
    name = _unit(unit)
    scale = {"second": F.timestamp_seconds, "millisecond": F.timestamp_millis, "microsecond": F.timestamp_micros}
    if name == "nanosecond":
        return F.timestamp_micros(F.floor(n / 1000).cast("long"))
    return scale[name](n)


# ---- ranges


def parse_frequency(text: str) -> Duration:
    """[n]unit, n = 1 by default; ValueError otherwise."""
    m = re.fullmatch(r"\s*(\d*)\s*(ns|us|ms|mo|min|s|t|m|h|d|w|q|y)\s*", text.lower() if text not in ("M", "MS", "MO") else "mo")
    if not m or m[1] == "0":
        raise ValueError(f"invalid frequency: {text}")
    return Duration.of(int(m[1] or 1), m[2])


def date_range(spark: SparkSession, start: str, end: str | None = None, frequency: str = "1d", count: int | None = None, closed: str = "both", name: str = "ts", business: bool = False) -> DataFrame:
    """Timestamps from start by a frequency up to end, or so many. closed: both, left, right or neither
    for the bounds. An end before the start, or no count, gives no rows."""
    step = parse_frequency(frequency)
    if end is None and count is None:
        raise ValueError("end or count is needed")
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError("closed is both, left, right or neither")
    s = F.lit(start).cast("timestamp")
    if count is not None:
        rows = spark.range(max(0, count)).select((s + F.make_interval(months=F.col("id").cast("int") * step.months, days=F.col("id").cast("int") * step.days, secs=F.col("id") * (step.nanoseconds / 1e9))).alias(name))
    else:
        e = F.lit(end).cast("timestamp")
        every = F.when(s <= e, F.sequence(s, e, step.interval())).otherwise(F.array().cast("array<timestamp>"))
        rows = spark.range(1).select(F.explode(every).alias(name))
        if closed in ("right", "neither"):
            rows = rows.where(F.col(name) > s)
        if closed in ("left", "neither"):
            rows = rows.where(F.col(name) < e)
    return rows.where(~F.dayofweek(name).isin(1, 7)) if business else rows


@dataclass(frozen=True)
class DateRangeBuilder:
    """date_range, put together part by part; each part gives a new builder."""

    first: str | None = None
    last: str | None = None
    step: str = "1d"
    number: int | None = None
    bounds: str = "both"
    zone: str | None = None

    def start(self, at: str) -> DateRangeBuilder:
        return replace(self, first=at)

    def end(self, at: str) -> DateRangeBuilder:
        return replace(self, last=at)

    def frequency(self, text: str) -> DateRangeBuilder:
        parse_frequency(text)
        return replace(self, step=text)

    def count(self, n: int) -> DateRangeBuilder:
        return replace(self, number=n)

    def closed(self, bounds: str) -> DateRangeBuilder:
        return replace(self, bounds=bounds)

    def inclusive(self, both: bool) -> DateRangeBuilder:
        return replace(self, bounds="both" if both else "left")

    def timezone(self, zone: str) -> DateRangeBuilder:
        """Start and end are wall clocks of the zone."""
        return replace(self, zone=load_timezone(zone))

    def build(self, spark: SparkSession, name: str = "ts") -> DataFrame:
        if self.first is None or (self.last is None and self.number is None):
            raise ValueError("start, and end or count, are needed")
        rows = date_range(spark, self.first, self.last, self.step, self.number, self.bounds, name)
        return rows if self.zone is None else with_zone(rows.withColumn(name, to_utc(F.col(name), self.zone)), name, self.zone)
