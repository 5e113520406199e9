from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import exprs as X
from sparkloom.functions import strings as S
from sparkloom.functions import temporal as D
from sparkloom.types import dtype


@pytest.fixture(scope="module")
def of(spark):
    def value(c, **cols):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"])
        return df.select(c.alias("x")).first()["x"]

    return value


def test_strings(of):
    s = F.col("s")
    cases = [
        (S.length(s), "世界", 6), (S.rune_length(s), "世界", 2), (S.capitalize(s), "hELLO", "Hello"), (S.swap_case(s), "aBc", "AbC"), (S.is_alpha(s), "", False), (S.is_upper(s), "A1", True),
        (S.trim(s), "\t a \n", "a"), (S.trim(s, "x"), "xxaxx", "a"), (S.trim_prefix(s, "ab"), "abc", "c"), (S.trim_suffix(s, "bc"), "abc", "a"), (S.lpad(s, 3), "hello", "hello"), (S.center(s, 10, "="), "hello", "==hello==="),
        (S.zfill(s, 8), "-123", "-0000123"), (S.zfill(s, 2), "12345", "12345"), (S.slice_(s, -3, 2), "hello", "ll"), (S.slice_(s, 1, 3), "hello", "ell"), (S.replace(s, "a", "b", 2), "aaa", "bba"), (S.replace(s, ".", "-"), "a.b.c", "a-b-c"),
        (S.find(s, "z"), "abc", -1), (S.count(s, "aa"), "aaaa", 2), (S.count(s, ""), "abc", 4), (S.split(s, "."), "a.b", ["a", "b"]), (S.extract(s, r"(\d+)-(\d+)", 2), "x1-23", "23"), (S.extract(s, "z"), "abc", None),
        (S.replace_regex(s, "[0-9]", "#", 2), "a1b2c3", "a#b#c3"), (S.to_integer(s), "12x", None), (S.to_integer(s, 16), "-ff", -255), (S.to_float(s), "inf", float("inf")), (S.to_boolean(s), "On", True), (S.to_boolean(s), "maybe", None),
        (S.to_datetime(s, "%d/%m/%Y %H:%M"), "05/02/2024 13:45", datetime(2024, 2, 5, 13, 45)), (S.to_date(s), "2024-02-30", None), (S.to_date(s), "2024-02-29", date(2024, 2, 29)), (S.to_time(s), "01:02:03", 3723 * 10**9),
        (S.to_time(s, "%I:%M %p"), "01:30 PM", 48600 * 10**9), (S.expand_tabs(s, 4), "a\tbc\td", "a   bc  d"), (S.wrap(s, 7), "the quick brown fox", "the\nquick\nbrown\nfox"), (S.wrap(s, 9), "the quick brown", "the quick\nbrown"),
        (S.decode(S.encode(s, "base64"), "base64"), "héé", "héé"), (S.decode(s, "hex"), "zz", None), (S.is_ascii(s), "é", False), (S.normalize_nfc(s), "é", "é"), (S.format_template("{{.s}}-{s}", {"s": s}), "q", "q-q"), (S.join(",", s, F.lit(None).cast("string")), "a", None),
    ]
    for c, given, want in cases:
        assert of(c, s=given) == want, (c, given, want)
    for predicate in (S.contains(s, "a"), S.is_lower(s), S.match(s, "a")):
        assert of(predicate, s=F.lit(None).cast("string")) is False


def test_exprs(of):
    null = F.lit(None).cast("int")
    assert of(X.eq_missing(null, None)) is True and of(X.div(F.lit(1), 0)) is None and of(X.mod(F.lit(-7), 3)) == -1
    assert of(X.when(F.lit(False)).then(1).build()) is None and of(X.cast(F.lit("x"), "i64")) is None and of(X.cast(F.lit("12"), "u8")) == 12
    assert dtype("u64").simpleString() == "decimal(20,0)"
    with pytest.raises(ValueError):
        dtype("nope")


def test_temporal(of, spark):
    t = F.col("t").cast("timestamp")
    when = "2024-03-14 15:09:26.535897"
    for c, want in [
        (D.day_of_week(t), 4), (D.week_of_year(t), 11), (D.microsecond(t), 535897), (D.nanosecond(t), 535897000), (D.is_leap_year(t), True), (D.floor(t, "week"), datetime(2024, 3, 11)), (D.ceil(t, "hour"), datetime(2024, 3, 14, 16)),
        (D.round_(t, "hour"), datetime(2024, 3, 14, 15)), (D.ceil(t, "month"), datetime(2024, 4, 1)), (D.add(t, "1mo 2d"), datetime(2024, 4, 16, 15, 9, 26, 535897)), (D.iso_year(t), 2024),
        (D.in_timezone(t, "EST"), datetime(2024, 3, 14, 11, 9, 26, 535897)), (D.to_utc(D.in_timezone(t, "Asia/Tokyo"), "Asia/Tokyo"), datetime(2024, 3, 14, 15, 9, 26, 535897)), (D.format_(t, "%Y-%m-%d"), "2024-03-14"),
    ]:
        assert of(c, t=when) == want, c
    for day in range(1, 15):
        for n in (-11, -5, -1, 1, 2, 5, 6, 13):
            got = of(D.add_business_days(t, n).cast("date"), t=f"2024-03-{day:02} 00:00:00")
            d, left = date(2024, 3, day), abs(n)
            while left:
                d = date.fromordinal(d.toordinal() + (1 if n > 0 else -1))
                left -= d.weekday() < 5
            assert got == d, (day, n)
    assert D.Duration.parse("1y 2mo 3d") == D.Duration(14, 3) and D.Duration.parse("2h 30m").nanoseconds == 9000 * 10**9
    for bad in ("", "x", "1h nope"):
        with pytest.raises(ValueError):
            D.Duration.parse(bad)
    days = lambda *a, **k: [r[0].day for r in D.date_range(spark, *a, **k).orderBy("ts").collect()]
    assert days("2024-03-01", "2024-03-04") == [1, 2, 3, 4] and days("2024-03-04", "2024-03-01") == []
    assert days("2024-03-01", count=3, frequency="2d") == [1, 3, 5] and days("2024-03-01", "2024-03-05", business=True) == [1, 4, 5]
    with pytest.raises(ValueError, match="invalid frequency"):
        D.parse_frequency("3 fortnights")
