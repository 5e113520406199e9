"""String functions from Column to Column.

Null in gives null out, but for the predicates, which are false for null. Lengths and positions
count code points unless the name says bytes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.types import dtype

_SPACES = r"[\s\u0085\p{Z}]"


def _sure(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def _quote(literal: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+\-?^$|#&~ ])", r"\\\1", literal)


def length(s: Column) -> Column:
    """Bytes of the UTF-8 form."""
    return F.octet_length(s)


byte_length = length


def rune_length(s: Column) -> Column:
    return F.char_length(s)


def to_upper(s: Column) -> Column:
    return F.upper(s)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def to_title(s: Column) -> Column:
    return F.initcap(s)


def capitalize(s: Column) -> Column:
    """First letter in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**30)))


def swap_case(s: Column) -> Column:
    swapped = F.transform(F.split(s, ""), lambda c: F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(swapped, "")


def is_upper(s: Column) -> Column:
    return _sure((F.upper(s) == s) & s.rlike(r"\p{L}"))


def is_lower(s: Column) -> Column:
    return _sure((F.lower(s) == s) & s.rlike(r"\p{L}"))


def is_title(s: Column) -> Column:
    return _sure((F.initcap(s) == s) & s.rlike(r"\p{L}"))


def is_alpha(s: Column) -> Column:
    return _sure(s.rlike(r"^\p{L}+\z"))


def is_numeric(s: Column) -> Column:
    return _sure(s.rlike(r"^\p{N}+\z"))


def is_alphanumeric(s: Column) -> Column:
    return _sure(s.rlike(r"^[\p{L}\p{N}]+\z"))


def is_space(s: Column) -> Column:
    return _sure(s.rlike(rf"^{_SPACES}+\z"))


def is_numeric_str(s: Column) -> Column:
    """Whether it parses as a number."""
    return s.try_cast("double").isNotNull()


def trim(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, f"^{_SPACES}+|{_SPACES}+$", "") if chars is None else F.btrim(s, F.lit(chars))


def ltrim(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, f"^{_SPACES}+", "") if chars is None else F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, f"{_SPACES}+$", "") if chars is None else F.rtrim(s, F.lit(chars))


strip = trim


def trim_prefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, 2**30)).otherwise(s)


def trim_suffix(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), F.left(s, F.char_length(s) - len(suffix))).otherwise(s)


def pad(s: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Padding on a side (left, right or both); never cuts. On both sides, what is left over goes right."""
    n = F.char_length(s)
    if side == "left":
        padded = F.lpad(s, width, fill)
    elif side == "right":
        padded = F.rpad(s, width, fill)
    elif side == "both":
        left = F.floor((F.lit(width) - n) / 2).cast("int")
        padded = F.rpad(F.concat(F.repeat(F.lit(fill), left), s), width, fill)
    else:
        raise ValueError("side is left, right or both")
    return F.when(n >= width, s).otherwise(padded)


def lpad(s: Column, width: int, fill: str = " ") -> Column:
    return pad(s, width, "left", fill)


def rpad(s: Column, width: int, fill: str = " ") -> Column:
    return pad(s, width, "right", fill)


def center(s: Column, width: int, fill: str = " ") -> Column:
    return pad(s, width, "both", fill)


ljust, rjust = rpad, lpad


def zfill(s: Column, width: int) -> Column:
    """Zeros up to the width, after a sign."""
    signed = s.rlike(r"^[+-]")
    body = F.when(signed, F.substring(s, 2, 2**30)).otherwise(s)
    room = F.lit(width) - F.when(signed, 1).otherwise(0)
    zeros = F.repeat(F.lit("0"), F.greatest(room - F.char_length(body), F.lit(0)))
    return F.concat(F.when(signed, F.left(s, F.lit(1))).otherwise(""), zeros, body)


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def join(sep: str, *parts: Column) -> Column:
    """All parts with a separator; null if any is null."""
    texts = [p.cast("string") for p in parts]
    whole = texts[0]
    for t in texts[1:]:
        whole = F.concat(whole, F.lit(sep), t)
    return whole


def join_list(a: Column, sep: str) -> Column:
    return F.array_join(a, sep)


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def reverse(s: Column) -> Column:
    return F.reverse(s)


def slice_(s: Column, start: int, n: int) -> Column:
    """n characters from a 0-based start; a negative start counts from the end."""
    if start >= 0:
        return F.substring(s, start + 1, n)
    first = F.greatest(F.char_length(s) + start, F.lit(0))
    return F.substring(s, first + 1, F.lit(n))


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def replace(s: Column, old: str, new: str, n: int = -1) -> Column:
    """Literal replacement of all occurrences, or of the first n."""
    if n < 0:
        return F.replace(s, F.lit(old), F.lit(new))
    if n == 0 or not old:
        return s
    parts = F.split(s, _quote(old), n + 1)
    return F.array_join(parts, new)


def contains(s: Column, part: str) -> Column:
    return _sure(F.contains(s, F.lit(part)))


def starts_with(s: Column, part: str) -> Column:
    return _sure(F.startswith(s, F.lit(part)))


def ends_with(s: Column, part: str) -> Column:
    return _sure(F.endswith(s, F.lit(part)))


def find(s: Column, part: str) -> Column:
    """0-based position of the first occurrence, or -1."""
    return F.instr(s, part) - 1


def count(s: Column, part: str) -> Column:
    """Occurrences that do not overlap; an empty part counts positions."""
    if not part:
        return F.char_length(s) + 1
    return ((F.char_length(s) - F.char_length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def split(s: Column, sep: str) -> Column:
    return F.split(s, _quote(sep), -1)


def split_n(s: Column, sep: str, n: int) -> Column:
    """At most n parts, the last with the rest."""
    return F.split(s, _quote(sep), n)


def split_first(s: Column, sep: str) -> Column:
    return F.get(F.split(s, _quote(sep), 2), F.lit(0))


def match(s: Column, pattern: str) -> Column:
    return _sure(s.rlike(pattern))


def extract(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null without a match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def extract_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def replace_regex(s: Column, pattern: str, new: str, n: int = -1) -> Column:
    """Replacement of all matches, or of the first n."""
    if n < 0:
        return F.regexp_replace(s, pattern, new)
    out = s
    head = F.lit("")
    for _ in range(n):
        # What stands before and in the first match of the rest is done; the rest goes on.
        parts = F.split(out, pattern, 2)
        found = out.rlike(pattern)
        head = F.when(found, F.concat(head, F.get(parts, F.lit(0)), F.lit(new))).otherwise(head)
        out = F.when(found, F.get(parts, F.lit(1))).otherwise(out)
    return F.concat(head, out)


def split_regex(s: Column, pattern: str, n: int = -1) -> Column:
    return F.split(s, pattern, n)


def find_all(s: Column, pattern: str) -> Column:
    """0-based position of the first match, or -1."""
    return F.regexp_instr(s, F.lit(pattern)) - 1


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def to_integer(s: Column, base: int = 10) -> Column:
    """bigint; null where it doesn't parse."""
    t = F.trim(s)
    if base == 10:
        return F.when(t.rlike(r"^[+-]?\d+\z"), t.try_cast("bigint"))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    value = F.conv(F.regexp_replace(t, "^[+-]", ""), base, 10).try_cast("bigint")
    return F.when(t.rlike(rf"(?i)^[+-]?[{digits}]+\z"), F.when(F.startswith(t, F.lit("-")), -value).otherwise(value))


#: Integer types from narrow to wide, with their bounds; unsigned ones come after the signed type of their width.
_INTEGERS = [(kind, low, high) for bits in (8, 16, 32) for kind, low, high in ((f"i{bits}", -(2 ** (bits - 1)), 2 ** (bits - 1) - 1), (f"u{bits}", 0, 2**bits - 1))]


def narrowest_integer(df: DataFrame, column: str) -> str:
    """Name of the narrowest integer type that holds all of a column's integers; i64 for the widest. One pass
    finds the least and the greatest value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return next((kind for kind, a, b in _INTEGERS if low is not None and a <= low and high <= b), "i64")


def to_integer_column(df: DataFrame, column: str, base: int = 10) -> DataFrame:
    """df with a column of texts parsed as integers of the narrowest type; null where one doesn't parse."""
    parsed = df.withColumn(column, to_integer(F.col(column), base))
    return parsed.withColumn(column, F.col(column).cast(dtype(narrowest_integer(parsed, column))))


def to_float(s: Column) -> Column:
    return s.try_cast("double")


def to_boolean(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isin("true", "t", "yes", "y", "1", "on"), True).when(t.isin("false", "f", "no", "n", "0", "off"), False)


#: Directives of strftime and the letters of Spark's patterns.
_STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%Z": "z", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%",
}


def java_pattern(fmt: str) -> str:
    """A strftime format as a pattern of Spark; one without % stays."""
    if "%" not in fmt:
        return fmt
    out = ""
    for m in re.finditer(r"%.|[A-Za-z]+|.", fmt, re.S):
        t = m[0]
        out += _STRFTIME.get(t, t) if t[0] == "%" else f"'{t}'" if t[0].isalpha() else t
    return out


#: Tried in this order.
DATETIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd MMM yyyy", "MMM dd, yyyy",
)
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd")


def to_datetime(s: Column, fmt: str | None = None) -> Column:
    formats = [java_pattern(fmt)] if fmt else list(DATETIME_FORMATS)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats], *([] if fmt else [s.try_cast("timestamp")]))


def to_date(s: Column, fmt: str | None = None) -> Column:
    formats = [java_pattern(fmt)] if fmt else list(DATE_FORMATS)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats])


def to_time(s: Column, fmt: str | None = None) -> Column:
    """Nanoseconds since midnight."""
    formats = [java_pattern(fmt)] if fmt else ["HH:mm:ss.SSSSSS", "HH:mm:ss", "HH:mm", "hh:mm:ss a", "hh:mm a"]
    t = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), s), F.lit(f"yyyy-MM-dd {f}")) for f in formats])
    return F.unix_micros(t) % 86_400_000_000 * 1000


def format_(fmt: str, *args: Column) -> Column:
    """printf; null if any argument is null."""
    ok = F.lit(True)
    for a in args:
        ok = ok & a.isNotNull()
    return F.when(ok, F.format_string(fmt, *args))


def format_template(template: str, fields: dict[str, Column]) -> Column:
    """Fields of a template, {{.name}} or {name}; null if any is null."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*\.?(\w+)\s*\}\}|\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), fields[m[1] or m[2]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def expand_tabs(s: Column, size: int = 8) -> Column:
    """Tabs become spaces up to the next multiple of size; line breaks start anew."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        room = F.lit(size) - acc["at"] % size
        return F.struct(
            F.concat(acc["text"], F.when(c == "\t", F.repeat(F.lit(" "), room)).otherwise(c)).alias("text"),
            F.when(c == "\t", acc["at"] + room).when(c == "\n", 0).otherwise(acc["at"] + 1).cast("int").alias("at"),
        )

    return F.when(s.isNotNull(), F.aggregate(F.split(s, ""), start, step, lambda acc: acc["text"]))


def wrap(s: Column, width: int) -> Column:
    """Greedy line breaks between words; longer words stay whole."""
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("at"))

    def step(acc: Column, word: Column) -> Column:
        n = F.char_length(word)
        fits = acc["at"] + 1 + n <= width
        return F.struct(
            F.when(acc["at"] < 0, word).when(fits, F.concat(acc["text"], F.lit(" "), word)).otherwise(F.concat(acc["text"], F.lit("\n"), word)).alias("text"),
            F.when((acc["at"] < 0) | ~fits, n).otherwise(acc["at"] + 1 + n).cast("int").alias("at"),
        )

    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.when(s.isNotNull(), F.aggregate(words, start, step, lambda acc: acc["text"]))


def encode(s: Column, encoding: str) -> Column:
    name = encoding.lower()
    if name == "base64":
        return F.base64(F.encode(s, "UTF-8"))
    if name == "hex":
        return F.lower(F.hex(F.encode(s, "UTF-8")))
    if name in ("utf-8", "utf8"):
        return s
    if name == "ascii":
        return F.when(is_ascii(s), s)
    raise ValueError(f"unknown encoding: {encoding}")


def decode(s: Column, encoding: str) -> Column:
    """What can't be decoded is null."""
    name = encoding.lower()
    if name == "base64":
        return F.try_to_binary(s, F.lit("base64")).cast("string")
    if name == "hex":
        return F.when(s.rlike(r"^([0-9A-Fa-f]{2})*\z"), F.unhex(s).cast("string"))
    if name in ("utf-8", "utf8"):
        return s
    if name == "ascii":
        return F.when(is_ascii(s), s)
    raise ValueError(f"unknown encoding: {encoding}")


def is_ascii(s: Column) -> Column:
    return _sure(s.rlike(r"^[\x00-\x7F]*\z"))


def is_utf8(s: Column) -> Column:
    return _sure(F.is_valid_utf8(s))


def _normalize(form: str):
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normal


def normalize_nfc(s: Column) -> Column:
    """Spark has no such function; texts go through Arrow batches."""
    return _normalize("NFC")(s)


def normalize_nfd(s: Column) -> Column:
    return _normalize("NFD")(s)
