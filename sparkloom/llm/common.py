"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import discard, fits, materialise, small_side

__all__ = ["NOT_WS", "WS", "count_words", "discard", "fits", "materialise", "partitions", "single_spaced", "small_side"]

#: White space of every word rule here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def single_spaced(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty.

    Plain replacements do nearly all of the work; the regular expression only runs on
    texts that have two spaces in a row."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t)


def count_words(text: Column) -> Column:
    """Number of runs of other characters than white space; null has none."""
    t = F.trim(single_spaced(text))
    return F.when(t == "", F.lit(0)).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")
