"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: target over source
size. Within a source the documents are ordered by size, then identifier; the expected
copies are summed up along that order from one random offset, and a document is emitted
once for each integer that its step of the sum crosses. Because the order is by size, the
words taken come near the target.

The order is computed without bringing a source to one task: the narrow rows (identifier,
source, size) are range-partitioned by (source, size, identifier), sorted within their
partition, and a row's rank is its place there plus the rows of its source in earlier
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import count_words, materialise, partitions, small_side

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times over.
MOST = 3
SEED = "mix-1"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER ()::BIGINT AS total FROM s),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
    sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS above FROM o),
l AS (SELECT max(level) AS level FROM (SELECT (total - below)::DOUBLE / above AS level, ratio FROM c) WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN ratio < level THEN (3 * source_size)::DOUBLE ELSE level * w END AS target,
    ('0x' || substr(md5('mix-1' || ':' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM o, l),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS copies,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(copies * k + u) - floor(copies * (k - 1) + u)))::BIGINT AS taken FROM r
"""


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target for a table of source, source_size.

    Targets are a common level times the weight, cut off at most times the source's size;
    the level makes them add up to the sum of all sizes. It is found in one pass over the
    sources in the order in which they reach their limit: the first one that does not reach it, which has the
    highest level of those. The windows run over the sources
    alone, one row each."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).cast("long")
    o = sizes.withColumn("w", weight).withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    c = o.select(
        "*",
        F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        F.coalesce(F.sum(most * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
    ).withColumn("own", (F.col("total") - F.col("below")).cast("double") / F.col("above"))
    level = F.max(F.when(F.col("own") <= F.col("ratio"), F.col("own"))).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("ratio") < F.col("level"), (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"),
    )


def _offset(source: Column, seed: str) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """id, size, source_size, target, copies (long: times the document is emitted), taken.

    Size is the number of words; a null text has none. Null is a source of its own, the
    last. Rows without an identifier come last among those of their size. A source whose
    documents are all empty has target 0 and no copies. Rows that repeat an identifier are
    documents of their own. Other columns are ignored, whatever their names. An empty table gives an
    empty result. Reruns agree: the offset comes from the seed and the source's name.
    """
    return _plan(docs, id_col, text_col, source_col, seed, []).drop("h1", "h2")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, marks: list[Column]) -> DataFrame:
    """plan_mix, with marks (columns h1, h2), which also order rows of one size and identifier."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), *marks)
    narrow = materialise(narrow, "mix-sizes")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("id").asc_nulls_last(), *[F.col(c) for c in ("h1", "h2") if marks]]
    goal = materialise(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    ranged = (
        narrow.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place"))
    )
    ranged = materialise(ranged, "mix-order")
    runs = ranged.groupBy("pid", "source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.select("pid", "source", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "mix-runs")
    at = runs.join(goal, runs["source"].eqNullSafe(goal["source"])).select("pid", runs["source"].alias("s"), "first", "before", "source_size", "target", _offset(runs["source"], seed).alias("u"))
    # Rows of `at`: partitions plus sources.
    at = small_side(at.withColumnRenamed("pid", "at_pid"), 100_000)
    joined = ranged.join(at, (F.col("pid") == F.col("at_pid")) & F.col("source").eqNullSafe(F.col("s")))
    k = F.col("before") + F.col("place") - F.col("first") + 1
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.when(F.col("source_size") != 0, F.col("source_size")))
    times = (F.floor(copies * k + F.col("u")) - F.floor(copies * (k - 1) + F.col("u"))).cast("long")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"), *["h1", "h2"][: len(marks)])


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as plan_mix says.

    A row is found again by its identifier and two hashes of its columns (maps and variants aside), so rows without an
    identifier, or that share one, are rows of their own and never meet in one task. Rows that repeat in
    all of them share their copies; an empty table gives an empty result."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]
    marks = [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns[::-1]).alias("h2")]
    plan = _plan(docs, id_col, text_col, source_col, seed, marks).groupBy(F.col(id_col).alias("plan_id"), "h1", "h2")
    plan = materialise(plan.agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("among")), "mix-plan")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), *marks)
    keys = ["h1", "h2"]
    # The plan has a row for each document; it is never broadcast, so that all sizes run alike.
    own = rows.join(plan.hint("merge"), keys).where(F.col("row_id").eqNullSafe(F.col("plan_id"))).select("row", F.floor(F.col("total") / F.col("among")).alias("times"))
    # Of rows that repeat, what doesn't divide evenly is emitted by one of them.
    left_over = materialise(plan.where("among > 1 AND total % among > 0"), "mix-left-over")
    if not left_over.isEmpty():
        some = rows.join(small_side(left_over.select(*keys), 200_000), keys, "left_semi").groupBy(*keys, "row_id").agg(F.first("row").alias("row"))
        more = some.join(left_over, keys).where(F.col("row_id").eqNullSafe(F.col("plan_id"))).select("row", (F.col("total") % F.col("among")).alias("times"))
        own = own.unionByName(more)
    return own.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("row.*")
