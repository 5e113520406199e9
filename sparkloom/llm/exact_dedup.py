"""Exact duplicates by a content sort.

Sampled splitters range-partition the normalised texts, an external sort in each
partition places equal texts next to each other, and each row is compared in full with
its neighbour: a run of equal neighbours is a group, and its smallest identifier stays.

Skew: a text that has more rows than half a partition is cut into pieces by its
identifier's hash, so that the pieces are sorted in different partitions. At most twice as
many texts as partitions can be that frequent, so what is known about them (row count,
smallest identifier) is gathered with map-side aggregation and joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, partitions, single_spaced

ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    With carry, a struct column `row` holds the input row. Other input columns may have
    any name; they never clash. Texts are equal when identical after each run of white
    space became one space. A null text counts as empty; a row without an identifier sorts
    last and stays only if its group has no other. Of rows that repeat both text and
    identifier exactly one is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    norm = single_spaced(F.col("text"))
    carried = [F.struct("*").alias("row")] if carry else []
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *carried)
    keyed = keyed.withColumn("h", F.xxhash64(norm)).withColumn("head", F.substring(norm, 1, 48))

    rows = docs.count()
    most = max(2, rows // (2 * p))  # so at most 2 * p texts are frequent
    hot = keyed.groupBy("h").count().where(F.col("count") > most).select("h", F.ceil(F.col("count") / most).cast("int").alias("pieces"))
    hot = materialise(hot, "dedup-frequent")
    frequent = not hot.isEmpty()
    if frequent:
        known = (
            keyed.select("id", norm.alias("norm"), "h").join(F.broadcast(hot.select("h")), "h", "left_semi")
            .groupBy("norm").agg(F.min("id").alias("hot_id"), F.count(F.lit(1)).alias("hot_n"))
            .select(F.sha2("norm", 256).alias("sha"), "hot_id", "hot_n")
        )
        piece = F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.lit(0))
        keyed = keyed.join(F.broadcast(hot), "h", "left").withColumn("piece", piece)
    else:
        known = None

    # Splitters are sampled from the first characters and the hash, so they stay short; the
    # sort below goes on with the whole text, which is only normalised again after the exchange.
    split = ["head", "h", "piece"] if frequent else ["head", "h"]
    text = F.col(f"row.`{text_col}`").cast("string") if carry else F.col("text")
    placed = (keyed.drop("text") if carry else keyed).repartitionByRange(p, *split)
    placed = placed.withColumn("norm", single_spaced(text))
    run = Window.partitionBy(*split, "norm")
    marked = placed.select(
        "*",
        F.row_number().over(run.orderBy(F.col("id").asc_nulls_last())).alias("nth"),
        F.min("id").over(run).alias("least"),
        F.count(F.lit(1)).over(run).alias("n"),
    ).withColumn("sha", F.sha2("norm", 256)).drop("norm", "head", "text")
    if known is not None:
        marked = marked.join(F.broadcast(known), "sha", "left")
        least, n = F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).otherwise(F.col("least")), F.coalesce("hot_n", "n")
    else:
        least, n = F.col("least"), F.col("n")
    return marked.select(
        F.col("id").alias(id_col),
        least.alias("keep_id"),
        n.cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(least) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns of docs."""
    return content_sort(docs, id_col, text_col, carry=True).where("kept").select("row.*")
