"""Boilerplate lines by the number of distinct sites that they stand on.

1. Lines (trimmed, with a word) are hashed; those with fewer rows than the least number of
   sites can't be boilerplate and go no further.
2. For the others a HyperLogLog sketch of the sites is aggregated per line hash. Sketches
   merge by aggregation, so a line of any frequency is bounded memory in each task.
3. Lines whose estimate is near the threshold get an exact distinct count.
4. The texts of the hashes found are read again. Where two lines share a hash, sites are counted by the
   lines themselves, so no line goes because of another one's hash.
5. Boilerplate lines are removed from the documents. While they fit BAD_BYTES they are sent to all
   workers, and no text is shuffled; beyond that, their places are joined to the documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_WS, WS, fits, materialise, small_side

#: A line on so many sites is boilerplate. Relative distance from it within which counts are
#: exact: six standard errors (1.04 / sqrt(2 ** LG_K)) of the sketches.
SITES, LG_K = 8, 12
NEAR = 6 * 1.04 / (2**LG_K) ** 0.5
#: Boilerplate lines that are sent to the workers at most, and their bytes.
BAD_LINES, BAD_BYTES = 200_000, 8 << 20
#: White space, as in WS.
_BLANK = " \t\n\x0b\x0c\r"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('s' || source, 'null') AS site FROM documents),
l AS (SELECT rid, site, g.i, string_split(text, chr(10))[g.i] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS g(i)),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM l),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT t.*, k <> '' AS is_line, b.k IS NOT NULL AS gone FROM t LEFT JOIN b USING (k)),
o AS (SELECT rid, count(*) FILTER (is_line) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean FROM m GROUP BY rid)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256 FROM o JOIN d USING (rid)
"""


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{WS}+|{WS}+$", "")


def _key(line: Column) -> Column:
    """Hash of a trimmed line; null without a word."""
    return F.when(line.rlike(NOT_WS), F.xxhash64(_trimmed(line)))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """key of the lines (key, site: longs) that stand on at least that many distinct sites."""
    often = materialise(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("key"), "lines-often")
    seen = lines.join(small_side(often, 1_000_000), "key", "left_semi")
    spread = materialise(seen.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about")), "lines-spread")
    near = spread.where(F.abs(F.col("about") - sites) <= F.lit(max(1.0, NEAR * sites))).select("key")
    exact = seen.join(small_side(near, 1_000_000), "key", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("sites"))
    sure = spread.where(F.col("about") - sites > max(1.0, NEAR * sites)).select("key")
    return sure.unionByName(exact.where(F.col("sites") >= sites).select("key"))


def _lines_of(keys: DataFrame, base: DataFrame, sites: int) -> DataFrame:
    """line: the trimmed lines with one of the keys that stand on that many sites themselves."""
    lines = base.select("site_name", F.explode(F.split("text", "\n")).alias("raw")).select("site_name", _key(F.col("raw")).alias("key"), "raw")
    lines = lines.join(small_side(keys, 1_000_000), "key", "left_semi").select("site_name", "key", _trimmed(F.col("raw")).alias("line"))
    named = materialise(lines.select("key", "line").distinct(), "lines-named")
    shared = materialise(named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "lines-shared")
    if shared.isEmpty():
        return named.select("line")
    counted = lines.join(small_side(shared, 1_000_000), "key", "left_semi").select("line", F.struct("site_name").alias("site")).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return named.join(small_side(shared, 1_000_000), "key", "left_anti").select("line").unionByName(counted.where(F.col("n") >= sites).select("line"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """One row for each row of docs: id, text without boilerplate lines, n_lines, n_removed.

    Lines end at \\n. Lines without a word are kept and not counted. A null text counts as
    empty, a null site as a site of its own. Rows that repeat are cleaned each; a line of a text counts
    once for its site, however often it stands there. Other columns are ignored, whatever their names.
    Texts and lines of any length are whole. An empty table gives an empty result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site_name"), text.alias("text"))
    narrow = base.select(F.xxhash64("site_name").alias("site"), F.explode(F.transform(F.split("text", "\n"), _key)).alias("key")).where("key IS NOT NULL")
    narrow = materialise(narrow.select("key", "site"), "lines-keys")
    keys = materialise(boilerplate(narrow, sites), "lines-boilerplate")
    bad = materialise(_lines_of(keys, base, sites), "lines-bad")
    out = _removed_by_workers(base, bad) if fits(bad, BAD_LINES, BAD_BYTES) else _removed_by_join(base, bad)
    return out.select(F.col("id").alias(id_col), F.col("clean").alias(text_col), "n_lines", "n_removed")


def _removed_by_workers(base: DataFrame, bad: DataFrame) -> DataFrame:
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(frozenset(bad.toArrow().column(0).to_pylist())))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = pickle.loads(shared.value)
        for batch in batches:
            texts, counts, removed = [], [], []
            for value in batch.column(1):
                lines = value.as_py().split("\n")
                trimmed = [x.strip(_BLANK) for x in lines]
                kept = [x for x, t in zip(lines, trimmed, strict=True) if t not in gone]
                texts.append("\n".join(kept))
                counts.append(sum(map(bool, trimmed)))
                removed.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["id", "clean", "n_lines", "n_removed"])

    kind = base.schema["id"].dataType.simpleString()
    return base.select("id", "text").mapInArrow(cleaned, f"id {kind}, clean string, n_lines long, n_removed long")


def _removed_by_join(base: DataFrame, bad: DataFrame) -> DataFrame:
    """The same for any number of lines. Rows are told apart by two hashes of identifier and text; rows that agree
    in them have the same text, and so the same lines to lose."""
    own = [F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "id").alias("k2")]
    places = base.select(*own, F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where(F.col("raw").rlike(NOT_WS))
    hits = places.withColumn("line", _trimmed(F.col("raw"))).join(bad, "line", "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    hits = materialise(hits, "lines-hits")
    rows = base.select("id", "text", *own).join(hits, ["k1", "k2"], "left")
    lines = rows.select("id", F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    return lines.select("id", F.size(F.filter("lines", lambda x: x.rlike(NOT_WS))).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n").alias("clean"))


def digest(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_removed", F.char_length(text_col).cast("long").alias("clean_chars"), F.sha2(text_col, 256).alias("clean_sha256"))
