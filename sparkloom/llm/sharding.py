"""Sharding by a minimax contiguous partition.

Documents with equal texts are one atomic group. The groups stand in the order of their
texts' SHA-256. The smallest capacity is sought at which a greedy pass over that order needs
no more than the given number of shards, and the order is cut where that pass cuts it.

The groups stay distributed: their sizes are summed up along a range partition by hash. The
driver searches on bounds: it knows the ends of some groups (4,096 cells a round at most) and
that between two known ends further ends may lie or not. A capacity that is feasible when
every cut falls back to a known end is feasible; one that is infeasible when cuts may fall
anywhere in the open gaps is infeasible. What stays undecided is looked at again in the
gaps that the cuts may fall into, until the bounds meet and no cut lies in an open gap.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, partitions, small_side

SHARDS, CELLS = 16, 4096

# In SQL: prefix sums of the groups; a search whose state is the bounds, the capacity tried, and how far the greedy pass
# with it came; the cuts of that pass at the smallest capacity. Checksums are reduced byte by byte over a table.
ORACLE = rf"""
WITH RECURSIVE bits(b, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL SELECT b, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS key, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents),
crc AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS crc
  FROM (SELECT rid, size, hex(encode(text)) AS h FROM d), tab),
g AS (SELECT key, sum(size)::BIGINT AS bytes FROM d GROUP BY key),
o AS (SELECT key, bytes, sum(bytes) OVER (ORDER BY key)::BIGINT AS stop FROM g),
e AS (SELECT list_prepend(0, list(stop ORDER BY stop)) AS ends, max(stop) AS total, max(bytes) AS biggest FROM o),
search(lo, hi, pos, used) AS (
  SELECT greatest((total + {SHARDS - 1}) // {SHARDS}, biggest)::BIGINT, (greatest((total + {SHARDS - 1}) // {SHARDS}, biggest) + biggest)::BIGINT, 0::BIGINT, 0 FROM e
  UNION ALL
  SELECT CASE WHEN nxt < total AND used = {SHARDS - 1} THEN mid + 1 ELSE lo END, CASE WHEN nxt = total THEN mid ELSE hi END, CASE WHEN nxt = total OR used = {SHARDS - 1} THEN 0 ELSE nxt END, CASE WHEN nxt = total OR used = {SHARDS - 1} THEN 0 ELSE used + 1 END
  FROM (SELECT lo, hi, used, total, (lo + hi) // 2 AS mid, list_max(list_filter(ends, lambda x: x <= pos + (lo + hi) // 2)) AS nxt FROM search, e WHERE lo < hi)),
cap AS (SELECT lo AS c FROM search WHERE lo >= hi),
cuts(j, start, stop) AS (
  SELECT 0, 0::BIGINT, list_max(list_filter(ends, lambda x: x <= c)) FROM e, cap
  UNION ALL SELECT j + 1, stop, list_max(list_filter(ends, lambda x: x <= stop + c)) FROM cuts, e, cap WHERE j < {SHARDS - 1})
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, j::INTEGER AS shard, row_number() OVER (PARTITION BY j ORDER BY key, doc_id NULLS LAST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN crc USING (rid) JOIN o USING (key) JOIN cuts ON o.stop > cuts.start AND o.stop <= cuts.stop
"""


class Ends:
    """What is known of the ends of groups on the line from 0 to total: some ends, and
    between which neighbours of them further ends may lie (open)."""

    def __init__(self, total: int):
        self.points, self.open = [0, total], [True]

    def at_least(self, x: int) -> int:
        """The last end at or below x is not before this, a known end."""
        return self.points[bisect_right(self.points, x) - 1]

    def at_most(self, x: int) -> int:
        """The last end at or below x is not after this."""
        i = bisect_right(self.points, x) - 1
        return x if i < len(self.open) and self.open[i] else self.points[i]

    def path(self, capacity: int, shards: int, last_end: Callable[[int], int]) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(last_end(min(out[-1] + capacity, self.points[-1])))
        return out

    def fits(self, capacity: int, shards: int, last_end: Callable[[int], int]) -> bool:
        return self.path(capacity, shards, last_end)[-1] == self.points[-1]

    def open_between(self, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        found = {}
        for left, right in windows:
            i = max(0, bisect_right(self.points, left) - 1)
            while i < len(self.open) and self.points[i] <= right:
                if self.open[i]:
                    found[self.points[i]] = self.points[i + 1]
                i += 1
        return sorted(found.items())

    def refine(self, spans: list[tuple[int, int]], cells: dict[int, list[tuple[int, int, int]]]) -> None:
        """spans: open neighbours; cells: by span, first and last end and their number, for each cell that has ends within."""
        right_of = dict(spans)
        number = {left: i for i, (left, _) in enumerate(spans)}
        points, opened = [0], []
        for left, right, was in zip(self.points, self.points[1:], self.open, strict=False):
            if right_of.get(left) == right:
                for first, last, n in sorted(cells.get(number[left], [])):
                    points.append(first)
                    opened.append(False)
                    if last > first:
                        points.append(last)
                        opened.append(n > 2)
                was = False
            points.append(right)
            opened.append(was)
        self.points, self.open = points, opened


def smallest_capacity(total: int, biggest: int, shards: int, look: Callable[[list[tuple[int, int]], int], dict]) -> list[int]:
    """Ends of the shards (0 first) of the greedy pass at the smallest feasible capacity.

    look(spans, m) cuts each span into m cells and tells the ends in them."""
    ends = Ends(total)
    low = max(-(-total // shards), biggest)
    high = low + biggest
    while True:
        high = _first(lambda c: ends.fits(c, shards, ends.at_least), low, high)
        low = _first(lambda c: ends.fits(c, shards, ends.at_most), low, high)
        first, last = ends.path(low, shards, ends.at_least), ends.path(high, shards, ends.at_most)
        if low == high and first == last:
            return first
        spans = ends.open_between(list(zip(first, last, strict=True)))
        ends.refine(spans, look(spans, max(2, CELLS // len(spans))))


def _first(test: Callable[[int], bool], low: int, high: int) -> int:
    """The least number from low to high that passes, if high does or is taken to."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if test(mid) else (mid + 1, high)
    return low


def _looker(ends: DataFrame) -> Callable[[list[tuple[int, int]], int], dict]:
    def look(spans: list[tuple[int, int]], m: int) -> dict:
        lefts, rights = (np.array(x, np.int64) for x in zip(*spans, strict=True))

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                e = pdf["end"].to_numpy()
                i = np.searchsorted(lefts, e, "left") - 1
                e, i = e[i >= 0], i[i >= 0]
                inside = e < rights[i]
                e, i = e[inside], i[inside]
                cell = ((e - lefts[i]).astype(object) * m // (rights[i] - lefts[i])).astype(np.int64)
                yield pd.DataFrame({"span": i, "cell": cell, "end": e}).groupby(["span", "cell"])["end"].agg(["min", "max", "count"]).reset_index()

        rows = (
            ends.where(F.col("end").between(int(lefts[0]), int(rights[-1]))).select("end")
            .mapInPandas(cells, "span long, cell long, min long, max long, count long")
            .groupBy("span", "cell").agg(F.min("min").alias("a"), F.max("max").alias("b"), F.sum("count").alias("n"))
        )
        out: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows.collect():  # CELLS rows, or two for each span
            out.setdefault(r["span"], []).append((r["a"], r["b"], r["n"]))
        return out

    return look


def _running(df: DataFrame, keys: list[str], sums: dict[str, str], tag: str) -> DataFrame:
    """df range-partitioned and sorted by keys, with running sums of columns along that order
    (name: column) and the row's rank from 0. Sums within a range partition are added to those
    of the partitions before it, a row for each of which is broadcast."""
    p = partitions(df.sparkSession)
    placed = df.repartitionByRange(p, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place"))
    placed = materialise(placed, tag)
    totals = placed.groupBy("pid").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("pid", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums])
    out = placed.join(small_side(base, 100_000), "pid").withColumn("rank", F.col("rows_before") + F.col("place") - F.col("first"))
    if sums:
        so_far = Window.partitionBy("pid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        out = out.select("*", *[(F.col(f"before_{n}") + F.sum(c).over(so_far)).alias(n) for n, c in sums.items()])
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Null counts as the empty text: size 1, checksum 0. Equal texts always share a shard,
    however many they are; with fewer groups than shards, or one group larger than the even
    share, later shards may stay empty. Slots follow the hash of the text, then the
    identifier, rows without one last; rows that repeat both get slots of their own in no
    particular order. An empty table gives an empty result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    narrow = materialise(narrow, "shard-sizes")
    groups = narrow.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    ends = _running(groups, ["text_key"], {"end": "bytes", "end_rows": "n"}, "shard-groups").select("end", "end_rows", "bytes")
    ends = materialise(ends, "shard-ends")
    total, biggest = ends.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.max("bytes")).first()
    starts = [0]
    if total:
        path = smallest_capacity(total, biggest, shards, _looker(ends))
        rows = dict(ends.where(F.col("end").isin(path)).select("end", "end_rows").collect())  # a row for each shard
        starts = [0] + [rows.get(e, 0) for e in path[1:]]
    ranked = _running(narrow.select("id", "size", "crc", "text_key"), ["text_key", "id"], {}, "shard-order")
    # starts[j]: rank of the first row of shard j; an empty shard starts where the next does.
    number = F.lit(-1)
    first = F.lit(0)
    for j, start in enumerate(starts[:shards]):
        number = F.when(F.col("rank") >= start, F.lit(j)).otherwise(number) if j == 0 or start > starts[j - 1] else number
        first = F.when(F.col("rank") >= start, F.lit(start)).otherwise(first)
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        number.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
