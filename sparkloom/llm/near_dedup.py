"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Features: each whole text's 5-word shingle set is hashed in numpy; what leaves the task is
   the set's size and digest, 40 bucket keys of 5 bins and, of large sets, a sketch of a byte for each bin.
   Sets of at most EXACT shingles, which fill few bins, have exact keys instead, or as well (`prefix`).
2. Equal sets (one digest) are one class from here on, represented by its least identifier.
3. In each bucket, candidates are the edges from one member, the centre, to the others: a star,
   so that a bucket of any size gives as many pairs as members. The centre is the member that
   has most neighbours over all its buckets.
4. Candidates are confirmed on the full sets, computed again from the texts. Connected
   components of the links follow; later links join components found before.
5. Buckets that still hold several components are open. In small ones all pairs of members of
   different components are confirmed. For a large one with a reference c, a pair a, b either shares a
   shingle that c has not, or has no more in common than each has with c, which bounds its
   similarity. So pairs whose bound reaches the threshold are confirmed, and for the others the
   shingles that c has not become the keys of new, finer buckets, which go through 3 to 5 again.

So the stars lose no link that a bucket holds. Two sets at similarity s of which one has at most
48 shingles always share a bucket; larger ones do with probability 1 - (1 - s**5)**40: 0.99998 at 0.75,
the least that counts as a link.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, materialise, partitions, small_side
from sparkloom.llm.shingles import OnePermutation, Shingler, prefix, resemble

WIDTH, PERCENT, BANDS, ROWS = 5, 75, 40, 5
#: Sets of at most so many shingles have exact keys. Where the smaller of two alike sets has at most PERCENT % of that,
#: the larger has exact keys as well; only sets above that have bands.
EXACT = 64
#: Sketches refute a pair if fewer than this share of bins agree; only sets of at least so many
#: shingles are refuted, where the share at similarity 0.75 is 5 standard deviations above.
SKETCH_SHARE, SKETCH_LEAST = 0.6, 400
#: Open buckets of at most so many members have all their pairs confirmed. Larger ones are refined until they
#: have, all together, no more than PAIRS pairs of different components for each class; then theirs are confirmed too. Buckets shrink with each
#: refinement; DEEPEST only ends a chain of them that doesn't.
SMALL, PAIRS, DEEPEST = 48, 1, 16
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * n >= 75 * (na + nb - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = id
"""

#: Pairs of one document, at least, from which on its text goes to several tasks.
HEAVY = 20_000


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, hasher = Shingler(WIDTH), OnePermutation(BANDS, ROWS)
    for batch in batches:
        sizes, digests, keys, sketches = [], [], [], []
        for text in batch.column(1):
            s = shingler(text.as_py())
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            own = [prefix(s, PERCENT)] if len(s) <= EXACT else []
            sketch = None
            if 100 * len(s) > PERCENT * EXACT:
                sig = hasher.signature(s)
                own.append(hasher.keys(sig))
                if len(s) >= SKETCH_LEAST:
                    sketch = (sig & np.uint64(255)).astype(np.uint8).tobytes()
            keys.append(np.concatenate(own) if len(s) else None)
            sketches.append(sketch)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["id", "n", "digest", "keys", "sketch"],
        )


def _sketch_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
        keep = (a == b).mean(axis=1) >= SKETCH_SHARE if batch.num_rows else np.empty(0, bool)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Sets:
    """Shingle sets of the last few texts."""

    def __init__(self):
        self.shingler, self.recent = Shingler(WIDTH), OrderedDict()

    def __call__(self, text: str) -> np.ndarray:
        if text not in self.recent:
            self.recent[text] = self.shingler(text)
            if len(self.recent) > 16:
                self.recent.popitem(last=False)
        return self.recent[text]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        keep = [resemble(sets(a.as_py()), sets(b.as_py()), PERCENT) for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For reference a and member b: the size of b and of what they share, and b's other shingles.

    A link of b shares at least PERCENT of b's shingles; if that is more than the reference has,
    the rest must be among the others. Then the last ones of the others can be left out: two
    sets that share t elements share one of their first |set| - t + 1."""
    sets = _Sets()
    for batch in batches:
        sizes, common, others = [], [], []
        for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            rest = np.setdiff1d(y := sets(b.as_py()), sets(a.as_py()), assume_unique=True)
            sizes.append(len(y))
            common.append(len(y) - len(rest))
            must = max(1, -(-PERCENT * len(y) // 100) - common[-1])
            others.append(rest[: max(0, len(rest) - must + 1)].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names=["a", "b", "n", "common", "others"]
        )


def _texts_of(wanted: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """The rows of docs whose identifiers are wanted, written: docs is read once, however often they are used."""
    wanted = materialise(wanted, f"{tag}-wanted")
    texts = materialise(docs.join(small_side(wanted, 1_000_000), F.col("id") == F.col("wanted"), "left_semi"), f"{tag}-texts")
    discard(wanted)
    return texts


def _with_texts(pairs: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """pairs (a written table) with text_a and text_b. A document of very many pairs, such as the centre of a
    large star, has its text sent to several tasks, each of which takes a part of the pairs."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), f"{tag}-wanted")
    texts = docs.join(small_side(wanted, 1_000_000), F.col("id") == F.col("wanted"), "left_semi")
    rows = pairs.count()
    most = max(HEAVY, rows // (4 * partitions(docs.sparkSession)))
    out = pairs
    for x, other in (("a", "b"), ("b", "a")):
        side = texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
        heavy = None
        if rows > most:
            heavy = materialise(pairs.groupBy(x).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1"), f"{tag}-heavy")
        if heavy is None or heavy.isEmpty():
            out = out.join(side, x)
            continue
        heavy = F.broadcast(heavy)  # rows / most at most
        part = F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"), F.lit(0))
        dealt = out.join(heavy, x, "left").withColumn("part", part).drop("parts")
        copied = side.join(heavy, x, "left").select(x, f"text_{x}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
        out = dealt.join(copied, [x, "part"]).drop("part")
    return out


def _links(pairs: DataFrame, feats: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """Those of the pairs a, b, n (size of the smaller set) of class representatives that are links."""
    side = lambda x: feats.where(F.col("n") >= SKETCH_LEAST).select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    kind = docs.schema["id"].dataType.simpleString()
    large = pairs.where(F.col("n") >= SKETCH_LEAST).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    near = pairs.where(F.col("n") < SKETCH_LEAST).select("a", "b").unionByName(large.mapInArrow(_sketch_filter, f"a {kind}, b {kind}"))
    near = materialise(near, f"{tag}-candidates")
    return materialise(_with_texts(near, docs, tag).mapInArrow(_confirm, f"a {kind}, b {kind}").distinct(), f"{tag}-links")


def components(links: DataFrame) -> DataFrame:
    """id, component (the least identifier reachable) of all ends of links a, b.

    Each round hooks every vertex and its root to the least root among its neighbours, then
    halves the paths; rounds grow as the logarithm of the longest path. Sums are partial
    aggregates and joins are on keys that adaptive execution can split."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.distinct(), "edges")
    state = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = edges.join(state, edges["b"] == state["id"]).groupBy("a").agg(F.min("root").alias("least"))
        met = state.join(near, state["id"] == near["a"]).select("id", "root", "least")
        told = met.select(F.explode(F.array(F.struct("id", "root"), F.struct("id", F.col("least").alias("root")), F.struct(F.col("root").alias("id"), F.col("least").alias("root")))).alias("t"))
        hooked = materialise(told.groupBy("t.id").agg(F.min("t.root").alias("root")), "hooks")
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("above"))
        fresh = materialise(hooked.join(up, "root").select("id", F.least("root", "above").alias("root")), "roots")
        changed = fresh.join(state.withColumnRenamed("root", "old"), "id").where("root <> old")
        if changed.isEmpty():
            return fresh.select("id", F.col("root").alias("component"))
        state = fresh


def _alike(n: Column, m: Column) -> Column:
    """Sets of such sizes can be linked."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _cross(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs a < b of members of different components of a bucket whose sizes allow a link."""
    other = right.select("key", *[F.col(c).alias(f"{c}_x") for c in right.columns if c != "key"])
    apart = (F.col("id") < F.col("id_x")) & (F.col("component") != F.col("component_x")) & _alike(F.col("n"), F.col("n_x"))
    return left.join(other, "key").where(apart & condition).select(F.col("id").alias("a"), F.col("id_x").alias("b"), F.least("n", "n_x").alias("n"))


def _connect(found: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """found (id, component, or None) with new links: they are links between components, so only what they touch
    is looked at again."""
    if links.isEmpty():
        return found
    if found is None:
        return components(links)
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    ends = materialise(ends.where("a <> b").distinct(), "contracted")
    if ends.isEmpty():
        return found
    above = components(ends)
    moved = found.join(above.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return materialise(moved.unionByName(above.join(found.select("id"), "id", "left_anti")), "connected")


def _test(pairs: DataFrame, tested: DataFrame | None, feats: DataFrame, docs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """The links among those of the pairs that weren't tested yet, and all pairs tested."""
    fresh = pairs.distinct()
    if tested is not None:
        fresh = fresh.join(tested, ["a", "b"], "left_anti")
    fresh = materialise(fresh, f"{tag}-fresh")
    links = fresh.select("a", "b").limit(0) if fresh.isEmpty() else _links(fresh, feats, docs, tag)
    return links, fresh.select("a", "b") if tested is None else tested.unionByName(fresh.select("a", "b"))


def _shared_identifiers(real: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links a, b between the classes of a document that has several texts, as its identifier repeats; None without
    such documents."""
    code = F.xxhash64("digest")
    several = real.groupBy("id").agg(F.min(code).alias("low"), F.max(code).alias("high")).where("low <> high").select("id")
    several = materialise(several, "near-several")
    if several.isEmpty():
        return None
    own = real.select("id", "digest").join(small_side(several, 200_000), "id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest").select("id", "rep")
    own = materialise(own, "near-several-classes")
    return own.join(own.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()


def _of_classes(feats: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n, component for each row of feats, of classes (digest, rows, component). Rows without an identifier or
    without shingles take no part in the join and have no component. What is known of sets with more rows than half a
    partition is broadcast; there can be two for each partition at most."""
    real, alone = feats.where("digest IS NOT NULL AND id IS NOT NULL").select("id", "n", "digest"), feats.where("digest IS NULL OR id IS NULL")
    most = max(1000, feats.count() // (2 * partitions(feats.sparkSession)))
    hot = classes.where(F.col("rows") > most).select("digest", F.col("component").alias("hot"))
    marked = real.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("hot IS NULL").select("id", "n", "digest").join(classes.where(F.col("rows") <= most).select("digest", "component"), "digest")
    out = [alone.select("id", "n", F.lit(None).cast(feats.schema["id"].dataType).alias("component")), marked.where("hot IS NOT NULL").select("id", "n", F.col("hot").alias("component")), rest.select("id", "n", "component")]
    return reduce(DataFrame.unionByName, out)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Texts without words (null or empty ones too) have no shingles and no links. Rows that
    repeat an identifier are one document with the links of all its texts. Rows without an
    identifier have no links, a null component_id, and stay. Identifiers may be of any type with an order.
    Texts of any length are whole. Other columns are ignored; an empty table gives an empty result."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    feats = materialise(docs.mapInArrow(_features, f"id {kind}, n long, digest binary, keys array<long>, sketch binary"), "near-features")
    real = feats.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = real.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes, "near-digests")
    known = real.select("id", "n", "digest", "keys", "sketch").join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    known = materialise(known, "near-classes")
    if known.count() > classes.count():  # repeated rows, or several texts of an identifier
        known = materialise(known.dropDuplicates(["id", "digest"]), "near-distinct")
    known = known.drop("digest")
    most_pairs = PAIRS * classes.count()

    tested, texts = None, docs
    same = _shared_identifiers(real, classes)
    found = None if same is None else _connect(None, same)
    component = lambda x: F.coalesce(f"of_{x}", x)
    rows = known.select("id", "n", F.explode("keys").alias("key"))
    depth = 0
    while rows is not None:
        depth += 1
        tag = f"near-{depth}"
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = buckets = materialise(rows.join(sizes, "key"), f"{tag}-buckets")
        entered = rows if depth > 1 else None
        weight = shared.groupBy("id").agg(((F.sum("size") - F.count(F.lit(1))) * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("weight"))
        centres = shared.join(weight, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), "weight").alias("c"))
        shared = materialise(shared.join(centres.select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("n_centre")), "key"), f"{tag}-stars")
        stars = shared.where((F.col("id") != F.col("centre")) & _alike(F.col("n"), F.col("n_centre")))
        if found is not None:  # finer buckets: only what isn't connected yet
            of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
            stars = stars.join(of("id"), "id", "left").join(of("centre"), "centre", "left").where(component("id") != component("centre"))
        stars = stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), F.least("n", "n_centre").alias("n"))
        links, tested = _test(stars, tested, known, texts, f"{tag}-star")
        found = _connect(found, links)

        at = shared.where("size > 2")
        at = at.withColumn("component", F.col("id")) if found is None else at.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        at = materialise(at, f"{tag}-placed")
        mixed = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        opened = materialise(at.join(mixed, "key"), f"{tag}-open")
        if opened.isEmpty():
            discard(entered, buckets, shared, at, opened)
            break
        # All that is still compared, in this round and the next ones, are members of these buckets. So their texts are
        # written, and no round reads the whole table again.
        whole_texts, texts = texts, _texts_of(opened.select(F.col("id").alias("wanted")).distinct(), texts, f"{tag}-open")
        parts = opened.where(F.col("size") > SMALL).groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        parts = parts.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("within"))
        in_large = parts.agg(F.sum((F.col("m") * F.col("m") - F.col("within")) / 2)).first()[0] or 0
        whole = F.lit(depth >= DEEPEST or in_large <= most_pairs) | (F.col("size") <= SMALL)
        small = opened.where(whole)
        pairs = _cross(small, small, F.lit(True))
        large = opened.where(~whole)
        rows = None
        if not large.isEmpty():
            # The bound holds for any reference. At first neighbouring buckets take one, the weightiest centre of
            # all the buckets that their members are in. Finer buckets take their own centre: it has the shingle that
            # the bucket stands for, so what its members share besides gets less with each round.
            if depth == 1:
                heavy = weight.select(F.col("id").alias("centre"), F.col("weight").alias("heft"))
                best = large.join(heavy, "centre").groupBy("id").agg(F.max(F.struct("heft", "centre")).alias("best"))
                shared_ref = large.join(best, "id").groupBy("key").agg(F.max("best").alias("best")).select("key", F.col("best.centre").alias("reference"))
                large = large.join(shared_ref, "key")
            else:
                large = large.withColumn("reference", F.col("centre"))
            large = materialise(large, f"{tag}-large")
            apart = materialise(large.select(F.col("reference").alias("a"), F.col("id").alias("b")).distinct(), f"{tag}-references")
            apart = materialise(_with_texts(apart, texts, f"{tag}-apart").mapInArrow(_differences, f"a {kind}, b {kind}, n long, common long, others array<long>"), f"{tag}-apart")
            measured = apart.groupBy(F.col("a").alias("reference"), F.col("b").alias("id")).agg(F.max("common").alias("common"))
            # A pair's bound only reaches the threshold if each has that share of itself in common with the reference.
            spread = large.join(measured, ["reference", "id"]).where(100 * F.col("common") >= PERCENT * F.col("n"))
            least = F.least("common", "common_x")
            pairs = pairs.unionByName(_cross(spread, spread, 100 * least >= PERCENT * (F.col("n") + F.col("n_x") - least)))
            finer = apart.select("a", F.col("b").alias("id"), "n", F.explode("others").alias("shingle"))
            rows = materialise(finer.select("id", "n", F.xxhash64("a", "shingle").alias("key")).distinct(), f"{tag}-finer")
            done = [large, apart]
        else:
            done = []
        links, tested = _test(pairs, tested, known, texts, f"{tag}-rest")
        found = _connect(found, links)
        discard(entered, buckets, shared, at, opened, whole_texts, *done)
    discard(texts)

    known_as = classes.withColumn("component", F.col("rep")) if found is None else classes.join(found, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep"))
    known_as = materialise(known_as.select("digest", "rows", "component"), "near-components")
    out = _of_classes(feats, known_as).withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("gone_id")).distinct()
    gone = materialise(gone, "near-gone")
    return docs.join(small_side(gone, 1_000_000), F.col(id_col) == F.col("gone_id"), "left_anti")
