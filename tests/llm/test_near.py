"""Near duplicates against brute force: every pair of sets is compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import near_dedup
from sparkloom.llm.shingles import OnePermutation, prefix, stream


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    """component of each identifier; rows: (identifier, text), identifiers may repeat."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = {}
    for at, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(at)
    for at, (i, s) in enumerate(sets):
        common = {}
        for g in s:
            for other in index[g]:
                if other < at:
                    common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[other][1]) - n):
                x, y = find(i), find(sets[other][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def check(spark, rows, kind="long"):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    want = brute_force(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(shingles(t)), want[i], want[i] == i) for i, t in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_small_sets_lose_no_link():
    """Pairs at similarity 0.75 exactly, of all sizes that have exact keys."""
    values, at, hasher = stream(4_000_000, 5), 0, OnePermutation()
    tried = 0
    for size in range(3, 61, 3):
        for extra in {0, size // 6, size // 3}:
            for _ in range(60):
                v = values[at : at + size + size // 3]
                at += len(v)
                a, b = v[: size + extra], [*v[:size], *v[size + extra :]]
                sets = [sorted(x) for x in (a, b)]
                keys = []
                for s in sets:
                    s = np.array(s, np.uint64)
                    own = set(prefix(s).tolist()) if len(s) <= near_dedup.EXACT else set()
                    if 100 * len(s) > 75 * near_dedup.EXACT:
                        own |= set(hasher.keys(hasher.signature(s)).tolist())
                    keys.append(own)
                exact = min(map(len, sets)) <= 48
                assert keys[0] & keys[1] or not exact, (size, extra)
                tried += 1
    assert tried > 3000


def test_short_texts_through_the_operator(spark):
    deal = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"w{i}x{j}" for j in range(deal.randint(7, 16))]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[:-1]) if i % 2 else " ".join([*words, "more"])))
    check(spark, rows)


def test_repeated_identifiers_and_text_identifiers(spark):
    base = " ".join(f"a{j}" for j in range(40))
    other = " ".join(f"b{j}" for j in range(40))
    third = " ".join(f"c{j}" for j in range(40))
    rows = [(2, base), (5, base), (5, other), (3, other), (9, third), (9, third), (8, third + " x"), (4, base + " y"), (11, None), (11, "one")]
    check(spark, rows)
    check(spark, [(f"d{i:02}", t) for i, t in rows], "string")


def test_large_stars_and_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HEAVY", 5)
    deal = random.Random(7)
    base = [f"b{j}" for j in range(90)]
    rows = [(i, " ".join(base)) for i in range(1200)]
    for i in range(1200, 1500):
        words = list(base)
        for _ in range(deal.randint(0, 4)):
            words[deal.randrange(90)] = f"e{deal.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, "") for i in range(1100)]
    check(spark, rows)
    nameless = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    got = near_dedup.near_duplicates(nameless)
    assert got.where("doc_id IS NULL AND component_id IS NULL AND kept").count() == sum(i % 2 for i, _ in rows)


def test_no_links_at_all(spark):
    check(spark, [(i, f"all {i} of {i} these {i} texts {i} differ {i}") for i in range(20)])

def test_rounds_do_not_read_the_table_again(spark, monkeypatch):
    """The table is read for the features, the stars and the texts of open buckets, however many rounds follow."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "PAIRS", 0)
    monkeypatch.setattr(near_dedup, "DEEPEST", 3)
    deal = random.Random(3)
    base = [f"b{j}" for j in range(200)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in deal.sample(range(200), 9 + i % 3):
            words[at] = f"e{deal.randint(0, 6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"all {i} of {i} these {i} texts {i} differ {i}") for i in range(60)]
    written, read = [], spark.sparkContext.accumulator(0)
    note = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, tag: written.append(tag) or note(df, tag))

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_force(rows)
    assert "near-2-finer" in written
    assert read.value <= 4 * len(rows), read.value / len(rows)
