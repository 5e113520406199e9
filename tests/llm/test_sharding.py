import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

from sparkloom.llm import sharding


def brute(sizes, shards):
    def greedy(cap):
        out, room = [0], cap
        at = 0
        for s in sizes:
            if s > cap:
                return None
            if at + s - out[-1] > cap:
                out.append(at)
            at += s
        out.append(at)
        return out if len(out) <= shards + 1 else None

    lo, hi = 1, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(mid) else (mid + 1, hi)
    return lo


def test_smallest_capacity_against_brute_force(monkeypatch):
    rng = random.Random(5)
    for case in range(60):
        monkeypatch.setattr(sharding, "CELLS", rng.choice([2, 8, 64]))
        sizes = [rng.choice([1, 2, 5, rng.randint(1, 900)]) for _ in range(rng.randint(1, 400))]
        if case % 5 == 0:
            sizes[len(sizes) // 2] = 50_000
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append(at)

        def look(spans, m):
            out = defaultdict(dict)
            for i, (a, b) in enumerate(spans):
                for e in ends[bisect_right(ends, a) :]:
                    if e >= b:
                        break
                    out[i].setdefault((e - a) * m // (b - a), []).append(e)
            return {i: [(x[0], x[-1], len(x)) for x in c.values()] for i, c in out.items()}

        shards = rng.choice([1, 3, 16])
        path = sharding.smallest_capacity(ends[-1], max(sizes), shards, look)
        assert path[-1] == ends[-1] and set(path) <= {0, *ends}
        assert max(b - a for a, b in zip(path, path[1:], strict=False)) == brute(sizes, shards)


def test_groups_slots_and_null(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["same text", f"text {i} " * rng.randint(1, 60), None, ""])) for i in range(900)] + [(None, "x"), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df).collect()
    assert len(got) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = defaultdict(set)
    for r in got:
        of[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string, shard int")).count() == 0
