import functools
import random
import zlib

from pyspark.sql import functions as F

from corpusloom.llm import sharding


def test_cuts_are_minimax():
    @functools.cache
    def best(sizes, n):
        return sum(sizes) if n == 1 else min(max(sum(sizes[:j]), best(sizes[j:], n - 1)) for j in range(len(sizes) + 1))

    r = random.Random(0)
    for _ in range(400):
        sizes, n = [r.choice([1, 2, 5, 9, 40]) for _ in range(r.randint(1, 9))], r.randint(1, 5)
        capacity, cuts = sharding.minimax_cuts(sizes, n)
        assert capacity == best(tuple(sizes), n)
        edges = [0, *cuts, len(sizes)]
        assert edges == sorted(edges) and all(sum(sizes[a:b]) <= capacity for a, b in zip(edges, edges[1:], strict=False))
    assert sharding.minimax_cuts([], 4) == (0, [])


def test_rows(odd, empty):
    got = sharding.shard_by_bytes(odd, 4).collect()
    assert len(got) == odd.count()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    homes = {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 4 and r.grown_shard is None
        assert homes.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty).count() == 0


def best_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, need, room = (low + high) // 2, 1, 0
        room = c
        for x in sizes:
            if x > room:
                need, room = need + 1, c
            room -= x
        low, high = (low, c) if need <= n else (c + 1, high)
    return low


def test_few_ranges_and_many_groups(spark):
    """Ranges are divided where cuts may fall, so the capacity is that over all groups, hot ones and large ones too."""
    r = random.Random(7)
    for case in range(3):
        texts = ["x" * (r.randint(1, 60) if case < 2 else r.choice([3, 900])) + str(i) for i in range(700)]
        texts += [texts[5]] * (300 if case == 1 else 3)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        groups = df.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
        rows = sorted(map(tuple, groups.collect()))
        want = best_capacity([b for _, b in rows], 6)
        capacity, ranges = sharding.refined(groups, 6, 2, 3)
        assert capacity == want and len(ranges) < len(rows)
        got = sharding.shard_by_bytes(df, 6, bits=2, more=3).collect()
        sums, homes = {}, {}
        for x in got:
            sums[x.shard] = sums.get(x.shard, 0) + x["size"]
            homes.setdefault((x.text_crc32, x["size"]), set()).add(x.shard)
        assert max(sums.values()) <= want and len(sums) == 6 and all(len(h) == 1 for h in homes.values())
        if case == 0:
            assert max(sums.values()) - min(sums.values()) <= 130  # two groups
        for s in sums:
            assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
