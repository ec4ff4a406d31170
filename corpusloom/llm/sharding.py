"""Minimax contiguous sharding by bytes, with DataFrame operations only.

Equal texts are one atomic group, named by the 64-bit hash of the text, and groups are ordered by it. The driver does not
see groups but the sums of ranges of hashes, `cells` at first. A range with one group is an atom; one with more may be cut
inside. So the smallest capacity lies between that of a greedy walk that may cut anywhere in such ranges and that of one
that may not, and only the ranges in which a cut of any capacity between them may fall are divided, by the next bits of
the hash, until those hold single groups: then the smallest capacity found by binary search, each step checked by a greedy
walk, is that over all groups. The cuts are made at that capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import parquet, text_or_empty, written


#: Windows of about equal numbers of rows in which slots are counted.
WINDOWS = 1 << 17


def _prefix(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def feasible(prefix: list[int], capacity: int, most: int) -> bool:
    """Whether a greedy walk over the atoms needs at most `most` shards of that capacity."""
    at, end = 0, len(prefix) - 1
    for _ in range(most):
        to = bisect_right(prefix, prefix[at] + capacity) - 1
        if to >= end:
            return True
        if to == at:
            return False
        at = to
    return False


def minimax_cuts(sizes: list[int], n_shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity over ordered atoms, and the first atoms of the shards after the first.

    A plain greedy walk at that capacity would starve the last shard, so the cuts are evened out within it.
    """
    prefix = _prefix(sizes)
    total, end = prefix[-1], len(sizes)
    if not end:
        return 0, []
    low, high = max(max(sizes), -(-total // n_shards)), total
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, middle, n_shards):
            high = middle
        else:
            low = middle + 1
    return low, _even_cuts(np.array(prefix), low, n_shards)


def _even_cuts(prefix: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """Cuts within the capacity whose smallest shard is as large as possible, by binary search over that too."""
    end = len(prefix) - 1
    first = np.searchsorted(prefix, prefix - capacity, "left")

    def reach(least: int) -> list[np.ndarray]:
        """Which atoms can begin shard k, for each k."""
        past = np.searchsorted(prefix, prefix - least, "right")
        steps = [np.arange(end + 1) == 0]
        for _ in range(n_shards):
            count = np.concatenate([[0], np.cumsum(steps[-1])])
            steps.append(count[past] - count[np.minimum(first, past)] > 0)
        return steps

    low, high = 0, int(prefix[-1]) // n_shards
    while low < high:
        middle = (low + high + 1) // 2
        if reach(middle)[-1][end]:
            low = middle
        else:
            high = middle - 1
    steps, cuts, at = reach(low), [], end
    for k in range(n_shards - 1, 0, -1):
        span = np.arange(first[at], np.searchsorted(prefix, prefix[at] - low, "right"))
        span = span[steps[k][span]]
        at = int(span[np.argmin(np.abs(prefix[span] * n_shards - k * int(prefix[-1])))])
        cuts.append(at)
    return [c for c in reversed(cuts) if c < end]


class Range(NamedTuple):
    """Groups whose hashes begin with the same `bits` bits as `first`, the smallest hash of the range."""

    first: int
    bits: int
    size: int
    groups: int


class Walk:
    """A greedy walk over ranges that may cut anywhere inside one with several groups."""

    def __init__(self, ranges: list[Range]):
        self.prefix = _prefix([r.size for r in ranges])
        self.whole = [r.groups == 1 for r in ranges]

    def at(self, position: int) -> int:
        """The range in which a position lies; that of a border is the one that begins there."""
        return bisect_right(self.prefix, position) - 1

    def cut(self, position: int) -> int:
        """The last place up to the position at which a cut may be."""
        i = self.at(position)
        return self.prefix[i] if i < len(self.whole) and self.whole[i] else position

    def feasible(self, capacity: int, most: int) -> bool:
        at, end = 0, self.prefix[-1]
        for _ in range(most):
            if at + capacity >= end:
                return True
            to = self.cut(at + capacity)
            if to <= at:
                return False
            at = to
        return False

    def touched(self, low: int, high: int, most: int) -> set[int]:
        """Ranges with several groups in which a cut of a walk may fall, at any capacity from low to high."""
        out: set[int] = set()
        first = last = 0
        for _ in range(most - 1):
            first = self.prefix[min(self.at(min(first + low, self.prefix[-1])), len(self.whole))]
            last = self.cut(min(last + high, self.prefix[-1]))
            if first >= self.prefix[-1]:
                break
            out.update(i for i in range(self.at(first), min(self.at(last), len(self.whole) - 1) + 1) if not self.whole[i])
        return out


def _smallest(ok, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if ok(middle):
            high = middle
        else:
            low = middle + 1
    return low


def _sums(groups: DataFrame, bits: int) -> list[Range]:
    """The ranges of that many bits; one row each."""
    cell = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    rows = groups.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))
    return [Range(r.cell << (64 - bits), bits, r.bytes, r.groups) for r in rows.collect()]


def refined(groups: DataFrame, n_shards: int, bits: int, more: int) -> tuple[int, list[Range]]:
    """The smallest capacity over all groups(h, bytes), and ranges by whose borders it can be cut."""
    ranges = sorted(_sums(groups, bits))
    total = sum(r.size for r in ranges)
    large = 4 * total / max(len(ranges), 1)
    while ranges:
        walk, prefix = Walk(ranges), _prefix([r.size for r in ranges])
        least = max(max((r.size for r in ranges if r.groups == 1), default=1), -(-total // n_shards))
        low = _smallest(lambda c: walk.feasible(c, n_shards), least, total)
        high = _smallest(lambda c: feasible(prefix, c, n_shards), low, total)
        # A range far above the mean of the first ones holds a large group, which is set apart first.
        open_ = {i for i, r in enumerate(ranges) if r.groups > 1 and r.size > large} or walk.touched(low, high, n_shards)
        if not open_:
            return high, ranges
        by_bits: dict[int, list[int]] = {}
        for i in open_:
            by_bits.setdefault(ranges[i].bits, []).append(ranges[i].first >> (64 - ranges[i].bits))
        ranges = [r for i, r in enumerate(ranges) if i not in open_]
        for b, cells in by_bits.items():
            ranges += _sums(groups.where(F.shiftright("h", 64 - b).isin(cells)), min(64, b + more))
        ranges.sort()
    return 0, []


def shard_by_bytes(df: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", bits: int = 14, more: int = 6) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of df.

    The first ranges are those of `bits` bits of the hash, and one that is divided is by `more` bits. A null text has no
    bytes, like an empty one, and shares its group. Rows with equal keys are rows of their own; a null key is kept. An
    empty table gives no rows. Other columns of df are not looked at, whatever their names. A text that alone is larger
    than an even share gets a shard as large as it is. Slots count within a shard by windows of the order, of which a range
    has as many as its share of the rows asks for, so a hot text is dealt over many.
    """
    rows = df.select(
        F.col(key).alias("k"),
        (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("crc"),
        F.xxhash64(text_or_empty(text)).alias("h"),
    )
    groups = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "groups")
    capacity, ranges = refined(groups, n_shards, bits, more)
    cuts = _even_cuts(np.array(_prefix([r.size for r in ranges])), capacity, n_shards) if ranges else []
    bounds = F.array(*(F.lit(ranges[c].first) for c in cuts)) if cuts else F.array().cast("array<bigint>")
    shard = F.size(F.filter(bounds, lambda b: b <= F.col("h"))).cast("int")
    cell = F.shiftright("h", 64 - bits)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = F.ceil(F.sum("n") * WINDOWS / max(total, 1)).cast("long")
    cells = groups.groupBy(cell.alias("cell")).agg(salts.alias("salts"))  # 1 << bits rows at most
    dealt = rows.withColumn("cell", cell).withColumn("shard", shard).join(F.broadcast(cells), "cell")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("k", "h"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    # WINDOWS + (1 << bits) + n_shards rows at most.
    places = dealt.groupBy("shard", "cell", "salt").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell", "salt").orderBy("k", "crc", "size"))
    return dealt.withColumn("nth", within).join(F.broadcast(places), ["shard", "cell", "salt"]).select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir):
    return shard_by_bytes(parquet(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
