"""URL filter: a trie over reversed host labels and then path segments; the longest entry that fits decides.

An entry is a host and a path. It fits its host and all subdomains of it, if the url's path starts with the entry's
path. Of the entries that fit, the one with most host labels and then the longest path decides; at the same host and
path, a block precedes an allow.

The trie is packed: its entries in the order of their reversed labels, then of their paths, in one block of bytes, so that a
node is a range of them and a step narrows the range by binary search. It is broadcast if the packed bytes, which are what a
worker holds, are within `most_bytes`. A larger list is joined instead: a url by the suffixes of its host with the lengths
of the paths that a host's entries have, and by host and prefix of those lengths with the entries.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import parquet

Rule = tuple[str, str, str]
#: Bytes of the packed trie up to which it is broadcast.
MOST_BYTES = 32 << 20
#: Fixed values of the query: (verdict, host, path).
RULES: list[Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: str = "url") -> Column:
    """What is between the first :// and the next / ? # or the end, A-Z in lower case; empty for null or no ://."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Keys:
    """Byte strings in order, in one block."""

    def __init__(self, keys: list[bytes]):
        self.block = b"".join(keys)
        self.ends = np.cumsum([0, *map(len, keys)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.block[self.ends[i] : self.ends[i + 1]]

    def nbytes(self) -> int:
        return len(self.block) + self.ends.nbytes


#: Between labels, and between labels and path. No label has them, and they sort before what labels have.
_LABEL, _PATH = b"\x01", b"\x00"


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
    return lo


class Trie:
    """The packed trie of entries. A host node is the range of keys that begin with its labels, a path node the range of
    those that begin with a path too; the longest path that fits is found from the key before the url's own, whose common
    part with it is a prefix of all entries that fit and are shorter."""

    def __init__(self, rules: Iterable[Rule]):
        found: dict[bytes, bool] = {}
        for verdict, host, path in rules:
            if min(host.encode(), default=3) < 3:
                raise ValueError(f"{host!r} is no host")
            key = _LABEL.join(reversed(host.encode().split(b"."))) + _PATH + path.encode()
            found[key] = found.get(key, False) or verdict == "block"
        keys = sorted(found)
        self.keys = Keys(keys)
        self.block = np.packbits(np.array([found[k] for k in keys], bool))

    def nbytes(self) -> int:
        return self.keys.nbytes() + self.block.nbytes

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, labels, node = None, host.encode().split(b"."), b""
        lo, hi, target = 0, len(self.keys), path.encode()
        for label in reversed(labels):
            if min(label, default=3) < 3:
                break  # no entry has such a label
            node += (_LABEL if node else b"") + label
            lo = bisect_left(self.keys, node, lo, hi)
            hi = bisect_left(self.keys, node + b"\x02", lo, hi)
            if lo == hi:
                break
            hit = self._longest(node + _PATH, target, lo, hi)
            best = best if hit is None else hit
        return best if best is None else self._rule(best)

    def _longest(self, head: bytes, path: bytes, lo: int, hi: int) -> int | None:
        target = head + path
        while len(target) >= len(head):
            i = bisect_right(self.keys, target, lo, hi) - 1
            if i < lo or not (key := self.keys[i]).startswith(head):
                return None
            if target.startswith(key):
                return i
            target, hi = target[: _common(target, key)], i
        return None

    def _rule(self, i: int) -> tuple[str, str]:
        labels, path = self.keys[i].split(_PATH, 1)
        blocked = self.block[i >> 3] >> (7 - (i & 7)) & 1
        return "block" if blocked else "allow", (b".".join(reversed(labels.split(_LABEL))) + path).decode()


def judge_by_trie(df: DataFrame, trie: Trie, default: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = shared.value
        found = [trie.find(h, p) or (default, None) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": pd.Series([x[1] for x in found], dtype=object), "verdict": [x[0] for x in found]})

    return df.withColumn("found", judge("host", "path"))


def judge_by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules(verdict, host, path) of any number, none of which comes to the driver. df needs a key column `n`.

    The paths of a host's entries have few lengths, however many entries it has; a url goes on with the lengths that the
    suffixes of its host have and that its path reaches.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.size(F.split("host", r"\."))
    own = df.select("n", "path", F.col("host").alias("whole"), F.explode(F.sequence(F.lit(1), labels)).alias("labels"))
    own = own.select("n", "path", "labels", F.expr("substring_index(whole, '.', -labels)").alias("host"))
    keys = own.join(lengths, "host").select("n", "labels", "host", "path", F.explode("lengths").alias("chars")).where(F.col("chars") <= F.length("path"))
    keys = keys.select("n", "labels", "host", F.expr("left(path, chars)").alias("path"))
    hits = keys.join(rules, ["host", "path"]).groupBy("n").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct("labels", F.length("path"))).alias("found"))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return df.join(hits, "n", "left").withColumn("found", F.coalesce("found", none))


def filter_urls(df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) for every row. Null urls and urls without :// have an empty host and path and
    get the default. A host of a rule has no control characters below 3, else ValueError is raised. Repeated rows are judged each; an empty table gives none; other columns are not looked at."""
    own = df.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    trie = Trie(rules)
    if trie.nbytes() <= most_bytes:
        own = judge_by_trie(own, trie, default)
    else:
        own = own.withColumn("n", F.monotonically_increasing_id())
        own = judge_by_join(own, df.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    return own.select(F.col("key").alias(key), "host", "path", "found.rule", "found.verdict")


def op8_url_filter(spark, sf_dir):
    return filter_urls(parquet(spark, sf_dir, "pages"), RULES)


_FITS = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
    for v, h, p in sorted(RULES, key=lambda r: (-r[1].count("."), -len(r[2])))
)
SQL = {
    "op8_url_filter": rf"""
    WITH cut AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), hit AS (SELECT *, CASE {_FITS} END AS found FROM parts)
    SELECT page_id, host, path, substr(found, 7) AS rule, coalesce(left(found, 5), 'allow') AS verdict FROM hit"""
}
QUERIES = {"op8_url_filter": op8_url_filter}
