import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fim


def plain(key, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix_chars, middle_chars, output) by lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    return (n, "spm", len(x), len(y), s + z + p + x + m + y) if h4 % 100 < spm else (n, "psm", len(x), len(y), p + x + s + z + m + y)


def texts():
    r = random.Random(2)
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "x<P>y\n", "<S>", "z\n<M", "<M>\n", "<", "<S\n<P\n>\n<M", "é\nß漢\n\U0001f600\n", "a\r\nb\x85c d\x0be\n", "line\n" * 5_000, "w" * 200_000, "<<P\n>S>\n" * 40]
    return out + ["".join(r.choice(["a", "bé", "<", ">", "P", "\n", "\n", " "]) for _ in range(r.randint(0, 300))) for _ in range(200)]


@pytest.mark.parametrize("share", [0.0, 0.003, 0.5, 1.0])
def test_rank_and_select(share):
    r = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5_000):
        marks = r.random(n) < share
        bits, places = fim.Bits(marks), np.flatnonzero(marks)
        assert bits.total() == len(places)
        assert bits.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(marks).tolist()]
        assert bits.select(np.arange(len(places))).tolist() == places.tolist()


def test_rows_and_round_trip(spark):
    rows = [(i * 37 - 50, t) for i, t in enumerate(texts())]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("back", fim.restored()).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {k: plain(k, t) for k, t in rows}
    assert {r.doc_id: r.back for r in got} == {k: t or "" for k, t in rows}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_parameters(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = [(f"k{i}", t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "name string, body string")
    got = fim.fill_in_middle(df, "name", "body", seed=3, rate=60, spm=20, marks=marks).withColumn("back", fim.restored(marks=marks)).collect()
    assert {r.name: tuple(r)[1:6] for r in got} == {k: plain(k, t, 3, 60, 20, marks) for k, t in rows}
    assert {r.name: r.back for r in got} == {k: t or "" for k, t in rows}
    for bad in (("a", "b", ""), ("ab", "ba", "c"), ("<P>", "<P>", "<M>"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, "name", "body", marks=bad)


def test_odd_rows(odd, empty, rows):
    got = fim.fill_in_middle(odd).collect()
    want = [(k, *plain(k, t)) for k, t in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fim.fill_in_middle(empty).collect() == []
    other = odd.select("doc_id", "text", F.lit(1).alias("t"), F.lit(2).alias("digest"), F.lit("x").alias("h1"), F.lit("y").alias("output"), F.lit("z").alias("form"))
    assert fim.fill_in_middle(other).count() == len(want)
