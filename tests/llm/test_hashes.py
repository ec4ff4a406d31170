"""Hashes of words and the filter over keys."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exchange, ngram_join, recompress
from corpusloom.llm.common import Words
from tests.llm import brute


def twins(n):
    """Two words whose letters differ everywhere, in the order that polynomials modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("which", [0, 1])
def test_words_have_their_own_hash(which):
    r = random.Random(3)
    words = {w for n in (1, 2, 63, 64, 65, 66, 512, 1024, 2048, 4096, 20_000) for w in twins(n)}
    words |= {"".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(20_000)}
    words |= {"x" * n for n in range(1, 200)}
    words = sorted(words)
    hashes = Words(pa.array([" ".join(words)])).hashes(which)
    assert len(set(hashes.tolist())) == len(words)
    again = [int(Words(pa.array(["é", "q " + w])).hashes(which)[-1]) for w in words[::97]]
    assert again == hashes[::97].tolist()


def test_hashes_are_independent():
    words = Words(pa.array([" ".join(f"w{i}" for i in range(10_000))]))
    same = words.hashes(0) ^ words.hashes(1)
    ones = np.unpackbits(same.view(np.uint8)).mean()
    assert abs(ones - 0.5) < 0.01


@pytest.mark.parametrize("n", [1024, 2048, 20_000])
def test_unlike_long_words_link_nothing(spark, n):
    x, y = twins(n)
    docs = list(enumerate([f"a b c d {x}", f"a b c d {y}", f"A b c d {x}", x, y, f"{y} {x}"]))
    got = {r.k: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.components(docs) == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (1, 3), 4: (1, 4), 5: (1, 5)}


@pytest.mark.parametrize("width", [5, 13])
@pytest.mark.parametrize("n", [1024, 20_000])
def test_long_words_repeat_as_they_are(spark, width, n):
    x, y = twins(n)
    v, w = (" ".join(f"{c}{i}" for i in range(20)) for c in "vw")
    head, tail = " ".join(f"w{i}" for i in range(6)), " ".join(f"w{i}" for i in range(6, 12))
    docs = list(enumerate([f"{head} {x} {tail} p q", f"{head} {y} {tail} r s", f"{x} {v}", f"{y} {v}", f"{w} {x}", f"{w} {y}", f"{w} {x}"]))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in recompress.removal_report(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()}
    assert got == {d: (len(a), len(a) - len(b)) for d, (a, b) in brute.without_repeats(docs, width).items()}
    assert got[3] == (21, 20) and got[1][1] == (0 if width == 13 else 12)


def test_filter_lets_all_keys_pass(spark, monkeypatch):
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.where("id % 10 = 0")
    passes = exchange.key_filter(keys, "h")
    got = rows.where(passes(F.col("h"))).agg(F.count_if(F.expr("id % 10 = 0")), F.count("*")).first()
    assert got[0] == 6_000 and got[1] < 6_100
    assert rows.where(exchange.key_filter(keys.limit(0), "h")(F.col("h"))).count() == 0
    monkeypatch.setattr(exchange, "FILTER_BITS", 1 << 15)
    assert rows.where(exchange.key_filter(keys, "h")(F.col("h"))).count() == 60_000
