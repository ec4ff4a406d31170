import math
import random

from pyspark.sql import functions as F

from corpusloom.llm import quality
from tests.llm import brute


def test_counts(odd, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {}
    for r in quality.rate(odd, labels).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for r in odd.collect():
        c = brute.counts(r.text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        assert (*c, failed, not failed) in got[r.doc_id]
    assert sum(map(len, got.values())) == odd.count()
    assert quality.rate(empty, labels).count() == 0


def test_columns_are_kept(odd, spark):
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns and 0 < out.count() < odd.count()


def test_upper_bound_is_exact():
    for k, n, d in ((0, 10, 0.05), (3, 50, 0.01), (49, 50, 0.05), (50, 50, 0.05), (0, 1, 0.5)):
        p = quality.upper_bound(k, n, d)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert (k == n and p == 1) or abs(tail - d) < 1e-9
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9


def test_risk_holds_out_of_sample(spark):
    """Bad texts are full of symbols, a few good ones are too; false rejections of fresh good ones stay in bounds."""
    r = random.Random(1)

    def text(bad):
        share = r.choice([0.5, 0.9]) if bad else 0.2 if r.random() < 0.002 else 0
        return " ".join(f"w{r.randint(0, 99)}" + ("$$$" if r.random() < share else "") for _ in range(40))

    rows = [(i, text(i % 4 == 0), "en", int(i % 4 != 0)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")
    features = quality.with_features(df)
    labels = df.where("doc_id < 6000").select("doc_id", F.col("good").alias("quality"))
    cutoffs = quality.fit_cutoffs(features, labels)
    assert set(cutoffs) == {("en", "symbols")}
    fresh = features.where("row.doc_id >= 6000").groupBy("row.good").agg(F.avg((~quality.verdict(cutoffs)).cast("double")).alias("gone"))
    gone = {r.good: r.gone for r in fresh.collect()}
    assert gone[1] <= 0.05 and gone[0] > 0.95
    few = quality.fit_cutoffs(features, labels.limit(40))
    assert few == {}  # too few labels certify nothing


def test_small_strata_are_certified(spark):
    """312 good labelled documents do for a rule that rejects none of them, beside other strata and a second rule."""
    r = random.Random(2)

    def text(bad):
        return " ".join(f"w{r.randint(0, 99)}" + ("$$$" if bad and r.random() < 0.9 else "") for _ in range(40))

    rows = [(1000 * j + i, text(i < 33), lang, int(i >= 33)) for j, lang in enumerate(["de", "en", "es", "fr"]) for i in range(345)]
    rows += [(9000 + i, " ".join("lengthyword%05d" % r.randint(0, 99999) for _ in range(40)), "es", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")
    features = quality.with_features(df)
    cutoffs = quality.fit_cutoffs(features, df.select("doc_id", F.col("good").alias("quality")))
    assert set(cutoffs) == {(s, "symbols") for s in ("de", "en", "es", "fr")} | {("es", "long_words")}
    gone = features.where(~quality.verdict(cutoffs)).groupBy("row.lang", "row.good").count().collect()
    assert {(r.lang, r.good, r["count"]) for r in gone} == {("de", 0, 33), ("en", 0, 33), ("es", 0, 53), ("fr", 0, 33)}


def test_risk_in_all_strata_at_once():
    """Rates of false rejection that grow with strictness and pass the risk at once or later: seldom is any too large."""
    r, wrong, rounds, some = random.Random(3), 0, 100, 0
    for _ in range(rounds):
        counts, rates = {}, {}
        for s in ("a", "b"):
            for rule, hits in (("symbols", 60), ("long_words", 30), ("capitals", 0)):
                # Per bin from strict to lenient: good documents are drawn, the rate of a cutoff is what lies above it.
                p = [r.choice([0.0, 0.002, 0.011]) for _ in range(10)]
                good = [0] * 11
                for _ in range(400):
                    u, at = r.random(), 0
                    for i in range(10):
                        u -= p[i]
                        if u < 0:
                            at = i + 1
                            break
                    good[at] += 1
                counts[s, rule], rates[s, rule] = ([10] + [0] * 9 + [hits], good), p
        found = quality.certified(counts, 0.05, 0.05, 0.0)
        assert not any(rule == "capitals" for _, rule in found)
        some += bool(found)
        wrong += any(sum(sum(rates[k][quality.CUTOFFS[k[1]].index(c) :]) for k, c in found.items() if k[0] == s) > 0.05 for s in ("a", "b"))
    assert some > rounds / 2 and wrong <= 0.05 * rounds
