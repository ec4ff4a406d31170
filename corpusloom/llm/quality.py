"""Quality rules with risk-controlled cutoffs, with DataFrame operations only.

Every rule is a number per document and a cutoff above which the document goes. Cutoffs come from a fixed grid, and
the labelled documents of a stratum, all of them, decide. Its bad ones say where risk is spent: each rule may reject a
share of good documents in proportion to the labelled bad ones that its strictest cutoff rejects, so a rule that rejects
none gets none, and the shares add up to `risk`. Its good ones, drawn independently of the bad ones, are the test: from
the most lenient cutoff to the strictest, one is certified while the exact binomial (Clopper-Pearson) upper bound of its
false-rejection rate, at confidence `1 - delta / tests`, is within the share of its rule. The first that is not ends the
walk, and as what cutoffs reject is nested, none of the walk's steps costs confidence; `tests` are the pairs of stratum
and rule with a share. By the union bounds over them and over rules, all certified cutoffs together reject at most a
share `risk` of the good documents of each stratum, with probability 1 - delta. Of the certified cutoffs of a rule, the
one that rejects most bad documents is taken, each good one among them counting against it `good_weight` times; if none
gains, the rule rejects nothing in that stratum. Strata are not pooled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import parquet, sql_window, sql_words, written

#: Rules: value in thousandths, from the feature columns.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "long_words": ("word_chars", "n_words"),
}
CUTOFFS = {
    "symbols": [20, 50, 100, 150, 200, 300, 500, 800, 1200, 2000],
    "dup_lines": [20, 50, 100, 150, 200, 300, 400, 500, 600, 800],
    "repeats": [10, 20, 40, 60, 80, 100, 120, 140, 160, 180],
    "capitals": [50, 80, 120, 160, 200, 300, 400, 500, 600, 800],
    "long_words": [7000, 8000, 9000, 10000, 12000, 14000, 17000, 20000, 30000, 50000],
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _without(text: str, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_features(df: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """(row, features): `row` holds all columns of df, so clashing names do no harm; `features` the counts.

    A null text has no words and no lines. Windows are compared by 64-bit hashes within one document.
    """
    step = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    step = step.select("*", F.array_remove(F.split("t", r"[ \t-\r]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(width))))
    step = step.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _without("t", r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _without("t", "[A-Z]+").alias("n_capitals"),
        F.when(F.size("w") >= width, hashes).alias("h"),
    )
    # No lambda names an array from outside it: inlined by the optimizer, that array would be built for each element.
    again = F.size(F.array_distinct("h")) < F.size("h")
    step = step.withColumn("p", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    rest = lambda a: F.greatest(F.size(a) - 1, F.lit(0))
    own, none = F.transform("p", lambda x: x["h"]), F.array(F.lit(None).cast("long"))
    step = step.withColumn("o", own).withColumn("z", F.arrays_zip("p", F.concat(none, F.slice("o", 1, rest("o"))).alias("x"), F.concat(F.slice("o", 2, rest("o")), none).alias("y")))
    step = step.withColumn("z", F.transform("z", lambda z: F.struct(z["p"]["h"].alias("h"), z["p"]["i"].alias("i"), z["x"].alias("x"), z["y"].alias("y"))))
    twice = F.filter("z", lambda z: F.coalesce(z["h"] == z["x"], F.lit(False)) | F.coalesce(z["h"] == z["y"], F.lit(False)))
    step = step.withColumn("s", F.sort_array(F.transform(twice, lambda z: z["i"])))
    covered = F.zip_with("s", F.slice("s", 2, rest("s")), lambda x, y: F.least(F.lit(width), F.coalesce(y, x + width) - x))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    return step.select("row", F.struct(*FEATURES).alias("features"))


def base_failed(f: str = "features") -> Column:
    return (F.col(f"{f}.n_words") < 10) | (F.col(f"{f}.n_repeat_words") * 100 > F.col(f"{f}.n_words") * 20)


def _value(rule: str, f: str = "features") -> Column:
    """Thousandths, rounded down; a rule without a denominator has the value 0."""
    over, under = RULES[rule]
    return F.coalesce(F.floor(F.try_divide(F.col(f"{f}.{over}") * 1000, F.col(f"{f}.{under}"))), F.lit(0)).cast("long")


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate p at which k or fewer of n has a probability of delta at least."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if _beta(n - k, k + 1, 1 - p) > delta:  # P(X <= k)
            low = p
        else:
            high = p
    return high


def _beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction; its length hardly grows with a and b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


def certified(counts: dict[tuple[str, str], list[list[int]]], risk: float, delta: float, good_weight: float) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> cutoff, from the numbers of bad and of good documents in each bin of the grid."""
    hits = {k: sum(bad[1:]) for k, (bad, _) in counts.items()}
    of_stratum: dict[str, int] = {}
    for (s, _), n in hits.items():
        of_stratum[s] = of_stratum.get(s, 0) + n
    tests, out = sum(n > 0 for n in hits.values()), {}
    for (s, rule), (bad, good) in counts.items():
        n, best = sum(good), 0.0
        if not n or not hits[s, rule]:
            continue
        share = risk * hits[s, rule] / of_stratum[s]
        for i, cutoff in reversed(list(enumerate(CUTOFFS[rule]))):
            k = sum(good[i + 1 :])
            if upper_bound(k, n, delta / tests) > share:
                break
            gain = sum(bad[i + 1 :]) - good_weight * k
            if gain > 0 and gain >= best:
                best, out[s, rule] = gain, cutoff
    return out


def fit_cutoffs(features: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", quality: str = "quality", risk: float = 0.05, delta: float = 0.05, good_weight: float = 20.0) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> cutoff, from counts of all labelled documents; nothing for what can't be certified.

    Labels without a key or a quality are left out; several labels of a document count as one, good if any is. A null
    stratum is the stratum ''. Documents that the base rules reject have no part. What comes to the driver is one row
    per stratum, rule and bin of the grid.
    """
    own = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(quality) > 0).cast("int")).alias("good"))
    own = features.where(~base_failed()).select(F.col(f"row.{key}").alias("k"), F.coalesce(F.col(f"row.{stratum}"), F.lit("")).alias("stratum"), *(_value(r).alias(r) for r in RULES)).join(own, "k")
    above = lambda r: sum(((F.col(r) > c).cast("int") for c in CUTOFFS[r]), F.lit(0))
    long = own.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), above(r).alias("bin")) for r in RULES))).alias("x"))
    counts: dict[tuple[str, str], list[list[int]]] = {}
    for r in long.groupBy("stratum", "x.rule", "x.bin", "good").count().collect():
        counts.setdefault((r["stratum"], r["rule"]), [[0] * (len(CUTOFFS[r["rule"]]) + 1) for _ in range(2)])[r["good"]][r["bin"]] += r["count"]
    return certified(counts, risk, delta, good_weight)


def verdict(cutoffs: dict[tuple[str, str], int], stratum: str = "lang") -> Column:
    """True where the document stays."""
    own = F.coalesce(F.col(f"row.{stratum}"), F.lit(""))
    goes = F.lit(False)
    for (s, rule), cutoff in sorted(cutoffs.items()):
        goes = goes | ((own == s) & (_value(rule) > cutoff))
    return ~base_failed() & ~goes


def _kept_features(docs: DataFrame) -> DataFrame:
    """Key, stratum and features of all rows as a table, without the texts."""
    return written(with_features(docs.select("doc_id", "text", "lang")).select(F.struct("row.doc_id", "row.lang").alias("row"), "features"), "features")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs(doc_id,
    text, lang), which is judged by labels(doc_id, quality, toxic).

    A null text has no words and is rejected. A null lang is a stratum of its own. Repeated rows are judged each, and alike; a
    null doc_id has no label. Empty docs give no rows, and empty labels certify no cutoff. Other columns are not looked at,
    whatever their names.
    """
    features = _kept_features(docs)
    cutoffs = fit_cutoffs(features, labels)
    return features.select("row.doc_id", *(f"features.{f}" for f in FEATURES[:5]), base_failed().alias("base_failed"), verdict(cutoffs).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns as they were.

    Features are computed once; the verdict comes back to the rows by key, stratum and a hash of the text, on which
    repeated rows agree. An empty table gives no rows; without usable labels only the base rules reject.
    """
    own = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("of"))
    features = written(with_features(own).select(F.struct("row.doc_id", "row.lang", "row.of").alias("row"), "features"), "features")
    stay = features.where(verdict(fit_cutoffs(features, labels))).select(*(F.col(f"row.{c}").alias(f"_loom_{c}") for c in ("doc_id", "lang", "of")))
    same = F.col("doc_id").eqNullSafe(F.col("_loom_doc_id")) & F.col("lang").eqNullSafe(F.col("_loom_lang")) & (F.xxhash64("text") == F.col("_loom_of"))
    return docs.join(stay, same, "left_semi")


def op6_quality_rules(spark, sf_dir):
    return rate(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


_VALUES = ", ".join(f"coalesce({over} * 1000 // nullif({under}, 0), 0) AS {rule}" for rule, (over, under) in RULES.items())
_GRID = ", ".join(f"('{rule}', {cutoff})" for rule, cutoffs in CUTOFFS.items() for cutoff in cutoffs)
_VALUE = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in RULES) + " END"
QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {
    "op6_quality_rules": rf"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
    ), words AS ({sql_words("text")}
    ), windows AS (
      SELECT doc_id, i, {sql_window(5)} AS content FROM words WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
    ), twice AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, content) AS n FROM windows WHERE content IS NOT NULL) WHERE n > 1
    ), repeated AS (
      SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, i + unnest(range(5)) AS place FROM twice) GROUP BY doc_id
    ), lengths AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY doc_id
    ), lines AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(str_split(t, chr(10))) AS line FROM texts)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), features AS (
      SELECT doc_id, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_capitals
      FROM texts LEFT JOIN lengths USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
    ), based AS (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_VALUES} FROM features
    ), grid(rule, cutoff) AS (VALUES {_GRID}
    ), labelled AS (
      SELECT doc_id, max((quality > 0)::INT) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
    ), counted AS (
      SELECT stratum, rule, cutoff, sum(good) AS n, sum(good) FILTER (WHERE {_VALUE} > cutoff) AS k, count(*) FILTER (WHERE {_VALUE} > cutoff AND good = 0) AS bad
      FROM based JOIN labelled USING (doc_id), grid WHERE NOT base_failed GROUP BY stratum, rule, cutoff
    ), hits AS (
      SELECT stratum, rule, max(bad) AS bad, 0.05::DOUBLE * max(bad) / sum(max(bad)) OVER (PARTITION BY stratum) AS share FROM counted GROUP BY stratum, rule
    ), tested AS (
      SELECT counted.*, coalesce(k, 0)::BIGINT AS lost, share, (SELECT count(*) FROM hits WHERE bad > 0) AS tests FROM counted JOIN hits USING (stratum, rule) WHERE hits.bad > 0
    ), tail AS (
      SELECT *, lost < n AND list_sum(list_transform(range(lost + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(share) + (n - j) * ln(1 - share)))) <= 0.05 / tests AS within
      FROM tested WHERE n > 0
    ), walked AS (
      SELECT *, bad - 20 * lost AS gain FROM (SELECT *, bool_and(within) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS certified FROM tail) WHERE certified
    ), taken AS (
      SELECT stratum, rule, arg_max(cutoff, (gain, -cutoff)) AS cutoff FROM walked WHERE gain > 0 GROUP BY stratum, rule
    ), rejected AS (SELECT DISTINCT doc_id FROM based JOIN taken USING (stratum) WHERE {_VALUE} > cutoff)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.doc_id IS NULL AS kept
    FROM based LEFT JOIN rejected USING (doc_id)"""
}
