import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language


def grams(text):
    """Counts of n-grams, word by word."""
    words, own = [], ""
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            own += c
        elif own:
            words.append(own)
            own = ""
    out = Counter()
    for w in words:
        w = f" {w} "
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    del out[" "]
    return out


def ranked(counts, length):
    # A border sorts before all letters, as the control character in its place does.
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].replace(" ", "\1")))[:length])}


def plain(rows, held, length=300):
    """rows: (key, text, lang) -> (key, language, score) of each, learned from those for which held(key) is false."""
    totals = defaultdict(Counter)
    for k, t, lang in rows:
        if t is not None and lang is not None and not held(k) and grams(t):
            totals[lang].update(grams(t))
    profiles = {lang: ranked(c, length) for lang, c in totals.items()}
    out = []
    for k, t, _ in rows:
        own = ranked(grams(t), length)
        if not own or not profiles:
            out.append((k, "und", 0.0))
            continue
        d = {lang: sum(abs(p[g] - r) if g in p else length for g, r in own.items()) for lang, p in profiles.items()}
        best = min(sorted(d, key=lambda x: x.encode()), key=d.get)
        out.append((k, best, 1 - d[best] / (len(own) * length)))
    return out


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 0


def corpus():
    r = random.Random(8)
    kinds = {"x": "abc déf ghi", "y": "ghi jkl mnö", "zß": "漢字 かな 仮名", "w": "ΑΣ ΒΓΣ σς İi ǅ"}
    rows = []
    for i in range(160):
        lang = r.choice(list(kinds))
        letters = kinds[lang]
        rows.append((i, "".join(r.choice(letters + " 1,\n'") for _ in range(r.randint(0, 200))), r.choice([lang, lang, lang, None])))
    odd = [None, "", "123 !?", " \n", "a", "ab", "É", "ß", "漢", "\U0001f600", "\U00010400\U00010428", "A" * 3_000, "a1b2c3", "no language", "no\x00nul", "ΟΔΟΣ ΟΔΟΣ."]
    return rows + [(1_000 + i, t, "x" if i % 3 else None) for i, t in enumerate(odd)]


def test_rows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4, "doc_id")
    for length in (300, 20):
        profiles = language.learned(df.where(~language.held_out()), length=length)
        got = language.identified(df, profiles).collect()
        want = {k: (lang, score) for k, lang, score in plain(rows, held, length)}
        assert {r.doc_id: (r.lang_pred, pytest.approx(r.score, abs=1e-12)) for r in got} == want
    assert {r[0] for r in df.where(language.held_out()).select("doc_id").collect()} == {k for k, _, _ in rows if held(k)}


def test_letters_are_split_for_numbers_that_fit():
    """Texts whose n-grams don't fit 63 bits together are worked on in parts."""
    texts = [chr(0x4E00 + i % 20_000) + chr(0x20000 + i) for i in range(40_000)]
    parts = [(lo, hi) for lo, hi, _ in language.grams_of(texts * 2)]
    assert len(parts) > 1 and [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == 80_000


def test_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    profiles = language.learned(odd)
    got = language.identified(odd, profiles).collect()
    want = plain(rows, lambda k: False)
    key = lambda r: (str(r[0]), r[1], round(r[2], 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
    nothing = language.learned(empty)
    assert nothing.languages == () and language.identified(empty, profiles).collect() == []
    assert {(r.lang_pred, r.score) for r in language.identified(odd, nothing).collect()} == {("und", 0.0)}
    named = odd.select(F.concat(F.lit("k"), "doc_id").alias("l"), F.col("text").alias("k"))
    assert language.identified(named, profiles, "l", "k").where("l LIKE 'k%'").count() > 10


def test_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(12)], "text string, lang string")
    monkeypatch.setattr(language, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        language.learned(df)
    with pytest.raises(ValueError):
        language.learned(df, length=0)


def test_accuracy(spark):
    got = language.op13_language_id(spark, "/root/testdata/sf0.01").alias("p")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    n, right = got.where("held_out").join(docs, "doc_id").where("lang IS NOT NULL").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.98
