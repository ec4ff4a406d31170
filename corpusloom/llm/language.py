"""Language by rank-order profiles of n-grams.

A text's words, in lower case and with a border at either end, are cut into their n-grams of one to three characters. The
most frequent of them, by rank, are the text's profile; the most frequent ones of all texts labelled with a language are
that language's. Of two profiles each n-gram of the first is out of place by the difference of its ranks, or by the whole
length of a profile where the second lacks it. The language with the smallest sum is the one named.

N-grams are numbers: three code points of 21 bits, with 0 for none and 1 for a border, so their order is that of their
characters and is the rule for ties. They are counted by sorting whole slices of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.window import Window

from corpusloom.llm.common import column, parquet, slices

#: N-grams of a profile, and the name of the language of a text without letters.
LENGTH, NONE = 300, "und"
#: Distinct labels beyond which they can't be languages.
MOST_LANGUAGES = 2_000
#: Counts that a task holds before it sends them on.
HELD = 2_000_000
FOLDS = 5
_BITS = np.int64(21)


class Grams:
    """The n-grams of some texts: `alphabet` are the code points, and n-gram i of text `row[i]` is `code[i]`, three
    digits to the base `base`, which are 0 for none, 1 for a border, else 2 and more for the code points in order."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le"), np.uint32)
        used, is_letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        used[points] = True
        self.alphabet = np.array([i for i in np.flatnonzero(used).tolist() if chr(i).isalpha()], np.int64)
        is_letter[self.alphabet] = True
        letter = is_letter[points]
        # The letters of each text; of each run of other characters one stays, as the border, and there is one at either end.
        ends = np.cumsum([1, *(len(t) + 1 for t in lower)])
        row = np.repeat(np.arange(len(lower)), np.diff(np.concatenate([[0], np.cumsum(letter)])[ends]))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        letter, points = letter[keep], points[keep]
        self.base = len(self.alphabet) + 2
        digit = np.ones(0x110000, np.int32 if self.base**3 < 1 << 31 else np.int64)
        digit[self.alphabet] = np.arange(2, self.base)
        place = digit[points]
        # By each letter: it alone, with what follows, and with what follows that; and those that begin at the border before it.
        at, b = np.flatnonzero(letter), self.base
        own, after = place[at], place[at + 1]
        starts, goes_on = ~letter[at - 1], letter[at + 1]
        pair = own * b + after
        edge = b + own[starts]
        self.row = np.concatenate([row, row, row[starts], row[goes_on], row[starts]])
        self.code = np.concatenate([own * (b * b), pair * b, edge * b, pair[goes_on] * b + place[at[goes_on] + 2], edge * b + after[starts]])

    def numbers(self, code: np.ndarray) -> np.ndarray:
        """The same n-grams as numbers that are the same for all texts."""
        points, code, b = np.concatenate([[0, 1], self.alphabet]).astype(np.int64), code.astype(np.int64), self.base
        return points[code // (b * b)] << (2 * _BITS) | points[code // b % b] << _BITS | points[code % b]


def grams_of(texts: list[str]) -> Iterator[tuple[int, int, Grams]]:
    """N-grams of ranges of texts, such that row and n-gram together are a number of 63 bits."""
    stack = [(0, len(texts))]
    while stack:
        lo, hi = stack.pop()
        grams = Grams(texts[lo:hi])
        if grams.base**3 * (hi - lo) < 1 << 63:
            yield lo, hi, grams
        else:
            stack += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]


@dataclass(frozen=True)
class Profiles:
    """Languages in order, the n-grams that any of them has in order, and the rank of each; `length` where it has none."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    length: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def merged() -> int:
        for lang, parts in held.items():
            code, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            code, which = np.unique(code, return_inverse=True)
            held[lang] = [(code, np.bincount(which, weights=count).astype(np.int64))]
        return sum(len(parts[0][0]) for parts in held.values())

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, ((code, count),) in held.items():
            for i in range(0, len(code), 100_000):
                yield pa.record_batch([pa.array([lang] * len(code[i : i + 100_000]), pa.string()), pa.array(code[i : i + 100_000]), pa.array(count[i : i + 100_000])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts, langs = column(batch, "t"), column(batch, "l")
        for lo, hi in slices(texts):
            names, which = np.unique(np.array(langs[lo:hi].to_pylist(), object), return_inverse=True)
            for first, last, grams in grams_of(texts[lo:hi].to_pylist()):
                span = grams.base**3
                both = which[first:last][grams.row] * span + grams.code
                if len(names) * span <= 4 * len(both):
                    count = np.bincount(both)
                    both = np.flatnonzero(count)
                    count = count[both]
                else:
                    both, count = np.unique(both, return_counts=True)
                edges = np.searchsorted(both, np.arange(len(names) + 1) * span)
                for i, name in enumerate(names):
                    own = slice(edges[i], edges[i + 1])
                    if edges[i] < edges[i + 1]:
                        held.setdefault(name, []).append((grams.numbers(both[own] - i * span), count[own]))
                        size += edges[i + 1] - edges[i]
            if size > HELD:
                size = merged()
                if size > HELD // 2:
                    yield from rows()
                    size = 0
    merged()
    yield from rows()


def learned(df: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH) -> Profiles:
    """The profiles of all languages in df, from all its rows with a text and a language.

    Rows with nulls, and texts without letters, teach nothing; a repeated row counts each time. Equal counts are ranked by the
    characters. Without rows there are no languages. A driver gets `length` n-grams a language; more than MOST_LANGUAGES
    languages raise ValueError.
    """
    own = df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    if not 0 < length < 1_000:
        raise ValueError("profiles have 1 to 999 n-grams")
    counts = own.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark keeps the first of each partition before the shuffle, so no task sees all n-grams of a language.
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    rows = ranked.select("lang", "gram", "rank").limit(MOST_LANGUAGES * length + 1).collect()
    languages = sorted({r.lang for r in rows}, key=lambda x: x.encode())
    if len(languages) > MOST_LANGUAGES or len(rows) > MOST_LANGUAGES * length:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    grams = np.array(sorted({r.gram for r in rows}), np.int64)
    place, at = {l: i for i, l in enumerate(languages)}, {g: i for i, g in enumerate(grams.tolist())}
    ranks = np.full((len(languages), len(grams)), length, np.int64)
    for r in rows:
        ranks[place[r.lang], at[r.gram]] = r.rank - 1
    return Profiles(tuple(languages), grams, ranks, length)


def nearest(texts: list[str], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score."""
    names, scores = [NONE] * len(texts), np.zeros(len(texts))
    if not profiles.languages:
        return names, scores
    for lo, hi, grams in grams_of(texts):
        span = grams.base**3
        both, count = np.unique(grams.row * span + grams.code, return_counts=True)
        row = both // span
        most = int(count.max()) if len(count) else 0
        order = np.argsort(row * (most + 1) + (most - count), kind="stable")
        row, code = row[order], (both % span)[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, code, rank = (x[rank < profiles.length] for x in (row, code, rank))
        number = grams.numbers(code)
        at = np.minimum(np.searchsorted(profiles.grams, number), len(profiles.grams) - 1)
        known = profiles.grams[at] == number
        out = np.empty((len(profiles.languages), hi - lo))
        for i, ranks in enumerate(profiles.ranks):
            place = np.where(known, ranks[at], profiles.length)
            out[i] = np.bincount(row, np.where(place < profiles.length, np.abs(place - rank), profiles.length), hi - lo)
        size = np.bincount(row, minlength=hi - lo)
        best = out.argmin(axis=0)
        for i in np.flatnonzero(size).tolist():
            names[lo + i] = profiles.languages[best[i]]
            scores[lo + i] = 1 - out[best[i], i] / (size[i] * profiles.length)
    return names, scores


def identified(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row.

    The score is 1 less the share of the greatest possible sum of places that the nearest language is out by. A text that is
    null or has no letter, and every text where no language was learned, is `und` with score 0; of languages at equal
    distance the first by name is taken. Keys may be of any type and null, and repeated rows are judged each; an empty table
    gives no rows; other columns are not looked at. Whole texts are read, in memory in the order of the longest.
    """
    schema = StructType().add("k", df.schema[key].dataType).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "t").fill_null("")
            for lo, hi in slices(texts):
                names, scores = nearest(texts[lo:hi].to_pylist(), profiles)
                yield pa.record_batch([column(batch, "k")[lo:hi], pa.array(names, pa.string()), pa.array(scores)], schema.fieldNames())

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def held_out(key: str = "doc_id", folds: int = FOLDS):
    """True for one key in `folds`, by the CRC-32 of its decimal digits; a null key is that of the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def op13_language_id(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents")
    profiles = learned(docs.where(~held_out()))
    return identified(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_language_id": op13_language_id}
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
SQL = {
    "op13_language_id": f"""
    WITH docs AS (
      SELECT doc_id, lang, text, {_CRC} % {FOLDS} = 0 AS held_out FROM documents
    ), words AS (
      SELECT doc_id, lang, held_out, ' ' || word || ' ' AS w FROM (SELECT doc_id, lang, held_out, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM docs)
    ), grams AS (
      SELECT doc_id, lang, held_out, gram, count(*) AS n
      FROM (SELECT doc_id, lang, held_out, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) AS gram FROM words)
      WHERE gram <> ' ' GROUP BY ALL
    ), profiles AS (
      SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS place FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram
      QUALIFY place < {LENGTH}
    ), own AS (
      SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS rank FROM grams QUALIFY rank < {LENGTH}
    ), distances AS (
      SELECT own.doc_id, l.lang, count(*) AS m, sum(CASE WHEN p.place IS NULL THEN {LENGTH} ELSE abs(p.place - own.rank) END) AS d
      FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = own.gram GROUP BY own.doc_id, l.lang
    ), best AS (
      SELECT doc_id, arg_min(lang, (d, lang)) AS lang_pred, 1 - min(d)::DOUBLE / (any_value(m) * {LENGTH}) AS score FROM distances GROUP BY doc_id
    )
    SELECT doc_id, held_out, coalesce(lang_pred, '{NONE}') AS lang_pred, coalesce(score, 0.0) AS score FROM docs LEFT JOIN best USING (doc_id)"""
}
