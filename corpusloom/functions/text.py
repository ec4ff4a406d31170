"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import STOP_WORDS, SUMMARY_CHARS, WHITE


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return trimmed(F.regexp_replace(c, f"{WHITE}+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{WHITE[1:]}")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WHITE[1:]}+")), F.lit(0)).cast("long")


def _edge(ascii_letter: bool, after: bool) -> str:
    """A word border of ASCII rules: next to a letter outside ASCII, the other side has to be a word character."""
    return f"(?{'' if after else '<'}{'!' if ascii_letter else '='}[a-z0-9_])"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _score(x: Column, words: list[str]) -> Column:
    """Function words among x.hits, and those with letters outside ASCII, which are looked for only where they occur."""
    out = F.size(F.filter(x["hits"], lambda t: t.isin([w for w in words if w.isascii()])))
    for w in words:
        if not w.isascii():
            pattern = _edge(w[0].isascii(), False) + re.escape(w) + _edge(w[-1].isascii(), True)
            out = out + F.when(F.contains(x["low"], F.lit(w)), F.regexp_count(x["low"], F.lit(pattern))).otherwise(0)
    return out


def language(c: Column) -> Column:
    """The language with most function words, the first of equals; en without any, unknown for blank text."""
    lists = {code: words.split() for code, words in STOP_WORDS.items()}
    plain = sorted({w for words in lists.values() for w in words if w.isascii()})
    low = _bound(F.lower(c), lambda x: F.struct(x.alias("low"), F.filter(F.split(x, "[^a-z0-9_]+"), lambda t: t.isin(plain)).alias("hits")))
    best = _bound(low, lambda x: F.array_max(F.array(*(F.struct(_score(x, words).alias("score"), F.lit(-i).alias("rank")) for i, words in enumerate(lists.values())))))
    return F.when(is_blank(c), "unknown").otherwise(F.element_at(F.lit(list(lists)), F.lit(1) - best["rank"]))


def content_hash(c: Column) -> Column:
    return F.when(is_blank(c), "").otherwise(F.substring(F.sha2(c, 256), 1, 16))


def summary(c: Column, most: int = SUMMARY_CHARS) -> Column:
    """Up to the last sentence that ends beyond the middle, else up to the last blank and three points."""
    head = F.substring(c, 1, most)
    sentence = F.length(F.regexp_extract(head, r"(?s)^(.*)[.!?] ", 1))
    found = head.rlike(r"[.!?] ") & (sentence > most * 0.5)
    return F.when(F.length(c) <= most, c).when(found, F.substring(head, F.lit(1), sentence + 1)).otherwise(F.concat(F.regexp_extract(head, "(?s)^(.*) ", 1), F.lit("...")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def line_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def content_type_base(c: Column) -> Column:
    return F.trim(F.substring_index(c, ";", 1))


def or_default(c: Column, default) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def tenths(part: Column, whole: Column) -> Column:
    """part / whole in per cent with one decimal, half up; 0 if whole is 0."""
    return F.coalesce(F.floor(F.try_divide(2000 * part + whole, 2 * whole)).cast("long") / F.lit(10.0).cast("double"), F.lit(0.0).cast("double"))


def percent_text(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", c), F.lit("%"))


def rounded(numerator: Column, denominator: Column) -> Column:
    """Quotient of whole numbers, half up; 0 if the denominator is 0."""
    return F.coalesce(F.floor(F.try_divide(2 * numerator + denominator, 2 * denominator)), F.lit(0)).cast("long")


def duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s / 60)
    text = lambda *parts: F.concat(*(F.concat((n).cast("long").cast("string"), F.lit(u)) for n, u in parts))
    return (
        F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(h > 0, text((h, "h "), (m % 60, "m "), (s % 60, "s")))
        .when(m > 0, text((m, "m "), (s % 60, "s")))
        .otherwise(text((s, "s")))
    )


def eta(seconds: Column) -> Column:
    n = lambda c: c.cast("long").cast("string")
    return F.when(seconds <= 0, "--").when(seconds < 60, F.concat(F.lit("~"), n(seconds), F.lit("s"))).otherwise(F.concat(F.lit("~"), n(F.floor(seconds / 60)), F.lit("m "), n(seconds % 60), F.lit("s")))


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_slug(c: Column, chars: int | None = 19) -> Column:
    out = F.translate(iso_time(c), ":.", "--")
    return out if chars is None else F.substring(out, 1, chars)
