import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_word_count(spark):
    assert values(spark, tx.word_count, ["", "   ", "a b\t c\n", "a b﻿c", None, " x "]) == [0, 0, 3, 3, 0, 1]


def test_language_ties_and_borders(spark):
    rows = ["", "xyz", "la casa de", "the el", "le le la la", "não", "o o", "está la", "für der", "THE THE", " "]
    want = ["unknown", "en", "es", "en", "fr", "pt", "pt", "fr", "de", "en", "unknown"]
    assert values(spark, tx.language, rows) == want


def test_hash(spark):
    assert values(spark, tx.content_hash, ["", "abc", " "]) == ["", hashlib.sha256(b"abc").hexdigest()[:16], ""]


def test_summary(spark):
    text = lambda at, mark=".": "a" * at + mark + " " + "b" * 600
    rows = ["x" * 500, "x" * 501, text(250), text(251), text(300, "!"), "w " * 300, None]
    got = values(spark, tx.summary, rows)
    assert got[0] == rows[0] and got[1] == "..."
    assert got[2] == "a" * 250 + "...." and got[3] == "a" * 251 + "." and got[4] == "a" * 300 + "!"
    assert got[5] == ("w " * 250).rstrip() + "..." and got[6] is None


def test_escape(spark):
    assert values(spark, tx.escape_html, ["<a href=\"x\">'&amp;'"]) == ["&lt;a href=&quot;x&quot;&gt;&#039;&amp;amp;&#039;"]


def test_tenths(spark):
    df = spark.createDataFrame([(0, 0), (1, 16), (1, 3), (2, 3), (1, 1), (15, 10000), (3, 2)], "n long, d long")
    assert [r[0] for r in df.select(tx.tenths(F.col("n"), F.col("d"))).collect()] == [0.0, 6.3, 33.3, 66.7, 100.0, 0.2, 150.0]


def test_duration_and_eta(spark):
    assert values(spark, tx.duration, [999, 1000, 59_999, 60_000, 3_600_000, 3_725_000], "long") == ["999ms", "1s", "59s", "1m 0s", "1h 0m 0s", "1h 2m 5s"]
    assert values(spark, tx.eta, [0, -1, 59, 60, 125], "long") == ["--", "--", "~59s", "~1m 0s", "~2m 5s"]


def test_time_slug(spark):
    assert values(spark, lambda c: tx.time_slug(c.cast("timestamp")), ["2024-01-02 03:04:05.678"]) == ["2024-01-02T03-04-05"]


def test_normalized(spark):
    rows = ["http://A.com/x/#f", "http://a.com/", "http://a.com", "http://a.com/x/?q=1/", "http://a.com/a//", " Not A Url "]
    assert values(spark, urls.normalized, rows) == ["http://a.com/x", "http://a.com/", "http://a.com/", "http://a.com/x?q=1/", "http://a.com/a/", "not a url"]


def test_is_http(spark):
    assert values(spark, urls.is_http, ["http://a.b", "HTTPS://a.b/x", "ftp://a.b", "mailto:x@y", "", "a b", None]) == [True, True, False, False, False, False, False]


def test_organisation(spark):
    rows = ["http://www.x.edu/", "http://a.b.edu", "http://sub.x.com/", "http://localhost/", "%%"]
    assert values(spark, urls.organisation, rows) == ["x", "b", "sub", "localhost", "unknown-university"]


@pytest.mark.parametrize(("name", "want"), [("A b--C", "a-b-c"), ("--x--", "x"), ("é", ""), ("a" * 60, "a" * 50)])
def test_directory_name(spark, name, want):
    assert values(spark, urls.directory_name, [name]) == [want]


#: A url and how a browser writes it; None where it isn't one of http or https.
WRITTEN = {
    "http://a.com:80/x": "http://a.com/x", "https://a.com:443": "https://a.com/", "http://a.com:8080/x": "http://a.com:8080/x", "http://a.com:080/": "http://a.com/", "http://a.com:/": "http://a.com/",
    "http://a.com/a/../b": "http://a.com/b", "http://a.com/a/./b/..": "http://a.com/a/", "http://a.com/../..": "http://a.com/", "http://a.com/%2e%2E/z/%2e": "http://a.com/z/", "http://a.com/.well": "http://a.com/.well", "http://a.com/a..b/c.": "http://a.com/a..b/c.",
    "http://a.com/a b": "http://a.com/a%20b", "http://a.com/a|b": "http://a.com/a|b", "http://a.com/{x}^`": "http://a.com/%7Bx%7D%5E%60", "http://a.com/%zz": "http://a.com/%zz", "http://a.com/x?": "http://a.com/x?", "http://a.com/x#": "http://a.com/x#", "http://a.com?x#y": "http://a.com/?x#y",
    "http://bücher.example/ü?ü=ß#ü": "http://xn--bcher-kva.example/%C3%BC?%C3%BC=%C3%9F#%C3%BC", "https://\U0001f600.com/\U0001f600": "https://xn--e28h.com/%F0%9F%98%80",
    " HTTP://A.com\\x\\..\\y?a'b ": "http://a.com/y?a%27b", "http:a.com": "http://a.com/", "http:///a.com/x": "http://a.com/x", "http://a.com/\tx\ny": "http://a.com/xy",
    "http://u:p@h.com/": "http://u:p@h.com/", "http://@h.com/": "http://h.com/", "http://%61.com/": "http://a.com/", "http://a_b.com/": "http://a_b.com/", "http://1.2.3.4/": "http://1.2.3.4/", "http://[::1]:80/x": "http://[::1]/x",
    "http://h.com:99999/": None, "http://h.com:x/": None, "http://": None, "http://a b/": None, "http://a^b/": None, "http://1.2.3.256/": None, "http://a.1/": None, "ftp://a.b/c": None, "mailto:x@y": None, "x y": None, "": None,
}


def test_href(spark):
    assert values(spark, urls.href, [*WRITTEN, None]) == [*WRITTEN.values(), None]
    again = [w for w in WRITTEN.values() if w]
    assert values(spark, urls.href, again) == again
    hosts = values(spark, urls.host, ["http://A.com:8080/x", "http://u:p@bücher.example/", "http://[::1]:80/x", "ftp://A.b/c", "http://a b/", None])
    assert hosts == ["a.com", "xn--bcher-kva.example", "[::1]", "a.b", None, None]


def test_resolved(spark):
    cases = {
        "/für": "https://a.b/f%C3%BCr", "http://x.y/z": "http://x.y/z", "//c.d/e": "https://c.d/e", "#top": "https://a.b/c/d?q=1#top", "page2.html": "https://a.b/c/page2.html", "../x": "https://a.b/x", "../../../x": "https://a.b/x",
        "?q=2": "https://a.b/c/d?q=2", "HTTP://b.c/": "http://b.c/", "": "https://a.b/c/d?q=1", "./y": "https://a.b/c/y", "x y": "https://a.b/c/x%20y", " /p\n": "https://a.b/p", "/a/../b": "https://a.b/b", "\\z": "https://a.b/z", "/the,": "https://a.b/the,",
        "mailto:a@b": None, "javascript:void(0)": None, "http://a b/": None,
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, h string").orderBy("i")
    assert [r[0] for r in df.select(urls.resolved(F.col("h"), F.lit("https://a.b/c/d?q=1#f"))).collect()] == list(cases.values())
    got = df.where("h = '../x'").select(*(urls.resolved(F.col("h"), F.lit(b)) for b in ("HTTP://A.B:80/c/d/e", "no url", None))).first()
    assert tuple(got) == ("http://a.b/c/x", None, None)
