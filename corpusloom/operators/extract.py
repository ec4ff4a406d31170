"""Pages to records: a native path for regular markup, the tree path for any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators.dom import extract_udf

ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain(c: Column) -> Column:
    return decoded(F.regexp_replace(c, "<[^>]*>", ""))


def native_title(html: Column) -> Column:
    return tx.collapsed(decoded(F.regexp_extract(html, "<title>([^<]*)</title>", 1)))


def native_content(html: Column) -> Column:
    return tx.collapsed(plain(F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1)))


def native_headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit("(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.filter(F.transform(found, lambda h: tx.trimmed(plain(h))), lambda h: h != "")


def native_links(html: Column, url: Column) -> Column:
    return absolute_links(F.transform(F.regexp_extract_all(html, F.lit('<a [^>]*?href="([^"]*)"'), F.lit(1)), decoded), url)


def absolute_links(references: Column, url: Column) -> Column:
    """The http links that references in the page at `url` stand for, each at its first place."""
    return F.array_distinct(F.filter(F.transform(references, lambda h: urls.resolved(h, url)), lambda h: h.isNotNull()))


def scrape(pages: DataFrame, native: bool = False, timed: bool = False, passed: Callable[[int], None] | None = None, bare: bool = True) -> DataFrame:
    """Records of pages(page_id, url, html, ...): title, headings, content, links, metrics, status.

    The tree path takes any markup. The native path is for corpora whose pages have one plain `<article>`, a `<title>` and
    quoted `href` values, and cuts nothing out; there, columns that are not selected afterwards are not computed. A page without html is FAILED: empty
    fields, status code 0, type unknown. On the tree path, a page that can't be parsed keeps its HTTP data. Optional
    columns depth, parent_url, status_code and content_type are kept over the defaults, and so is the error_message of a
    source for pages without html.

    `timed` adds scraped_at, as text, and scrape_ms: when the source fetched the page, if it tells, and how long that and
    the extraction took. The native path measures no single pages; its time is that of the query. passed(n) is called in
    the tasks of the tree path after every n pages. The tree path reads old character references without a semicolon as browsers
    do, unless `bare` is false: then, as on the native path, only those with one are references.
    """
    html, url = F.col("html"), F.col("url")
    has = set(pages.columns)
    said = F.coalesce(F.col("error_message"), F.lit("navigation failed")) if "error_message" in has else F.lit("navigation failed")
    http = {
        "depth": F.coalesce(F.col("depth"), F.lit(0)) if "depth" in has else F.lit(0),
        "parent_url": F.col("parent_url") if "parent_url" in has else F.lit(None).cast("string"),
        "status_code": F.when(html.isNull(), 0).otherwise(F.coalesce(F.col("status_code"), F.lit(200)) if "status_code" in has else F.lit(200)),
        "content_type": F.when(html.isNull(), "unknown").otherwise(F.coalesce(tx.content_type_base(F.col("content_type")), F.lit("text/html")) if "content_type" in has else F.lit("text/html")),
    }
    if native:
        got = pages.withColumns({"title": F.coalesce(native_title(html), F.lit("")), "headings": F.coalesce(native_headings(html), F.array().cast("array<string>")), "content": F.coalesce(native_content(html), F.lit("")), "links": F.coalesce(native_links(html, url), F.array().cast("array<string>")), "cleaned_html": F.coalesce(F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1), F.lit("")), "error_message": F.when(html.isNull(), said), "at": tx.iso_time(F.current_timestamp()), "ms": F.lit(0).cast("long")})
    else:
        got = pages.withColumn("x", extract_udf("html", passed, bare)).withColumns({"title": F.col("x.title"), "headings": F.col("x.headings"), "content": F.col("x.content"), "links": absolute_links(F.col("x.references"), url), "cleaned_html": F.col("x.cleaned_html"), "error_message": F.when(html.isNull(), said).otherwise(F.col("x.error")), "at": F.col("x.at"), "ms": F.col("x.ms")})
    got = got.withColumns(http)
    times = []
    if timed:
        at, ms = F.col("at"), F.col("ms")
        times = [(F.coalesce(tx.iso_time(F.col("scraped_at")), at) if "scraped_at" in has else at).alias("scraped_at"), (F.coalesce("scrape_ms", F.lit(0)) + ms if "scrape_ms" in has else ms).cast("long").alias("scrape_ms")]
    failed = F.col("error_message").isNotNull()
    return got.select(
        *(c for c in ("page_id",) if c in has), "url", "title", "headings", "content", "links", "cleaned_html",
        tx.word_count(F.col("content")).alias("word_count"),
        F.when(failed, "unknown").otherwise(tx.language(F.col("content"))).alias("language"),
        tx.content_hash(F.col("content")).alias("content_hash"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        "error_message", "depth", "parent_url", "status_code", "content_type", *times,
    )


def page_links(scraped: DataFrame) -> DataFrame:
    return scraped.select("page_id", F.posexplode("links").alias("pos", "link"))


def page_headings(scraped: DataFrame) -> DataFrame:
    return scraped.select("page_id", F.posexplode("headings").alias("pos", "heading"))
