"""Records to text. Each page is one expression; a whole report is assembled from them in order.

Headings, labels, table rows, class names and field names below are fixed values: readers of the outputs rely on them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import EXTENSIONS, FORMATS, HTML_LINKS, MIME_TYPES
from corpusloom.functions import text as tx
from corpusloom.operators import stats
from corpusloom.sinks.report import Frame

SCRAPED_AT = "1970-01-01T00:00:00.000Z"


def _with_times(df: DataFrame) -> DataFrame:
    """Time columns, if a source has none."""
    if "scraped_at" not in df.columns:
        df = df.withColumn("scraped_at", F.lit(SCRAPED_AT))
    return df if "scrape_ms" in df.columns else df.withColumn("scrape_ms", F.lit(0).cast("long"))


def _cat(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def markdown_page(df: DataFrame) -> DataFrame:
    """Adds `formatted`: a title, a table of fields, then an error or headings, content and links."""
    ok = F.col("status") == "SUCCESS"
    fields = [
        ("URL", F.col("url")), ("Status", F.col("status")), ("HTTP Status", _s("status_code")), ("Content Type", F.col("content_type")), ("Words", _s("word_count")),
        ("Language", F.col("language")), ("Content Hash", tx.or_default(F.col("content_hash"), "N/A")), ("Scraped At", F.col("scraped_at")), ("Duration", _cat(_s("scrape_ms"), "ms")), ("Depth", _s("depth")),
    ]
    head = [_cat("# ", F.when(ok, "✓").otherwise("✗"), " ", tx.or_default(F.col("title"), "Untitled Page")), "", "## Metadata", "", "| Field | Value |", "|-------|-------|"]
    head += [_cat(f"| {k} | ", v, " |") for k, v in fields] + [F.when(tx.or_default(F.col("parent_url"), "") != "", _cat("| Parent URL | ", F.col("parent_url"), " |")), ""]
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    error = ["---", "## Error", _cat("```\n", F.col("error_message"), "\n```"), ""]
    shape = F.when(F.size("headings") > 0, F.concat_ws("\n", F.lit("---"), F.lit("## Page Structure"), listed("headings"), F.lit("")))
    links = F.when(F.size("links") > 0, F.concat_ws("\n", F.lit("---"), _cat("## Links (", F.size("links").cast("string"), " total)"), listed("links"), F.lit("")))
    body = F.concat_ws("\n", shape, F.lit("---"), F.lit("## Content"), F.lit(""), F.col("content"), F.lit(""), links)
    lines = lambda xs: F.concat_ws("\n", *(x if isinstance(x, Column) else F.lit(x) for x in xs))
    failed = (F.col("status") == "FAILED") & (tx.or_default(F.col("error_message"), "") != "")
    return _with_times(df).withColumn("formatted", F.concat_ws("\n", lines(head), F.when(failed, lines(error)).otherwise(body)))


def html_page(df: DataFrame) -> DataFrame:
    """Adds `formatted`: an article with all values escaped and the first links."""
    e = lambda c: tx.escape_html(F.col(c) if isinstance(c, str) else c)
    ok = F.col("status") == "SUCCESS"
    css = F.when(ok, "success").otherwise("failed")
    anchor = lambda c: _cat('<a href="', c, '">', c, "</a>")
    section = lambda cls, title, body: _cat(f'<section class="{cls}"><h2>', title, "</h2>", body, "</section>")
    items = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), f(tx.escape_html(x)), F.lit("</li>"))), "")
    more = F.when(F.size("links") > HTML_LINKS, _cat('<li class="more">... and ', (F.size("links") - HTML_LINKS).cast("string"), " more links</li>")).otherwise("")
    facts = [("Status", _s("status_code")), ("Words", _s("word_count")), ("Language", F.col("language")), ("Duration", _cat(_s("scrape_ms"), "ms")), ("Depth", _s("depth")), ("Content Type", F.col("content_type"))]
    parts = [
        _cat('<article class="', css, '" data-url="', e("url"), '" data-depth="', _s("depth"), '" data-status="', F.col("status"), '">'),
        _cat("<header><h1>", e(tx.or_default(F.col("title"), "Untitled")), '</h1><span class="badge ', css, '">', F.upper(css), "</span>"),
        _cat('<p class="source">Source: ', anchor(e("url")), "</p>"),
        _cat('<div class="meta-grid">', *(x for k, v in facts for x in (f"<span><strong>{k}:</strong> ", v, "</span>")), "</div>"),
        F.when(tx.or_default(F.col("parent_url"), "") != "", _cat('<p class="parent">Parent: ', anchor(e("parent_url")), "</p>")),
        "</header>",
        F.when(~ok & (tx.or_default(F.col("error_message"), "") != ""), section("error", "Error", _cat("<pre>", e("error_message"), "</pre>"))),
        F.when(F.size("headings") > 0, section("structure", "Page Structure", _cat('<ul class="headings">', items("headings", lambda x: x), "</ul>"))),
        F.when(F.col("content") != "", section("content", "Content", _cat('<div class="text">', tx.line_breaks(e("content")), "</div>"))),
        F.when(F.size("links") > 0, section("extracted-links", _cat("Links (", F.size("links").cast("string"), ")"), _cat('<ul class="links">', items(F.slice("links", 1, HTML_LINKS), lambda x: anchor(x)), more, "</ul>"))),
        _cat('<footer class="hash">Content Hash: <code>', tx.or_default(F.col("content_hash"), "N/A"), "</code></footer>"),
        "</article>",
    ]
    return _with_times(df).withColumn("formatted", F.concat_ws("\n", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def json_rows(df: DataFrame) -> DataFrame:
    """The records without cleaned html, nested as they are written."""
    own = _with_times(df)
    meta = F.struct("scraped_at", "scrape_ms", "depth", "parent_url", "status_code", "content_type", "word_count", "language", "content_hash", "status", "error_message")
    return own.select(*(c for c in ("page_id",) if c in own.columns), "url", "title", "headings", "content", "links", meta.alias("metadata"))


def summary_rows(df: DataFrame) -> DataFrame:
    own = _with_times(df)
    return own.select(
        *(c for c in ("page_id",) if c in own.columns), "url", "title", tx.summary(F.col("content")).alias("summary"), "status", "error_message",
        F.struct("word_count", "language", "content_hash").alias("analysis"), F.struct("scraped_at", "scrape_ms", "depth").alias("timing"),
    )


def links_only_rows(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in ("page_id",) if c in df.columns), "url", "title", F.size("links").cast("long").alias("link_count"), "links")


#: Names of the fields in JSON output.
FIELD_NAMES = {
    "scraped_at": "scrapedAt", "scrape_ms": "scrapeDurationMs", "parent_url": "parentUrl", "status_code": "statusCode", "content_type": "contentType",
    "word_count": "wordCount", "content_hash": "contentHash", "error_message": "errorMessage", "link_count": "linkCount",
}


def _as_written(df: DataFrame) -> list[Column]:
    """The columns of df, and the fields of its structs, by the names of JSON output."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if hasattr(f.dataType, "fields"):
            c = F.struct(*(c[x.name].alias(FIELD_NAMES.get(x.name, x.name)) for x in f.dataType.fields))
        out.append(c.alias(FIELD_NAMES.get(f.name, f.name)))
    return out


def formatted_rows(df: DataFrame, kind: str) -> DataFrame:
    """One column `formatted` per page; an unknown format is JSON."""
    if kind == "MARKDOWN":
        return markdown_page(df)
    if kind == "HTML":
        return html_page(df)
    rows = {"SUMMARY": summary_rows, "LINKS_ONLY": links_only_rows}.get(kind, json_rows)(df)
    return rows.withColumn("formatted", F.to_json(F.struct(*_as_written(rows.drop("page_id")))))


def statistics_record(s, languages: dict[str, int]) -> dict:
    """Statistics by the names of JSON output, from their row and the pages by language."""
    return {
        "totalPages": s.total_pages, "successCount": s.success_count, "failedCount": s.failed_count, "successRate": f"{s.success_rate:.1f}%" if s.total_pages else "0%", "totalWords": s.total_words,
        "averageWordsPerPage": s.average_words_per_page, "totalLinks": s.total_links, "averageScrapeTimeMs": s.average_scrape_time_ms, "languageBreakdown": languages,
    }


STYLE = "body{font:16px sans-serif;max-width:60rem;margin:auto;padding:1rem}article{border:1px solid #ccc;padding:1rem;margin:1rem 0}article.failed{border-color:#c00}.error{background:#fee}"


def frame(df: DataFrame, kind: str, generated_at: str) -> Frame:
    """What stands around the pages of a whole report: its statistics before them, and what parts and ends them."""
    s = stats.statistics(_with_times(df), F.col("scrape_ms")).first()
    table = [("Total Pages", s.total_pages), ("Successful", s.success_count), ("Failed", s.failed_count), ("Success Rate", f"{s.success_rate:.1f}%"), ("Total Words", s.total_words), ("Avg Words/Page", s.average_words_per_page), ("Avg Scrape Time", f"{s.average_scrape_time_ms}ms")]
    if kind == "MARKDOWN":
        head = ["# Scraped Content", "", f"**Generated:** {generated_at}", "", "## Statistics", "", "| Metric | Value |", "|--------|-------|", *(f"| {k} | {v} |" for k, v in table), "", "---", "", ""]
        return Frame("\n".join(head), between="\n---\n\n")
    if kind == "HTML":
        cells = "".join(f'<div class="stat"><b>{v}</b> {k}</div>' for k, v in table if k != "Avg Words/Page")
        head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>Scraped Content</title><style>{STYLE}</style></head>\n<body><h1>Scraped Content</h1><div class="stats">{cells}</div><p>Generated: {generated_at}</p>\n'
        return Frame(head, between="\n", last="\n", tail="</body></html>")
    head = {"formatType": kind if kind in FORMATS else "JSON", "generatedAt": generated_at}
    if kind == "LINKS_ONLY":
        head |= {"totalPages": s.total_pages, "totalLinks": s.total_links}
    else:
        languages = stats.language_map(df).first()["languages"] or {}  # an entry a language
        head |= {"statistics": statistics_record(s, dict(sorted(languages.items())))}
    return Frame(json.dumps(head)[:-1] + ', "results": [', "\n", ",\n", tail="\n]}")


def document(df: DataFrame, kind: str, order: str, generated_at: str) -> Iterator[str]:
    """A whole report in pieces, for one that is to be shown; its pages come to the driver one partition at a time. Reports
    are written with sinks.report.write_report(), where none does."""
    around = frame(df, kind, generated_at)
    yield around.head
    empty = True
    for r in ordered(df, kind, order).toLocalIterator():
        yield (around.first if empty else around.between) + r["formatted"]
        empty = False
    yield ("" if empty else around.last) + around.tail


def ordered(df: DataFrame, kind: str, order: str) -> DataFrame:
    """The formatted pages alone, in order over all partitions."""
    return formatted_rows(df, kind).orderBy(order).select("formatted")


def output_name(kind: str, stem: str = "scrape-output") -> tuple[str, str]:
    """File name and MIME type of a format."""
    extension = EXTENSIONS.get(kind, "json")
    return f"{stem}.{extension}", MIME_TYPES[extension]


RULE = "=" * 50


def validation_text(report, failed: list, missing: list, generated_at: str) -> str:
    """The report in words; failed and missing are the first rows."""
    out = [RULE, "VALIDATION REPORT", RULE, "", f"Generated: {generated_at}", "", "STATISTICS:"]
    out += [f"  {k + ':':<20}{v}" for k, v in (("Total Crawled", report.total_crawled), ("Total Scraped", report.total_scraped), ("Successful", report.successful), ("Failed", report.failed), ("Missing", report.missing))]
    out += ["", "RATES:"] + [f"  {k + ':':<20}{v:.1f}%" for k, v in (("Success Rate", report.success_rate), ("Failure Rate", report.failure_rate), ("Completeness", report.completeness_rate))] + [""]
    for title, rows, total, show in (("FAILED SCRAPES:", failed, report.failed, lambda r: [f"  - {r.url}", f"    Error: {r.error}"]), ("MISSING SCRAPES:", missing, report.missing, lambda r: [f"  - {r.url}"])):
        if total:
            out += [title, *(x for r in rows for x in show(r)), *([f"  ... and {total - len(rows)} more"] if total > len(rows) else []), ""]
    return "\n".join([*out, RULE])
