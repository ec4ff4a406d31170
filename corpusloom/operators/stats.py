"""Aggregates over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import STATUSES
from corpusloom.functions import text as tx


def statistics(scraped: DataFrame, duration: Column | None = None) -> DataFrame:
    """One row; averages are rounded half up, and 0 without pages."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "SUCCESS")
    words, links = F.coalesce(F.sum("word_count"), F.lit(0)), F.coalesce(F.sum(F.size("links").cast("long")), F.lit(0))
    ms = F.coalesce(F.sum(duration if duration is not None else F.lit(0).cast("long")), F.lit(0))
    own = scraped.agg(n.alias("n"), ok.alias("ok"), F.count_if(F.col("status") == "FAILED").alias("bad"), words.alias("words"), links.alias("links"), ms.alias("ms"))
    return own.select(
        F.col("n").alias("total_pages"), F.col("ok").alias("success_count"), F.col("bad").alias("failed_count"),
        tx.tenths(F.col("ok"), F.col("n")).alias("success_rate"),
        F.col("words").alias("total_words"), tx.rounded(F.col("words"), F.col("n")).alias("average_words_per_page"),
        F.col("links").alias("total_links"), tx.rounded(F.col("ms"), F.col("n")).alias("average_scrape_time_ms"),
    )


def language_breakdown(scraped: DataFrame) -> DataFrame:
    return scraped.groupBy(tx.or_default(F.col("language"), "unknown").alias("language")).agg(F.count(F.lit(1)).alias("pages"))


def language_map(scraped: DataFrame) -> DataFrame:
    return language_breakdown(scraped).agg(F.map_from_entries(F.collect_list(F.struct("language", "pages"))).alias("languages"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def crawl_summary(discovered: DataFrame, started_at: Column | None = None, completed_at: Column | None = None) -> DataFrame:
    """One row; with the times of a crawl also those and the milliseconds between them."""
    n = F.count(F.lit(1))
    own = discovered.agg(n.alias("n"), F.count_if(F.col("link_type") == "internal").alias("inner"), F.count_if(F.col("link_type") == "external").alias("outer"), F.coalesce(F.sum("crawl_ms"), F.lit(0)).alias("ms"))
    times = [] if started_at is None or completed_at is None else [started_at.alias("started_at"), completed_at.alias("completed_at"), (F.unix_millis(completed_at) - F.unix_millis(started_at)).alias("total_duration_ms")]
    return own.select(F.col("n").alias("total_urls"), F.col("inner").alias("internal_urls"), F.col("outer").alias("external_urls"), tx.rounded(F.col("ms"), F.col("n")).alias("average_crawl_ms"), *times)
