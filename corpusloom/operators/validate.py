"""Crawl against scrape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import REPORT_ROWS
from corpusloom.functions import text as tx
from corpusloom.functions import urls


def last_of_each(scraped: DataFrame, order: str = "pos") -> DataFrame:
    """One record for each normalised url, the last one."""
    rest = [c for c in scraped.columns]
    own = scraped.withColumn("norm", urls.normalized(F.col("url")))
    return own.groupBy("norm").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select("norm", "r.*")


def missing(crawled: DataFrame, scraped: DataFrame) -> DataFrame:
    """(url): distinct normalised urls that were crawled and not scraped."""
    want = crawled.select(urls.normalized(F.col("url")).alias("url")).distinct()
    return want.join(scraped.select(urls.normalized(F.col("url")).alias("url")), "url", "left_anti")


def failures(scraped: DataFrame) -> DataFrame:
    return scraped.where(F.col("status") == "FAILED").select("url", tx.or_default(F.col("error_message"), "Unknown error").alias("error"))


def first_rows(df: DataFrame, order: str, most: int = REPORT_ROWS) -> tuple[DataFrame, int]:
    """The first rows of a report and how many more there are."""
    return df.orderBy(order).limit(most), max(0, df.count() - most)


def report(crawled: DataFrame, scraped: DataFrame) -> DataFrame:
    """One row of counts, rates in per cent and booleans."""
    a = crawled.agg(F.count(F.lit(1)).alias("total_crawled"))
    b = scraped.agg(F.count(F.lit(1)).alias("total_scraped"), F.count_if(F.col("status") == "SUCCESS").alias("successful"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    c = missing(crawled, scraped).agg(F.count(F.lit(1)).alias("missing"))
    one = a.join(b, F.lit(True)).join(c, F.lit(True))  # one row each
    n, s = F.col("total_crawled"), F.col("total_scraped")
    return one.select(
        "total_crawled", "total_scraped", "successful", "failed", "missing",
        tx.tenths(F.col("successful"), s).alias("success_rate"), tx.tenths(F.col("failed"), s).alias("failure_rate"), tx.tenths(s, n).alias("completeness_rate"),
        (n == s).alias("crawl_to_scrape_match"), (F.col("missing") == 0).alias("all_urls_processed"), (F.col("failed") > 0).alias("has_failures"), (F.col("missing") > 0).alias("has_missing"),
    )
