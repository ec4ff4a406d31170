"""The three modes of processing over a corpus."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import REQUEST_CAP
from corpusloom.operators import crawl as cr
from corpusloom.operators import stats, validate
from corpusloom.operators.extract import scrape
from corpusloom.plans import progress
from corpusloom.plans import requests as rq
from corpusloom.schemas import REQUEST
from corpusloom.session import checkpointed
from corpusloom.sources.pages import fetch


def links_of(scraped: DataFrame) -> DataFrame:
    return scraped.select("url", F.explode("links").alias("link"))


def _quiet(kind: str, value: str | None = None, completed: int | None = None, total: int | None = None) -> None:
    pass


class Engine:
    """Over a corpus of pages, or over a site: `live` then fetches urls, as sources.live.fetcher() makes it.

    `cap` is the number of urls of a crawl, None for no bound; `native` takes the native path of extraction."""

    def __init__(self, spark: SparkSession, pages: DataFrame | None, native: bool = False, cap: int | None = REQUEST_CAP, live: Callable[[DataFrame], DataFrame] | None = None):
        if (pages is None) == (live is None):
            raise ValueError("an engine needs either pages or a live source")
        self.spark, self.pages, self.native, self.cap, self.live = spark, pages, native, cap, live

    def _checked(self, request: dict, error: str) -> dict:
        row = rq.checked(self.spark.createDataFrame([request], REQUEST)).first().asDict()
        if row[error]:
            raise ValueError(row[error])
        return row

    def process(self, request: dict) -> dict[str, DataFrame]:
        """The tables of CRAWL_ONLY, SCRAPE_ONLY or CRAWL_AND_SCRAPE by name; the last also validates."""
        row = self._checked(request, "error_v1")
        depth = cr.effective_depth(row["depth_v1"], row["includeSubpages"] is not False)
        out: dict[str, DataFrame] = {}

        def keep(name: str, rows: DataFrame) -> DataFrame:
            out[name] = checkpointed(rows)
            return out[name]

        self.run(row["seedUrl"], depth, row["includeSubpages"] is not False, row["operationMode"], keep)
        return out

    def run(self, seed: str, depth: int, subpages: bool, mode: str, keep: Callable[[str, DataFrame], DataFrame], tell: Callable = _quiet) -> None:
        """Does what a mode asks for. keep(name, rows) gets each result as soon as there is one and gives the rows as they are
        kept; tell(kind, value, completed, total) gets phases and progress meanwhile."""
        if mode == "SCRAPE_ONLY":
            scraped = self._scraped(self.spark.range(1).select(F.lit(seed).alias("url")), 1, keep, tell)
        else:
            tell("phase", "CRAWLING")
            began = datetime.now(UTC)
            on_level = lambda n: tell("crawl", completed=n, total=cr.total_estimate(n))
            if self.live:
                found, fetched = cr.crawl_live(self.spark, self.live, seed, depth, subpages, self.cap, on_level)
            else:
                links = links_of(scrape(self.pages, self.native))
                found = cr.crawl(self.pages, links, seed, depth, subpages, self.cap, on_level=on_level)
            crawled = keep("crawled", found)
            n = crawled.count()
            tell("crawl", completed=n, total=n)
            keep("crawl_summary", stats.crawl_summary(crawled, F.lit(began), F.lit(datetime.now(UTC))))
        if mode == "CRAWL_AND_SCRAPE":
            if self.live and subpages:
                # Every page was fetched and read once, in the crawl.
                tell("phase", "SCRAPING")
                scraped = keep("scraped", fetched.join(crawled.select("url"), "url", "left_semi"))
                tell("scrape", completed=n, total=n)
            else:
                scraped = self._scraped(crawled.select("url", "depth", "parent_url"), n, keep, tell)
            tell("phase", "VALIDATING")
            keep("report", validate.report(crawled, scraped))
            keep("missing", validate.missing(crawled, scraped))
        if mode != "CRAWL_ONLY":
            keep("statistics", stats.statistics(scraped, F.col("scrape_ms")))

    def _scraped(self, wanted: DataFrame, n: int, keep: Callable, tell: Callable) -> DataFrame:
        """The records of pages, with progress as tasks end while they are made."""
        tell("phase", "SCRAPING")
        tell("scrape", completed=0, total=n)
        pages = self.live(wanted) if self.live else fetch(self.pages, wanted)
        with progress.counted(self.spark, lambda done: tell("scrape", completed=min(done, n), total=n)) as passed:
            own = progress.through(scrape(pages, True, timed=True), passed) if self.native else scrape(pages, timed=True, passed=passed)
            out = keep("scraped", own)
        tell("scrape", completed=n, total=n)
        return out

    def job(self, spark: SparkSession, config: dict, tell: Callable, keep: Callable) -> None:
        """The work of a submitted job, for JobRunner."""
        row = self._checked(config, "error_v2")
        subpages = row["includeSubpages"] is not False
        self.run(row["seedUrl"], cr.effective_depth(row["depth_v2"], subpages), subpages, row["mode_v2"], keep, tell)
