"""Crawling a corpus: bounded breadth-first search over its link edges, a level at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import REQUEST_CAP
from corpusloom.functions import urls
from corpusloom.session import checkpointed, working_dir
from corpusloom.sources.pages import fetch


#: Edges of a bucket on average.
BUCKET_EDGES = 4_000_000


class Bucketed:
    """The rows of df as a table in the working folder, dealt into buckets by a column and sorted by it. A join with `rows` on
    that column shuffles the other side only, and lineage ends here. The table is for joins while it is not closed; `stored`
    are the same rows, from its files."""

    def __init__(self, df: DataFrame, column: str, buckets: int):
        self.spark, self.name = df.sparkSession, f"corpusloom_{uuid.uuid4().hex}"
        self.path = f"{working_dir(self.spark)}/{self.name}"
        df.write.format("parquet").option("path", self.path).bucketBy(buckets, column).sortBy(column).saveAsTable(self.name)
        self.rows, self.stored = self.spark.table(self.name), self.spark.read.schema(df.schema).parquet(self.path)

    def close(self, forget: bool = False) -> None:
        """Takes the table out of the catalog; its files stay unless they are to be forgotten."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if forget:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed_edges(edges: DataFrame) -> tuple[Bucketed, int]:
    """The distinct edges(src, dst) without nulls by src, and the number of buckets: that of shuffles, or more for many edges."""
    own = checkpointed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    buckets = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // BUCKET_EDGES))
    return Bucketed(own.repartition(buckets, "src"), "src", buckets), buckets


def reached(level: DataFrame, edges: DataFrame, visited: list[DataFrame]) -> DataFrame:
    """(node, parent) of what one step over edges(src, dst) leads to from level(node) and is in none of visited(node)."""
    out = level.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    for rows in visited:
        out = out.join(rows.select("node"), "node", "left_anti")
    return out


def frontier(edges: DataFrame, seeds: DataFrame, max_depth: int, edge_filter: Column | None = None, cap: int | None = None, on_level: Callable[[int], None] | None = None) -> DataFrame:
    """(node, depth, parent) of what seeds(node) reach over edges(src, dst) within max_depth steps, each node once, at
    its least depth and from its least parent there. The filter applies to edges before any join.

    Edges are written once, in buckets by src, and each level in buckets by node. So a step shuffles the nodes of its level and
    what they reach, but neither the edges nor what was visited. The search ends with the first empty level, or with the
    level that reaches `cap` nodes; that level is whole. on_level gets the number of nodes so far."""
    edges = edges.where(edge_filter) if edge_filter is not None else edges
    kind = edges.schema["dst"].dataType
    first = seeds.select(F.col("node").cast(kind)).distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))
    if max_depth < 1:
        return checkpointed(first)
    table, buckets = bucketed_edges(edges)
    levels = [Bucketed(first, "node", buckets)]
    count = levels[0].stored.count()
    try:
        for depth in range(1, max_depth + 1):
            if on_level:
                on_level(count)
            if cap is not None and count >= cap:
                break
            step = reached(levels[-1].rows, table.rows, [v.rows for v in levels])
            levels.append(Bucketed(step.select("node", F.lit(depth).alias("depth"), "parent"), "node", buckets))
            new = levels[-1].stored.count()
            if not new:
                break
            count += new
    finally:
        table.close(forget=True)
        for level in levels:
            level.close()
    out = levels[0].stored
    for level in levels[1:]:
        out = out.unionByName(level.stored)
    return out


def effective_depth(max_depth: int, include_subpages: bool) -> int:
    return max_depth if include_subpages else 0


def crawl(pages: DataFrame, links: DataFrame, seed_url: str, max_depth: int, include_subpages: bool = True, cap: int | None = REQUEST_CAP, keep_failed: bool = True, on_level: Callable[[int], None] | None = None) -> DataFrame:
    """Discovered urls from a seed, over links(url, link) on the seed's host.

    (url, depth, parent_url, status_code, content_type, crawl_ms, link_type, skipped_reason). A url that the corpus
    lacks is a failed request, or left out without keep_failed. Without subpages the seed alone is given, unfetched.
    The cap takes the first urls by depth and url, and ends the search; None is no cap.
    """
    spark = pages.sparkSession
    seed_host = F.lit(spark.range(1).select(urls.host(F.lit(seed_url))).first()[0])
    seeds = spark.range(1).select(F.lit(seed_url).alias("node"))
    if not include_subpages:
        found, known = seeds.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), seeds.select(F.col("node").alias("url"))
    else:
        edges = links.select(F.col("url").alias("src"), F.col("link").alias("dst"))
        found = frontier(edges, seeds, max_depth, urls.host(F.col("dst")) == seed_host, cap if keep_failed else None, on_level)
        known = pages.join(found.select(F.col("node").alias("url")), "url", "left_semi").select("url").distinct()
    known = known.withColumn("known", F.lit(True))
    joined = found.withColumnRenamed("node", "url").join(known, "url", "left" if keep_failed else "inner")
    ok = F.col("known").isNotNull()
    out = joined.select(
        "url", "depth", F.col("parent").alias("parent_url"),
        F.when(ok, 200).otherwise(0).alias("status_code"), F.when(ok, "text/html").otherwise("unknown").alias("content_type"),
        F.lit(0).cast("long").alias("crawl_ms"), urls.link_type(F.col("url"), seed_host).alias("link_type"),
        F.when(~ok, "Request failed").alias("skipped_reason"),
    )
    return out if cap is None else out.orderBy("depth", "url").limit(cap)


def crawl_live(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], seed_url: str, max_depth: int, include_subpages: bool = True, cap: int | None = REQUEST_CAP, on_level: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The same search over a live site: discovered urls, with measured times, and the records of their pages.

    fetch(urls) gives the rows of urls(url, depth, parent_url) with their pages, as sources.live.fetcher() does. Each level is
    fetched and read once, into a table in the shared folder; its links on the seed's host that are new are the next level. With
    a cap the first urls of a level by url are taken. Without subpages the seed alone is given, unfetched.
    """
    from corpusloom.operators.extract import scrape

    seed_host = F.lit(spark.range(1).select(urls.host(F.lit(seed_url))).first()[0])
    level = spark.range(1).select(F.lit(seed_url).alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
    if not include_subpages:
        seed = level.select("*", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(0).cast("long").alias("crawl_ms"), urls.link_type(F.col("url"), seed_host).alias("link_type"), F.lit(None).cast("string").alias("skipped_reason"))
        return seed, scrape(fetch(level.limit(0)), timed=True)
    records, count = None, 0
    for depth in range(max_depth + 1):
        rows = checkpointed(scrape(fetch(level), timed=True))
        new = rows.count()
        records, count = rows if records is None else records.unionByName(rows), count + new
        if on_level:
            on_level(count)
        if not new or depth == max_depth or (cap is not None and count >= cap):
            break
        found = rows.select(F.col("url").alias("parent_url"), F.explode("links").alias("url")).where(urls.host(F.col("url")) == seed_host)
        found = found.groupBy("url").agg(F.min("parent_url").alias("parent_url")).join(records.select("url"), "url", "left_anti")
        level = found.select("url", F.lit(depth + 1).alias("depth"), "parent_url")
        if cap is not None:
            level = level.orderBy("url").limit(cap - count)
        level = checkpointed(level)
    ok = F.col("status") == "SUCCESS"
    crawled = records.select(
        "url", "depth", "parent_url", "status_code", "content_type", F.col("scrape_ms").alias("crawl_ms"),
        urls.link_type(F.col("url"), seed_host).alias("link_type"), F.when(~ok, "Request failed").alias("skipped_reason"),
    )
    return crawled, records


def crawl_and_scrape(pages: DataFrame, links: DataFrame, seed_url: str, max_depth: int, **options) -> DataFrame:
    """Single pass: the records of what a crawl reaches, with depth and parent from the crawl."""
    from corpusloom.operators.extract import scrape

    found = crawl(pages, links, seed_url, max_depth, keep_failed=False, **options)
    return scrape(fetch(pages, found.select("url", "depth", "parent_url", "status_code", "content_type"), columns=("page_id", "html")))


def total_estimate(done: int | Column, step: int = 5, least: int = 10) -> int | Column:
    """The moving estimate of a crawl's size after so many pages."""
    return max(least, done + step) if isinstance(done, int) else F.greatest(F.lit(least), done + step)
