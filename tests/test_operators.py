import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl, extract, formatters, paging, stats, validate
from corpusloom.plans import export
from corpusloom.plans.engine import Engine
from corpusloom.sources.pages import fetch, requests

PAGE = "<html><title>T&amp;x</title><body><article><h1>H</h1><p>The cat is here.</p><a href='/b'>b</a></article></body></html>"


@pytest.fixture(scope="module")
def site(spark):
    link = lambda *to: "<article><h1>x</h1>the text" + "".join(f'<a href="{t}">l</a>' for t in to) + "</article>"
    rows = [(1, "http://s.example/", link("/a", "/b", "http://other.example/")), (2, "http://s.example/a", link("/b", "/gone", "/a")), (3, "http://s.example/b", link("/")), (4, "http://s.example/island", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_native_and_tree_agree(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    cols = ["page_id", "title", "headings", "content", "links", "word_count", "language", "content_hash", "status"]
    native, tree = (extract.scrape(pages, n).select(cols).orderBy("page_id").collect() for n in (True, False))
    assert native == tree


def test_paths_on_irregular_pages(spark):
    """Other content places, single quotes and elements to cut out: only the tree path takes them."""
    html = "<TITLE>T</TITLE><body><nav>menu</nav><main><h1>H</h1>text<aside>gone</aside><a href='/b'>b</a></main></body>"
    pages = spark.createDataFrame([(1, "http://s.example/", html)], "page_id long, url string, html string")
    tree, native = extract.scrape(pages).first(), extract.scrape(pages, native=True).first()
    assert (tree.title, tree.headings, tree.content, tree.links) == ("T", ["H"], "Htextb", ["http://s.example/b"])
    assert (native.title, native.content, native.links) == ("", "", [])


def test_fetch(spark):
    """Of rows of one url, the one with html and the smallest page_id; nulls and repeated urls in what is wanted."""
    pages = spark.createDataFrame([(3, "u", "c"), (1, "u", None), (2, "u", "b"), (4, "v", None), (5, None, "x")], "page_id long, url string, html string")
    want = spark.createDataFrame([("u",), ("u",), ("v",), ("w",), (None,)], "url string")
    assert sorted(map(tuple, fetch(pages, want).collect()), key=str) == sorted([("u", "b"), ("u", "b"), ("v", None), ("w", None), (None, None)], key=str)
    assert fetch(pages.drop("page_id"), want.limit(1)).first().html == "b"
    plan = fetch(pages, want)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # what is not wanted leaves before pages are grouped


@pytest.mark.parametrize("native", [True, False])
def test_failed_page(site, native):
    r = extract.scrape(site, native).where("page_id = 4").first()
    assert (r.status, r.status_code, r.content_type, r.language, r.content_hash, r.word_count, r.links) == ("FAILED", 0, "unknown", "unknown", "", 0, [])


def test_crawl(spark, site):
    links = extract.scrape(site).select("url", F.explode("links").alias("link"))
    rows = {r.url: r for r in crawl.crawl(site, links, "http://s.example/", 2).collect()}
    assert set(rows) == {"http://s.example/", "http://s.example/a", "http://s.example/b", "http://s.example/gone"}
    assert rows["http://s.example/b"].depth == 1 and rows["http://s.example/b"].parent_url == "http://s.example/"
    gone = rows["http://s.example/gone"]
    assert (gone.status_code, gone.content_type, gone.skipped_reason, gone.depth) == (0, "unknown", "Request failed", 2)
    assert crawl.crawl(site, links, "http://s.example/", 0).count() == 1
    alone = crawl.crawl(site, links, "http://absent.example/", 3, include_subpages=False).collect()
    assert [(r.url, r.status_code) for r in alone] == [("http://absent.example/", 200)]
    assert crawl.crawl(site, links, "http://s.example/", 2, cap=2).count() == 2
    counts = []
    assert crawl.crawl(site, links, "http://s.example/", 5, cap=3, on_level=counts.append).count() == 3 and counts == [1, 3]  # the cap ends the search
    assert crawl.crawl(site, links, "http://s.example/", 2, cap=None).count() == 4
    twice = site.unionByName(site)
    assert crawl.crawl_and_scrape(twice, links, "http://s.example/", 2).count() == 3
    assert {r.depth for r in crawl.crawl_and_scrape(site, links, "http://s.example/", 2).collect()} == {0, 1}


def test_frontier_cycle_and_diamond(spark):
    edges = spark.createDataFrame([(0, 2), (0, 1), (1, 3), (2, 3), (3, 0), (3, 3), (None, 4), (3, None)], "src int, dst int")
    got = sorted(map(tuple, crawl.frontier(edges, spark.createDataFrame([(0,)], "node int"), 9).collect()))
    assert got == [(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 1)]


def test_validation(spark):
    crawled = spark.createDataFrame([("http://a.b/x/",), ("http://a.b/x",), ("http://a.b/y#z",)], "url string")
    done = spark.createDataFrame([("http://a.b/x", "SUCCESS", None, 1), ("http://a.b/q", "FAILED", "", 2)], "url string, status string, error_message string, pos int")
    r = validate.report(crawled, done).first()
    assert (r.total_crawled, r.total_scraped, r.missing, r.success_rate, r.completeness_rate, r.has_failures) == (3, 2, 1, 50.0, 66.7, True)
    assert [x.url for x in validate.missing(crawled, done).collect()] == ["http://a.b/y"]
    assert [x.error for x in validate.failures(done).collect()] == ["Unknown error"]
    assert validate.last_of_each(done).count() == 2
    empty = validate.report(crawled.limit(0), done.limit(0)).first()
    assert (empty.total_crawled, empty.success_rate, empty.all_urls_processed, empty.crawl_to_scrape_match) == (0, 0.0, True, True)
    text = formatters.validation_text(r, validate.failures(done).collect(), validate.missing(crawled, done).collect(), "now")
    assert "  Total Crawled:      3" in text and "    Error: Unknown error" in text


def test_statistics_of_nothing(site):
    s = stats.statistics(extract.scrape(site).limit(0)).first()
    assert (s.total_pages, s.success_rate, s.average_words_per_page, s.total_links) == (0, 0.0, 0, 0)


def test_paging(spark):
    df = spark.range(10)
    pages = [[r.id for r in paging.page_of(df, ["id"], p, 4).collect()] for p in (1, 2, 3, 4)]
    assert pages == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], []]
    i = paging.page_info(df, 3, 4).first()
    assert (i.total, i.total_pages, i.has_next, i.has_prev) == (10, 3, False, True)
    assert paging.parse("0", "9999") == (1, 500) and paging.parse(None, "x") == (1, 100)
    with pytest.raises(ValueError):
        paging.parse("-1", "5")


def test_formats(site):
    rows = extract.scrape(site)
    md = {r.page_id: r.formatted for r in formatters.markdown_page(rows).collect()}
    assert md[1].startswith("# ✓ Untitled Page\n\n## Metadata") and "## Links (3 total)" in md[1] and "## Page Structure\n- x\n" in md[1]
    assert "## Error\n```\nnavigation failed\n```" in md[4] and "## Content" not in md[4]
    for kind in ("JSON", "MARKDOWN", "SUMMARY", "LINKS_ONLY", "HTML", "other"):
        text = "".join(formatters.document(rows, kind, "page_id", "now"))
        assert "s.example" in text and "now" in text
    import json

    out = json.loads("".join(formatters.document(rows, "SUMMARY", "page_id", "now")))
    assert len(out["results"]) == 4 and out["statistics"]["languageBreakdown"] == {"en": 3, "unknown": 1} and out["statistics"]["successRate"] == "75.0%"
    assert set(out["statistics"]) == {"totalPages", "successCount", "failedCount", "successRate", "totalWords", "averageWordsPerPage", "totalLinks", "averageScrapeTimeMs", "languageBreakdown"}
    assert set(out["results"][0]["analysis"]) == {"wordCount", "language", "contentHash"} and set(out["results"][0]["timing"]) == {"scrapedAt", "scrapeDurationMs", "depth"}
    out = json.loads("".join(formatters.document(rows, "JSON", "page_id", "now")))
    assert {"statusCode", "contentType", "errorMessage"} <= set(out["results"][3]["metadata"])
    assert formatters.output_name("MARKDOWN") == ("scrape-output.md", "text/markdown")


def test_a_level_shuffles_neither_edges_nor_visited(spark):
    """Of a step, what it starts from and what it reaches is shuffled, and no more."""
    ids = spark.range(5_000)
    table, buckets = crawl.bucketed_edges(ids.selectExpr("id AS src", "(id * 7 + 3) % 5000 AS dst").unionByName(ids.selectExpr("id AS src", "(id + 1) % 5000 AS dst")))
    seen = [crawl.Bucketed(spark.range(a, a + 100).selectExpr("id AS node"), "node", buckets) for a in (0, 900)]
    level = spark.range(2_500).selectExpr("id AS node")
    assert {r.node for r in crawl.reached(level.limit(1), table.rows, [s.rows for s in seen]).collect()} == set() and {r.node for r in crawl.reached(level.limit(1), table.rows, []).collect()} == {1, 3}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = crawl.reached(level, table.rows, [s.rows for s in seen])
        plan = step._jdf.queryExecution().executedPlan().toString()
        got = {r.node for r in step.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {d for i in range(2_500) for d in ((i * 7 + 3) % 5000, (i + 1) % 5000)} - set(range(100)) - set(range(900, 1000))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 3
    table.close(forget=True)
    for s in seen:
        s.close()
        assert s.stored.count() == 100
    assert not spark.catalog.tableExists(table.name)


def test_page_index(spark):
    """The pages of page_of, each from two ranges at most."""
    df = spark.range(3_000).selectExpr("(id * 7919) % 3000 AS place", "id % 13 AS other").repartition(5)
    index = paging.PageIndex(df, ["place"], rows=100)
    assert len(index.ranges) > 10 and index.total == 3_000
    for page, limit in ((1, 10), (7, 99), (30, 100), (300, 10), (301, 10), (1, 500), (6, 500), (7, 500)):
        assert index.page(page, limit).collect() == paging.page_of(df, ["place"], page, limit).collect()
        assert limit > 50 or len(index.of(page, limit)) <= 2
        assert index.info(page, limit) == paging.page_info(df, page, limit).first().asDict()
    empty = paging.PageIndex(df.limit(0), ["place"])
    assert empty.page(1, 10).collect() == [] and empty.info(1, 10)["total"] == 0


@pytest.mark.parametrize("kind", ["JSON", "MARKDOWN", "SUMMARY", "LINKS_ONLY", "HTML", "other"])
def test_report_from_many_tasks(spark, site, tmp_path, kind):
    """The file is that of document(), whatever the number of tasks, and replaces the one before."""
    rows = extract.scrape(site.unionByName(site.selectExpr("page_id + 100 AS page_id", "url || 'x' AS url", "html")))
    for some in (rows, rows.limit(0)):
        path = export.write_report(some, f"file://{tmp_path}/out", kind, "page_id", "now")
        assert open(path.removeprefix("file://"), newline="").read() == "".join(formatters.document(some, kind, "page_id", "now"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == [path.rsplit("/", 1)[1]]


def test_report_parts_are_in_order(spark, tmp_path):
    from corpusloom.sinks.report import Frame, write_report

    pages = spark.range(20_000).selectExpr("id", "'page ' || id AS text").repartition(7).orderBy("id").select("text")
    write_report(pages, f"file://{tmp_path}/r.txt", Frame("head\n", "<", "\n", ">", "\ntail"))
    assert (tmp_path / "r.txt").read_text() == "head\n<" + "\n".join(f"page {i}" for i in range(20_000)) + ">\ntail"
    with pytest.raises(Exception, match="one column of text"):
        write_report(spark.range(3), f"file://{tmp_path}/s.txt", Frame())

    def breaks(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        write_report(pages.mapInArrow(breaks, "text string"), f"file://{tmp_path}/r.txt", Frame())
    assert (tmp_path / "r.txt").read_text().startswith("head") and sorted(p.name for p in tmp_path.iterdir()) == ["r.txt"]


def test_fetch_one_that_fails(spark, site):
    """S3: a page that is not there ends the query."""
    want = spark.createDataFrame([("http://s.example/a",), ("http://s.example/none",)], "url string")
    assert fetch(site, want.limit(1), fail_fast=True).first().html
    with pytest.raises(Exception, match="navigation failed: http://s.example/none"):
        fetch(site, want, fail_fast=True).collect()


def test_request_lines(spark):
    """S7: lines with their fields, and those that are none."""
    lines = ['{"seedUrl": "http://a.b/", "depth": 2, "more": [1]}', "{}", "", "null", "[{}]", '{"depth": "two"}', '{"seedUrl": "x"', None]
    got = requests(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string"), keep=True).orderBy("i").collect()
    assert [(r.seedUrl, r.depth) for r in got] == [("http://a.b/", 2)] + [(None, None)] * 7
    assert [r.malformed is None for r in got] == [True, True] + [False] * 6


def test_language_map(site):
    assert stats.language_map(extract.scrape(site)).first().languages == {"en": 3, "unknown": 1}


def test_engine_and_export(spark, site, tmp_path):
    engine = Engine(spark, site)
    out = engine.process({"seedUrl": "http://s.example/", "includeSubpages": True, "depth": 9, "operationMode": "CRAWL_AND_SCRAPE", "outputFormat": None, "orgName": None, "processId": None})
    r = out["report"].first()
    assert (r.total_crawled, r.total_scraped, r.failed) == (4, 4, 1)
    with pytest.raises(ValueError, match="seedUrl is required"):
        engine.process({"seedUrl": "", "includeSubpages": None, "depth": None, "operationMode": None, "outputFormat": None, "orgName": None, "processId": None})
    job = {"id": "j", "status": "COMPLETED", "seed_url": "http://s.example/", "mode": "CRAWL_AND_SCRAPE", "depth": 2, "subpages": True}
    files = export.export_job(job, out["crawled"], out["scraped"], r, f"file://{tmp_path}", "run1", "MARKDOWN", "now")
    assert (tmp_path / "s" / "run1" / "scrape-results.md").read_text().startswith("# Scraped Content")
    assert spark.read.json(files["crawl_results"]).count() == 4
    summary = (tmp_path / "s" / "run1" / "summary.txt").read_text()
    assert "Pages Scraped:    4" in summary and "FAILED URLS (first 10):\n  - http://s.example/gone\n    Error: navigation failed\n\n" in summary and "more" not in summary
    bad = spark.range(13).selectExpr("'http://s.example/' || lpad(id, 2, '0') AS url", "'FAILED' AS status", "'' AS error_message")
    told = export.export_text(job, None, bad, validate.report(bad, bad).first(), "now")
    assert told.count("    Error: Unknown error") == 10 and "  - http://s.example/09\n    Error: Unknown error\n  ... and 3 more\n" in told
    for kind, name in (("SUMMARY", "txt"), ("LINKS_ONLY", "txt"), ("HTML", "html"), ("JSON", "json")):
        assert export.export_job(job, None, out["scraped"], None, f"file://{tmp_path}", kind, kind, "now")["scrape_results"].endswith(f"/scrape-results.{name}")
    times = out["scraped"].agg(F.min("scraped_at"), F.min("scrape_ms")).first()
    assert times[0] > "2024" and times[1] >= 0 and "1970" not in (tmp_path / "s" / "run1" / "scrape-results.md").read_text()
    with pytest.raises(ValueError, match="RUNNING"):
        export.export_job(job | {"status": "RUNNING"}, None, None, None, "x", "y")
    export.write_table(out["crawled"], f"file://{tmp_path}/t", "csv", org="s")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").count() == 4


def test_every_page_of_a_url(spark, tmp_path):
    """Of two pages of one url each counts for each time that the url is asked for, as in the SQL of scrape_failed."""
    import duckdb

    from corpusloom.plans import registry
    from corpusloom.sources.pages import fetch

    rows = [(i, u, f"<title>t{i} &amp</title><article>the text {i}</article>") for i, u in ((1, "http://s.example/a"), (5, "http://s.example/a"), (10, "http://s.example/b"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["scrape_failed"](spark, str(tmp_path)).collect()
    assert len(got) == 7 and sorted(map(tuple, got)) == sorted(duckdb.sql(registry.SQL["scrape_failed"]).fetchall())
    urls = pages.select("url").distinct()
    assert fetch(pages, urls, every=True, fail_fast=True).count() == 3 and fetch(pages, urls).count() == 2
