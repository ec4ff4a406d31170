import pytest

from corpusloom.plans.api import Service
from corpusloom.plans.store import TableStore

REQUEST = {"seedUrl": "http://s.example/", "includeSubpages": True, "depth": 1, "operationMode": None, "outputFormat": None, "orgName": "An Org", "processId": None}


def test_job_from_start_to_export(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://s.example/", '<article>the text<a href="/a">l</a></article>'), (2, "http://s.example/a", "<article>more</article>")], "page_id long, url string, html string")
    service = Service(spark, pages)
    assert service.health()["status"] == "ok"
    with pytest.raises(ValueError, match="depth must be between"):
        service.submit(REQUEST | {"depth": 11})
    job = service.submit(REQUEST)
    assert service.runner.wait(job, 120) == "COMPLETED"
    assert service.status(job)["status"] == "COMPLETED" and service.status("none") is None and service.progress("none") is None
    assert service.stats().first().completed == 1 and service.list("FAILED").count() == 0
    row = service.list().first()
    assert (row.seed_url, row.org_name, row.mode, row.progress, row.phase) == ("http://s.example/", "An Org", "CRAWL_AND_SCRAPE", 100, "COMPLETED") and row.duration
    own = service.status(job)
    assert own["summary"] == {"org_name": "An Org", "urls_discovered": 2, "pages_scraped": 2, "validation": {"total_crawled": 2, "total_scraped": 2, "success_rate": 100.0, "completeness_rate": 100.0}}
    assert (own["crawl_completed"], own["crawl_total"], own["scrape_completed"], own["scrape_total"]) == (2, 2, 2, 2)
    page = service.results(job, "scraped", "1", "1", "MARKDOWN")
    assert page["pagination"]["total"] == 2 and page["data"].count() == 1 and page["statistics"]["total_pages"] == 1
    assert service.results(job, "crawled")["data"].count() == 2
    assert service.validation(job)["completeness_rate"] == 100.0
    files = service.export(job, f"file://{tmp_path}", "HTML")
    assert set(files) == {"crawl_results", "scrape_results", "validation_report", "summary"} and "/an-org/" in files["summary"]
    assert not service.cancel(job) and service.delete(job) and service.status(job) is None


def test_a_service_after_another(spark, tmp_path):
    """Jobs of one service are listed, paged and exported by the next one over the same folder."""
    pages = spark.createDataFrame([(1, "http://s.example/", '<article>the text<a href="/a">l</a></article>')], "page_id long, url string, html string")
    first = Service(spark, pages, store=TableStore(spark, f"file://{tmp_path}/jobs"))
    job = first.submit(REQUEST)
    assert first.runner.wait(job, 120) == "COMPLETED"
    second = Service(spark, pages, store=TableStore(spark, f"file://{tmp_path}/jobs"))
    assert [tuple(r) for r in second.list().collect()] == [tuple(r) for r in first.list().collect()]
    assert second.status(job)["summary"] == first.status(job)["summary"]
    page = second.results(job, "scraped", "2", "1")
    assert page["pagination"] == {"page": 2, "limit": 1, "total": 2, "total_pages": 2, "has_next": False, "has_prev": True} and [r.url for r in page["data"].collect()] == ["http://s.example/a"]
    files = second.export(job, f"file://{tmp_path}/out", "SUMMARY")
    assert files["scrape_results"].endswith("scrape-results.txt") and second.validation(job)["failed"] == 1
    assert second.recover() == [] and second.delete(job) and first.runner.store.result(job, "scraped") is None
