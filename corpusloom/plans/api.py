"""The service's calls as methods: synchronous processing, jobs, results by page, export, progress."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import REQUEST_CAP, TTL_MS
from corpusloom.operators import formatters, paging, stats
from corpusloom.plans import export, jobs
from corpusloom.plans.engine import Engine
from corpusloom.plans.store import MemoryStore


class Service:
    """With a `store` in a folder, jobs outlive the driver: a new service over the same folder lists, pages and exports them."""

    def __init__(self, spark: SparkSession, pages: DataFrame | None, native: bool = False, cap: int | None = REQUEST_CAP, ttl_ms: int = TTL_MS, live: Callable[[DataFrame], DataFrame] | None = None, store: MemoryStore | None = None):
        self.spark, self.engine = spark, Engine(spark, pages, native, cap, live)
        self.runner = jobs.JobRunner(spark, self.engine.job, ttl_ms, store)
        self.indexes: dict[tuple[str, str], paging.PageIndex] = {}

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def process(self, request: dict) -> dict[str, DataFrame]:
        return self.engine.process(request)

    def submit(self, request: dict, job: str | None = None) -> str:
        """Refuses a wrong request at once; a job id for a right one. A job of an id that is known is not run again."""
        self.engine._checked(request, "error_v2")
        return self.runner.submit(request, job)

    def recover(self, again: bool = True) -> list[str]:
        """Goes on with the jobs that a driver before left without an end."""
        return self.runner.recover(again)

    def jobs(self, job: str | None = None) -> DataFrame:
        return jobs.fold(self.runner.log(job))

    def list(self, status: str | None = None) -> DataFrame:
        return jobs.list_rows(jobs.listed(self.jobs(), status), F.lit(datetime.now())).orderBy(F.desc("created_at"), "job_id")

    def stats(self) -> DataFrame:
        return stats.job_counts(self.jobs())

    def status(self, job: str) -> dict | None:
        """Status, progress, duration and error of a job; None if there is none of that id. A completed one also has a
        summary of its results and the calls that give them."""
        if self.runner.status(job) is None:
            return None
        config = self.runner.config(job)
        own = jobs.phase_progress(self.jobs(job), F.lit(config.get("operationMode") or "CRAWL_AND_SCRAPE"))
        out = jobs.durations(own, F.lit(datetime.now())).first().asDict()
        out["config"] = config
        out["duration"] = out["duration"] if out["started_at"] else "Not started"
        if out["status"] == "COMPLETED":
            found = {name: self.runner.result(job, name) for name in self.runner.store.results(job)}
            rows = lambda name: found[name].count() if name in found else 0
            report = found["report"].first() if "report" in found else None
            out["summary"] = {
                "org_name": config.get("orgName"), "urls_discovered": rows("crawled"), "pages_scraped": rows("scraped"),
                "validation": None if report is None else {k: report[k] for k in ("total_crawled", "total_scraped", "success_rate", "completeness_rate")},
            }
            out["links"] = {"crawl_results": ("results", job, "crawled"), "scrape_results": ("results", job, "scraped"), "export_results": ("export", job)}
        return out

    def progress(self, job: str) -> dict | None:
        if self.runner.status(job) is None:
            return None
        return jobs.item_progress(self.jobs(job)).first().asDict()

    def results(self, job: str, kind: str = "scraped", page: object = None, limit: object = None, output: str | None = None) -> dict:
        """One page of a job's crawl or scrape results, in a format if one is asked for; statistics describe the page."""
        found = self.runner.result(job, kind)
        if found is None:
            raise ValueError(f"no {kind} results")
        p, n = paging.parse(page, limit)
        if self.runner.status(job) == "COMPLETED" and kind in ("crawled", "scraped"):
            # What does not change any more is put in order once.
            index = self.indexes.get((job, kind)) or self.indexes.setdefault((job, kind), paging.PageIndex(found, ["url"]))
            rows, info = index.page(p, n), index.info(p, n)
        else:
            rows, info = paging.page_of(found, ["url"], p, n), paging.page_info(found, p, n).first().asDict()
        out = {"pagination": info, "data": rows}
        if output and kind == "scraped":
            out["data"] = formatters.formatted_rows(rows, output)
            out["statistics"] = stats.statistics(rows, F.col("scrape_ms")).first().asDict()
        return out

    def validation(self, job: str) -> dict:
        report = self.runner.result(job, "report")
        if report is None:
            raise ValueError("no validation of this job")
        return report.first().asDict()

    def export(self, job: str, base: str, output: str = "JSON") -> dict[str, str]:
        config, state = self.runner.config(job), self.status(job)
        if state is None:
            raise ValueError("no such job")
        found = {name: self.runner.store.result(job, name) for name in self.runner.store.results(job)}
        report = found.get("report")
        record = {
            "id": job, "status": state["status"], "seed_url": config["seedUrl"], "org_name": config.get("orgName"), "mode": config.get("operationMode") or "CRAWL_AND_SCRAPE", "depth": 2 if config.get("depth") is None else config["depth"],
            "subpages": config.get("includeSubpages") is not False, "started_at": str(state["started_at"]), "completed_at": str(state["completed_at"]), "duration": state["duration"],
        }
        now = datetime.now().isoformat()
        return export.export_job(record, found.get("crawled"), found.get("scraped"), report.first() if report is not None else None, base, now[:19].replace(":", "-"), output, now)

    def cancel(self, job: str) -> bool:
        return self.runner.cancel(job)

    def delete(self, job: str) -> bool:
        """Cancels a job that runs, forgets one that has ended."""
        if self.runner.status(job) in ("QUEUED", "RUNNING"):
            return self.runner.cancel(job)
        for kind in ("crawled", "scraped"):
            self.indexes.pop((job, kind), None)
        return self.runner.delete(job)
