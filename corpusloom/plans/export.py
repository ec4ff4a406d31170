"""Sinks: tables, single reports, and the folder of a finished job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import EXPORT_EXTENSIONS, EXTENSIONS, REPORT_ROWS
from corpusloom.functions import urls
from corpusloom.operators import formatters, validate
from corpusloom.sinks import report as sinks

RULE = "═" * 60


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> str:
    """One file of text through Hadoop's file systems, so any store will do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()
    return path


def write_table(df: DataFrame, path: str, kind: str = "json", **partition_by: str) -> str:
    """Records as JSON lines, CSV or Parquet, one directory per value of the given columns."""
    out = df.withColumns({k: F.lit(v) for k, v in partition_by.items()}) if partition_by else df
    writer = out.write.mode("overwrite").partitionBy(*partition_by) if partition_by else out.write.mode("overwrite")
    getattr(writer.option("header", "true") if kind == "csv" else writer, kind)(path)
    return path


def write_report(df: DataFrame, folder: str, kind: str, order: str, generated_at: str, stem: str = "scrape-output", extensions: dict[str, str] = EXTENSIONS) -> str:
    """A whole report as raw text in one file named after its format. Tasks write its pages, and the driver only joins files."""
    return sinks.write_report(formatters.ordered(df, kind, order), f"{folder}/{stem}.{extensions.get(kind, 'json')}", formatters.frame(df, kind, generated_at))


def organisation_slug(spark: SparkSession, name: str | None, seed_url: str) -> str:
    own = F.lit(name) if name else urls.organisation(F.lit(seed_url))
    return spark.range(1).select(urls.directory_name(own)).first()[0]


def export_job(job: dict, crawled: DataFrame | None, scraped: DataFrame | None, report, base: str, run: str, kind: str = "JSON", generated_at: str = "") -> dict[str, str]:
    """Writes what a completed job has below base/<organisation>/<run>/ and gives the paths. Other states are refused."""
    if job["status"] != "COMPLETED":
        raise ValueError(f"Job is {job['status']}. Export only available for completed jobs.")
    spark = SparkSession.active()
    folder, files = f"{base}/{organisation_slug(spark, job.get('org_name'), job['seed_url'])}/{run}", {}
    if crawled is not None:
        files["crawl_results"] = write_table(crawled, f"{folder}/crawl-results")
    if scraped is not None:
        files["scrape_results"] = write_report(scraped, folder, kind, "url", generated_at, "scrape-results", EXPORT_EXTENSIONS)
    if report is not None:
        import json

        files["validation_report"] = write_text(spark, f"{folder}/validation-report.json", [json.dumps(report.asDict(), indent=2)])
    files["summary"] = write_text(spark, f"{folder}/summary.txt", [export_text(job, crawled, scraped, report, generated_at)])
    return files


# Headings and labels below are fixed values: readers of the summary rely on them.
def export_text(job: dict, crawled: DataFrame | None, scraped: DataFrame | None, report, generated_at: str) -> str:
    line = lambda k, v: f"  {k + ':':<18}{v}"
    name = job.get("org_name") or job["seed_url"]
    out = [RULE, f"CRAWL SUMMARY: {name.upper()}", RULE, "", "JOB INFORMATION:", line("Job ID", job["id"]), line("Seed URL", job["seed_url"]), line("Operation Mode", job["mode"]), line("Max Depth", job["depth"]), line("Include Subpages", str(job["subpages"]).lower())]
    out += ["", "TIMING:", line("Started At", job.get("started_at") or "N/A"), line("Completed At", job.get("completed_at") or "N/A"), line("Total Duration", job.get("duration") or "N/A"), "", "RESULTS:"]
    if crawled is not None:
        out.append(line("URLs Discovered", crawled.count()))
    if scraped is not None:
        r = scraped.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.count_if(F.col("status") == "FAILED").alias("bad")).first()
        out += [line("Pages Scraped", r.n), line("  - Successful", r.ok), line("  - Failed", r.bad)]
    if report is not None:
        out += ["", "VALIDATION:", line("Total Crawled", report.total_crawled), line("Total Scraped", report.total_scraped), line("Success Rate", f"{report.success_rate:.1f}%"), line("Completeness", f"{report.completeness_rate:.1f}%")]
        if scraped is not None and report.failed:
            first, more = validate.first_rows(validate.failures(scraped), "url")
            out += ["", f"FAILED URLS (first {REPORT_ROWS}):", *(x for r in first.collect() for x in (f"  - {r.url}", f"    Error: {r.error}"))]
            out += [f"  ... and {more} more"] if more else []
    return "\n".join([*out, "", RULE, f"Generated: {generated_at}", RULE])
