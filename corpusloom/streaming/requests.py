"""Requests as a stream of JSON lines: what is right is run as a job, once, and what is wrong is written down."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.plans import requests as rq
from corpusloom.plans.api import Service
from corpusloom.sources.pages import requests

#: Of the ids of jobs that a stream starts.
SPACE = uuid.UUID("6f0c6a5e-2f0e-4b4e-9a52-7a0e6b0a3c11")


def request_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """(value) of the lines of the text files in a folder, new ones as they come."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    return reader.text(folder)


def checked_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines with their requests, as sources.pages.requests parses them, and why each would be refused as a job, or null."""
    parsed = rq.checked(requests(lines, column, keep=True))
    return parsed.withColumn("refused", F.coalesce(F.when(F.col("malformed").isNotNull(), rq.MALFORMED), "error_v2"))


def run_requests(service: Service, folder: str, target: str, files: int | None = None, seconds: float = 600) -> list[str]:
    """Submits the requests in a folder that were not submitted before, and gives the ids of the jobs of this run.

    The id of a job follows from the number of its batch, the line, and which of equal lines of the batch it is. Spark gives a
    batch that did not end the same number and the same lines again, and a service with a TableStore knows the jobs that it
    has started, so none is run twice; those that a driver before left without an end are gone on with first. One driver at a
    time uses a store. Refused lines, with the reason, are in the table target/refused, by batch. Lines
    are read one partition at a time; a batch ends when its jobs have.
    """
    started: list[str] = []
    service.recover()

    def run(batch: DataFrame, number: int) -> None:
        nth = F.row_number().over(Window.partitionBy("value").orderBy(F.lit(0)))
        own = checked_requests(batch.withColumn("nth", nth))
        own.where("refused IS NOT NULL").select("value", "refused").write.mode("overwrite").parquet(f"{target}/refused/batch={number}")
        wanted = own.where("refused IS NULL").select("value", "nth", *rq.FIELDS)
        jobs = []
        for row in wanted.toLocalIterator():
            job = str(uuid.uuid5(SPACE, f"{target}/{number}/{row.nth}/{row.value}"))
            if service.runner.status(job) is None:
                service.submit({k: row[k] for k in rq.FIELDS}, job)
                started.append(job)
            jobs.append(job)
        for job in jobs:
            if job in service.runner.threads:
                service.runner.wait(job, seconds)

    stream = request_stream(service.spark, folder, files)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{target}/state").foreachBatch(run).start()
    query.awaitTermination()
    return started
