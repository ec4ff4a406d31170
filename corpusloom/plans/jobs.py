"""Jobs and their progress as folds over an event log, and a runner that executes requests on the session.

Events are (job_id, seq, ts, kind, value, completed, total). A job is what its events say, so any number of jobs is
folded by one aggregate. Terminal states are final: of several terminal events the first counts, and progress after
it is passed over.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import TTL_MS
from corpusloom.functions import text as tx
from corpusloom.plans.store import TERMINAL, MemoryStore
from corpusloom.schemas import REQUEST

#: Seconds between two looks for jobs to forget, unless their time to live is shorter.
EVICT_EVERY = 300


def fold(events: DataFrame) -> DataFrame:
    """One row per job: status, phase, progress, times, and the error if any."""
    order = F.struct("ts", "seq")
    kind, value = F.col("kind"), F.col("value")
    status = kind == "status"
    end = events.where(status & value.isin(*TERMINAL)).groupBy("job_id").agg(F.min(F.struct("ts", "seq", "value")).alias("end"))
    own = events.join(end, "job_id", "left").where(F.col("end").isNull() | (order <= F.struct("end.ts", "end.seq")))
    last = lambda c, on: F.max_by(F.when(on, c), F.when(on, order))
    return own.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(status & (value == "RUNNING"), F.col("ts"))).alias("started_at"),
        F.first("end.ts").alias("completed_at"),
        F.coalesce(last(value, status), F.lit("QUEUED")).alias("status"),
        F.when(F.first("end.value") == "FAILED", "ERROR").otherwise(F.coalesce(last(value, kind == "phase"), F.lit("IDLE"))).alias("phase"),
        F.coalesce(last(F.col("completed"), kind == "crawl"), F.lit(0)).alias("crawl_completed"),
        F.coalesce(last(F.col("total"), kind == "crawl"), F.lit(0)).alias("crawl_total"),
        F.coalesce(last(F.col("completed"), kind == "scrape"), F.lit(0)).alias("scrape_completed"),
        F.coalesce(last(F.col("total"), kind == "scrape"), F.lit(0)).alias("scrape_total"),
        F.max("ts").alias("updated_at"),
        last(value, kind == "error").alias("error"),
        last(value, kind == "config").alias("config"),
    )


def percent(completed: Column, total: Column) -> Column:
    return tx.rounded(100 * completed, F.greatest(total, completed))


def item_progress(jobs: DataFrame) -> DataFrame:
    """Overall per cent by items, and the seconds left at the mean time per item so far."""
    total = F.greatest("crawl_total", "crawl_completed") + F.col("scrape_total")
    done = F.col("crawl_completed") + F.col("scrape_completed")
    ms = F.unix_millis("updated_at") - F.unix_millis("started_at")
    left = (total - done) * ms
    return jobs.withColumns({"overall": tx.rounded(100 * done, total), "eta_seconds": F.when(done > 0, F.ceil(left / (done * 1000)).cast("long"))})


def phase_progress(jobs: DataFrame, mode: Column) -> DataFrame:
    """Overall per cent by phases, four parts crawl and six scrape, and the seconds left by extrapolation."""
    crawl, scrape = percent(F.col("crawl_completed"), F.col("crawl_total")), percent(F.col("scrape_completed"), F.col("scrape_total"))
    overall = F.when(mode == "CRAWL_ONLY", crawl).when(mode == "SCRAPE_ONLY", scrape).otherwise(tx.rounded(4 * crawl + 6 * scrape, F.lit(10)))
    ms = F.unix_millis("updated_at") - F.unix_millis("started_at")
    out = jobs.withColumns({"crawl_percent": crawl, "scrape_percent": scrape, "overall": overall})
    some = (F.col("overall") > 0) & (F.col("overall") < 100) & F.col("started_at").isNotNull()
    return out.withColumn("eta_seconds", F.when(some, tx.rounded(ms * (100 - F.col("overall")), F.col("overall") * 1000)))


def durations(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Milliseconds from start to end, or to as_of while running; 0 before the start."""
    ms = F.coalesce(F.unix_millis(F.coalesce("completed_at", as_of)) - F.unix_millis("started_at"), F.lit(0)).cast("long")
    return jobs.withColumn("duration_ms", ms).withColumn("duration", tx.duration(F.col("duration_ms")))


def list_rows(jobs: DataFrame, as_of: Column) -> DataFrame:
    """What a list of jobs shows: request, state, overall per cent, phase and times; no duration before the start."""
    asked = F.from_json("config", REQUEST)
    own = jobs.withColumn("asked", asked).withColumn("mode", tx.or_default(F.col("asked.operationMode"), "CRAWL_AND_SCRAPE"))
    own = durations(phase_progress(own, F.col("mode")), as_of)
    return own.select(
        "job_id", F.col("asked.seedUrl").alias("seed_url"), F.nullif("asked.orgName", F.lit("")).alias("org_name"), "mode", "status", F.col("overall").alias("progress"), "phase",
        "created_at", "completed_at", F.when(F.col("started_at").isNotNull(), F.col("duration")).alias("duration"),
    )


def unexpired(jobs: DataFrame, as_of: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Without jobs that ended longer ago than the time to live."""
    return jobs.where(F.col("completed_at").isNull() | (F.unix_millis(as_of) - F.unix_millis("completed_at") <= ttl_ms))


def listed(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Newest first, with or without a filter."""
    jobs = jobs.where(F.col("status") == status) if status else jobs
    return jobs.orderBy(F.desc("created_at"), "job_id")


class Cancelled(Exception):
    """Ends the work of a job that was cancelled."""


def _end_of(events: list[tuple]) -> str | None:
    return next((e[4] for e in events if e[3] == "status" and e[4] in TERMINAL), None)


class JobRunner:
    """Runs functions (spark, config, tell, keep) -> None in threads with a job group of their own.

    tell(kind, value, completed, total) adds an event of the job, keep(name, rows) a result, and gives the rows as they are
    kept. Both are in `store`: with a MemoryStore they end with the driver, with a TableStore another runner over the same
    folder goes on with them.

    A job that is cancelled before it starts does nothing; cancelling one that runs stops its Spark jobs, those that it would
    start afterwards, and the work itself at the next tell or keep. Its results go.
    """

    def __init__(self, spark: SparkSession, work: Callable[[SparkSession, dict, Callable, Callable], None], ttl_ms: int = TTL_MS, store: MemoryStore | None = None):
        self.spark, self.work, self.ttl_ms = spark, work, ttl_ms
        self.store = store or MemoryStore(spark)
        self.threads: dict[str, threading.Thread] = {}
        self.stopped: dict[str, threading.Event] = {}
        self.evicted_at = datetime.min
        #: A job either ends or is cancelled.
        self.ending = threading.RLock()

    def submit(self, config: dict, job: str | None = None) -> str:
        """Starts a job, unless one of that id is known."""
        self.evict()
        job = job or str(uuid.uuid4())
        if self.status(job) is None:
            self.store.tell(job, "status", "QUEUED")
            self.store.tell(job, "config", json.dumps(config))
            self._start(job, config)
        return job

    def _start(self, job: str, config: dict) -> None:
        self.stopped[job] = threading.Event()
        self.threads[job] = threading.Thread(target=self._run, args=(job, config), daemon=True)
        self.threads[job].start()

    def _run(self, job: str, config: dict) -> None:
        stopped, context = self.stopped[job], self.spark.sparkContext

        def checked(act: Callable) -> Callable:
            def run(*args, **options):
                if stopped.is_set():
                    raise Cancelled
                return act(job, *args, **options)

            return run

        tell, keep = checked(self.store.tell), checked(self.store.keep)
        context.setJobGroup(job, f"job {job}", interruptOnCancel=True)
        try:
            tell("status", "RUNNING")
            self.work(self.spark, config, tell, keep)
            end = [("phase", "COMPLETED"), ("status", "COMPLETED")]
        except Exception as e:  # whatever ends a job is its outcome
            end = [("error", str(e) or type(e).__name__), ("status", "FAILED")]
        with self.ending:
            if not stopped.is_set():
                for event in end:
                    self.store.tell(job, *event)
                return
        self.store.drop_results(job)

    def cancel(self, job: str) -> bool:
        with self.ending:
            if self.status(job) not in ("QUEUED", "RUNNING"):
                return False
            if job in self.stopped:
                self.stopped[job].set()
            self.store.tell(job, "status", "CANCELLED")
        # Present jobs of the group and those that the thread starts before it sees the event. Spark lets the shuffle stages of
        # a query that begins later run, so they are cancelled for as long as the thread goes on.
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(job)
        threading.Thread(target=self._keep_down, args=(job,), daemon=True).start()
        return True

    def _keep_down(self, job: str) -> None:
        thread = self.threads.get(job)
        while thread is not None and thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(job)
            thread.join(0.1)

    def recover(self, again: bool = True) -> list[str]:
        """The jobs of a runner that is gone without an end of them: they run again from the start, or are FAILED."""
        left = [job for job in self.store.unended() if job not in self.threads]
        for job in left:
            self.store.drop_results(job)
            if again:
                self._start(job, self.config(job))
            else:
                self.store.tell(job, "error", "the driver that ran the job is gone")
                self.store.tell(job, "status", "FAILED")
        return left

    def delete(self, job: str) -> bool:
        """Cancels a running job, then forgets it."""
        if self.status(job) is None:
            return False
        if self.cancel(job) and job in self.threads:
            self.threads[job].join(60)
        self.store.drop(job)
        self.threads.pop(job, None)
        self.stopped.pop(job, None)
        return True

    def evict(self) -> list[str]:
        """Forgets jobs that ended longer ago than the time to live; looks for them every five minutes at most."""
        now, ttl = datetime.now(), timedelta(milliseconds=self.ttl_ms)
        if now - self.evicted_at < min(ttl, timedelta(seconds=EVICT_EVERY)):
            return []
        self.evicted_at = now
        gone = self.store.ended_before(now - ttl)
        for job in gone:
            self.delete(job)
        return gone

    def config(self, job: str) -> dict:
        return next((json.loads(e[4]) for e in self.store.events_of(job) if e[3] == "config"), {})

    def status(self, job: str) -> str | None:
        events = self.store.events_of(job)
        states = [e[4] for e in events if e[3] == "status"]
        return _end_of(events) or (states[-1] if states else None)

    def wait(self, job: str, seconds: float) -> str | None:
        self.threads[job].join(seconds)
        return self.status(job)

    def log(self, job: str | None = None) -> DataFrame:
        """The events of one job, or of all that are not forgotten."""
        self.evict()
        return self.store.log(job)

    def result(self, job: str, name: str) -> DataFrame | None:
        """Available while a job runs or once it is completed."""
        if self.status(job) not in ("RUNNING", "COMPLETED"):
            raise ValueError(f"job is {self.status(job)}")
        return self.store.result(job, name)
