import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import extract
from corpusloom.plans import jobs, progress
from corpusloom.plans.store import TableStore
from corpusloom.schemas import JOB_EVENT
from corpusloom.streaming import jobs as stream_jobs

T0 = datetime(2024, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame([(j, i, T0 + timedelta(seconds=s), kind, value, done, total) for i, (j, s, kind, value, done, total) in enumerate(rows)], JOB_EVENT)


def test_fold(spark):
    events = log(
        spark,
        ("a", 0, "status", "QUEUED", None, None), ("a", 1, "status", "RUNNING", None, None), ("a", 2, "phase", "CRAWLING", None, None), ("a", 3, "crawl", None, 5, 10),
        ("a", 4, "status", "CANCELLED", None, None), ("a", 5, "status", "COMPLETED", None, None), ("b", 0, "crawl", None, 7, 5), ("c", 0, "status", "RUNNING", None, None), ("c", 10, "error", "boom", None, None), ("c", 10, "status", "FAILED", None, None),
    )
    rows = {r.job_id: r for r in jobs.fold(events).collect()}
    a = rows["a"]
    assert (a.status, a.phase, a.crawl_completed, a.completed_at) == ("CANCELLED", "CRAWLING", 5, T0 + timedelta(seconds=4))
    assert (rows["b"].status, rows["b"].phase, rows["b"].started_at) == ("QUEUED", "IDLE", None)
    assert (rows["c"].status, rows["c"].phase, rows["c"].error) == ("FAILED", "ERROR", "boom")
    p = {r.job_id: r for r in jobs.phase_progress(jobs.fold(events), F.lit("CRAWL_AND_SCRAPE")).collect()}
    assert (p["a"].crawl_percent, p["a"].overall, p["a"].eta_seconds) == (50, 20, 12)
    assert p["b"].crawl_percent == 100 and p["b"].eta_seconds is None
    d = {r.job_id: r for r in jobs.durations(jobs.fold(events), F.lit(T0 + timedelta(hours=1))).collect()}
    assert (d["a"].duration, d["b"].duration_ms, d["c"].duration) == ("3s", 0, "10s")
    live = lambda s: {r.job_id for r in jobs.unexpired(jobs.fold(events), F.lit(T0 + timedelta(seconds=s))).collect()}
    assert live(3604) == {"a", "b", "c"} and live(3605) == {"b", "c"}
    assert [r.job_id for r in jobs.listed(jobs.fold(events), "QUEUED").collect()] == ["b"]


def test_runner(spark):
    runner = jobs.JobRunner(spark, lambda s, c, tell, keep: keep("crawled", s.range(c["n"])) if c["n"] else 1 / 0)
    good, bad = runner.submit({"n": 3}), runner.submit({"n": 0})
    assert runner.wait(good, 60) == "COMPLETED" and runner.wait(bad, 60) == "FAILED"
    assert runner.result(good, "crawled").count() == 3 and not runner.cancel(good)
    rows = {r.job_id: r for r in jobs.fold(runner.log()).collect()}
    assert rows[bad].status == "FAILED" and "division" in rows[bad].error
    assert runner.delete(good) and runner.status(good) is None


def test_progress_of_a_running_job(spark):
    """What is polled while a job runs: phases, counts, per cent and time left; then its end."""
    go, told = threading.Event(), threading.Event()

    def work(s, c, tell, keep):
        tell("phase", "CRAWLING")
        tell("crawl", completed=5, total=10)
        told.set()
        go.wait(30)
        tell("scrape", completed=10, total=10)

    runner = jobs.JobRunner(spark, work)
    job = runner.submit({"seedUrl": "http://a.b/", "orgName": "An Org", "operationMode": None})
    assert told.wait(30)
    now = jobs.fold(runner.log())
    row = jobs.list_rows(now, F.current_timestamp()).first()
    assert (row.seed_url, row.org_name, row.mode, row.status, row.phase, row.progress) == ("http://a.b/", "An Org", "CRAWL_AND_SCRAPE", "RUNNING", "CRAWLING", 20)
    assert jobs.item_progress(now).first().overall == 50
    go.set()
    assert runner.wait(job, 30) == "COMPLETED"
    row = jobs.list_rows(jobs.fold(runner.log()), F.current_timestamp()).first()
    assert (row.status, row.phase, row.progress) == ("COMPLETED", "COMPLETED", 80) and row.completed_at and row.duration


def test_ended_jobs_are_forgotten(spark):
    runner = jobs.JobRunner(spark, lambda s, c, tell, keep: keep("x", s.range(1)), ttl_ms=300)
    job = runner.submit({})
    assert runner.wait(job, 30) == "COMPLETED" and runner.store.results(job) == ["x"]
    time.sleep(0.5)
    other = runner.submit({})
    assert runner.status(job) is None and runner.store.results(job) == [] and job not in runner.threads and runner.status(other)


def spark_jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_cancelled_before_its_first_spark_job(spark):
    """A job that is cancelled while it does something else starts no Spark job afterwards and keeps nothing."""
    began, go, done = threading.Event(), threading.Event(), []

    def work(s, c, tell, keep):
        began.set()
        go.wait(30)
        for _ in range(3):
            done.append(s.range(10).count())
        keep("crawled", s.range(3))

    runner = jobs.JobRunner(spark, work)
    job = runner.submit({})
    assert began.wait(30) and runner.cancel(job)
    go.set()
    assert runner.wait(job, 30) == "CANCELLED" and not runner.threads[job].is_alive()
    assert done == [] and runner.store.results(job) == [] and not runner.cancel(job)
    row = jobs.fold(runner.log(job)).first()
    assert row.status == "CANCELLED" and row.error is None
    with pytest.raises(ValueError, match="CANCELLED"):
        runner.result(job, "crawled")
    other = runner.submit({})
    assert runner.wait(other, 30) == "COMPLETED" and runner.result(other, "crawled").count() == 3


def test_cancelled_before_its_thread_runs(spark, monkeypatch):
    runner = jobs.JobRunner(spark, lambda s, c, tell, keep: keep("crawled", s.range(3)))
    start = threading.Thread.start
    held = []
    monkeypatch.setattr(threading.Thread, "start", lambda t: held.append(t) if getattr(t, "_target", None) == runner._run else start(t))
    job = runner.submit({})
    assert runner.status(job) == "QUEUED" and runner.cancel(job)
    monkeypatch.undo()
    held[0].start()
    held[0].join(30)
    assert runner.status(job) == "CANCELLED" and spark_jobs(spark, job) == 0 and runner.store.results(job) == []
    assert [e[4] for e in runner.store.events_of(job) if e[3] == "status"] == ["QUEUED", "CANCELLED"]


def test_cancelled_in_a_spark_job(spark):
    """A Spark job that runs is stopped."""

    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    runner = jobs.JobRunner(spark, lambda s, c, tell, keep: keep("x", s.range(4).mapInArrow(slow, "id long")))
    job = runner.submit({})
    until = time.time() + 15
    while not spark_jobs(spark, job) and time.time() < until:
        time.sleep(0.1)
    at = time.time()
    assert runner.cancel(job) and runner.wait(job, 30) == "CANCELLED" and time.time() - at < 15 and runner.store.results(job) == []


def test_progress_task_by_task(spark):
    """T1: a scrape that runs shows numbers between 0 and all."""

    def work(s, c, tell, keep):
        pages = s.range(8).selectExpr("'http://s.example/' || id AS url", "'<article>the text</article>' AS html").repartition(8)
        with progress.counted(s, lambda n: tell("scrape", completed=n, total=8)) as passed:

            def slowly(n):
                time.sleep(0.4)
                passed(n)

            keep("scraped", extract.scrape(pages, timed=True, passed=slowly))
        tell("scrape", completed=8, total=8)

    runner = jobs.JobRunner(spark, work)
    job = runner.submit({})
    assert runner.wait(job, 60) == "COMPLETED"
    seen = [e[5] for e in runner.store.events_of(job) if e[3] == "scrape"]
    assert seen == sorted(seen) and seen[-1] == 8 and any(0 < n < 8 for n in seen)
    assert runner.result(job, "scraped").count() == 8


def test_jobs_outlive_their_driver(spark, tmp_path):
    """Events and results of one runner, read and gone on with by another over the same folder."""
    base = f"file://{tmp_path}/jobs"
    first = jobs.JobRunner(spark, lambda s, c, tell, keep: keep("rows", s.range(c["n"])), store=TableStore(spark, base))
    done = first.submit({"n": 4, "seedUrl": "http://a.b/"})
    assert first.wait(done, 60) == "COMPLETED"
    # What a driver leaves that goes away in the middle.
    left = TableStore(spark, base)
    for kind, value in (("status", "QUEUED"), ("config", '{"n": 2}'), ("status", "RUNNING"), ("phase", "CRAWLING")):
        left.tell("left", kind, value)
    left.keep("left", "rows", spark.range(1))
    second = jobs.JobRunner(spark, first.work, store=TableStore(spark, base))
    assert second.status(done) == "COMPLETED" and second.result(done, "rows").count() == 4 and second.config(done)["seedUrl"] == "http://a.b/"
    assert {r.job_id: r.status for r in jobs.fold(second.log()).collect()} == {done: "COMPLETED", "left": "RUNNING"}
    assert second.submit({"n": 9}, done) == done and done not in second.threads  # known, so not run again
    assert second.recover() == ["left"] and second.wait("left", 60) == "COMPLETED" and second.result("left", "rows").count() == 2
    assert [e[1] for e in TableStore(spark, base).events_of("left")] == list(range(1, len(second.store.events_of("left")) + 1))
    own = second.store.table("rows").where("job_id = 'left'")
    assert own.count() == 2 and len(own.inputFiles()) >= 1
    scan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "left" in scan
    left.tell("dead", "status", "RUNNING")
    assert jobs.JobRunner(spark, first.work, store=TableStore(spark, base)).recover(again=False) == ["dead"]
    assert TableStore(spark, base).events_of("dead")[-1][4] == "FAILED"
    assert second.delete(done) and second.status(done) is None and TableStore(spark, base).jobs() == ["dead", "left"] and second.store.result(done, "rows") is None


#: Two jobs whose events tie, come late or after the end.
EVENTS = [("a", 0, "status", "QUEUED", None, None), ("a", 1, "status", "RUNNING", None, None), ("b", 1, "status", "FAILED", None, None), ("b", 1, "status", "COMPLETED", None, None), ("b", 2, "status", "RUNNING", None, None), ("a", 3, "crawl", None, 1, 2), ("c", 4, "status", "RUNNING", None, None), ("a", 5, "status", "COMPLETED", None, None), ("a", 5, "status", "CANCELLED", None, None), ("d", 6, "phase", "CRAWLING", None, None)]


@pytest.mark.parametrize("seed", range(3))
def test_state_fold_is_the_batch_fold(spark, tmp_path, seed):
    """Any split into batches and any order gives the rows of the batch fold; of equal times the sequence decides."""
    import random

    events = log(spark, *EVENTS)
    rows = events.collect()
    random.Random(seed).shuffle(rows)
    cut = 3 + 2 * seed
    for i in range(0, len(rows), cut):
        spark.createDataFrame(rows[i : i + cut], events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = stream_jobs.event_stream(spark, str(tmp_path), "events", files=1).withWatermark("ts", "1 hour")
    out = stream_jobs.run_available(stream_jobs.fold_with_state(stream), f"file://{tmp_path}/out", "update", stateful=True, keep_batch=True)
    assert out.select("batch").distinct().count() > 1
    got = stream_jobs.last_of_each(out)
    want = jobs.fold(events).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_state_is_kept_and_forgotten(spark, tmp_path):
    """What the watermark has passed is folded for good and can be looked up by job; an ended job goes after its time."""
    early = log(spark, *EVENTS)
    late = log(spark, ("e", 600, "status", "RUNNING", None, None), ("c", 601, "status", "COMPLETED", None, None))
    later, last = (log(spark, ("e", at, "phase", "CRAWLING", None, None)) for at in (1300, 1400))
    target = f"file://{tmp_path}/out"
    known = {}
    for part in (early, late, later, last):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        stream = stream_jobs.event_stream(spark, str(tmp_path), "events", files=1).withWatermark("ts", "1 minute")
        stream_jobs.run_available(stream_jobs.fold_with_state(stream, ttl_ms=400_000), target, "update", stateful=True)
        known = {r.job_id: r.status for r in stream_jobs.known_jobs(spark, f"{target}/state").collect()}
        if part is early:
            assert known == {}
        if part is late:
            assert "a" not in known or known["a"] == "COMPLETED"
    # The watermark is at 1240 s or more: a and b ended long before, c at 601 s.
    assert "a" not in known and "b" not in known and "c" not in known and known["e"] == "RUNNING"


def test_requests_are_run_once(spark, tmp_path):
    """A stream of request lines: right ones are jobs, wrong ones are written down, and a stream that starts again, or runs a
    batch again, starts no job twice."""
    from corpusloom.plans.api import Service
    from corpusloom.streaming.requests import run_requests

    pages = spark.createDataFrame([(1, "http://s.example/", "<article>the text</article>")], "page_id long, url string, html string")
    folder, target, base = tmp_path / "in", f"file://{tmp_path}/run", f"file://{tmp_path}/jobs"
    folder.mkdir()
    good = '{"seedUrl": "http://s.example/", "operationMode": "SCRAPE_ONLY"}'
    (folder / "a.jsonl").write_text("\n".join([good, good, '{"seedUrl": ""}', "no json", '{"seedUrl": 3, "depth": "x"}', "[1]"]) + "\n")
    service = Service(spark, pages, store=TableStore(spark, base))
    ids = run_requests(service, f"file://{folder}", target)
    assert len(ids) == 2 and all(service.runner.status(i) == "COMPLETED" for i in ids)
    refused = {r.value: r.refused for r in spark.read.parquet(f"{target}/refused").collect()}
    assert refused['{"seedUrl": ""}'] == "seedUrl is required" and len(refused) == 4 and len(set(refused.values())) == 2
    assert run_requests(service, f"file://{folder}", target) == []
    # The stream's record of its first batch is lost: the batch comes again, with the same jobs.
    import shutil

    shutil.rmtree(tmp_path / "run" / "state" / "commits")
    other = Service(spark, pages, store=TableStore(spark, base))
    assert run_requests(other, f"file://{folder}", target) == []
    (folder / "b.jsonl").write_text('{"seedUrl": "http://s.example/"}\n')
    new = run_requests(other, f"file://{folder}", target)
    assert len(new) == 1 and other.status(new[0])["status"] == "COMPLETED" and other.list().count() == 3


def test_streamed_fold_is_the_batch_fold(spark, tmp_path):
    """Events over two files, a start and a second end after the end, and equal times."""
    a = log(spark, ("a", 0, "status", "QUEUED", None, None), ("a", 2, "status", "FAILED", None, None), ("b", 1, "crawl", None, 1, 2), ("c", 1, "status", "RUNNING", None, None), ("c", 1, "status", "COMPLETED", None, None))
    b = log(spark, ("a", 3, "status", "RUNNING", None, None), ("a", 4, "status", "COMPLETED", None, None), ("d", 0, "status", "RUNNING", None, None)).withColumn("seq", F.col("seq") + 10)
    a.write.parquet(f"{tmp_path}/events.parquet")
    b.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = stream_jobs.run_available(stream_jobs.fold_all(stream_jobs.event_stream(spark, str(tmp_path), "events")), f"file://{tmp_path}/out")
    want = jobs.fold(a.union(b)).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.job_id: r.status for r in got.collect()} == {"a": "FAILED", "b": "QUEUED", "c": "COMPLETED", "d": "RUNNING"}


def test_state_is_asked_little():
    """A job's batch takes one read and one write of its state, and a timer only where one is set or moved."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import TimerValues

    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("job")

        def update(self, value):
            calls.append("update")
            held["job"] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a))

    fold = stream_jobs.JobFold(1000)
    fold.init(Handle())
    event = lambda seq, value: Row(us=seq * 1_000_000, seq=seq, kind="status", value=value)
    asked = []
    for mark, rows in ((0, [event(2, "RUNNING"), event(1, "QUEUED")]), (1500, [event(4, "COMPLETED")]), (5000, [event(6, "FAILED")]), (7000, [event(8, "FAILED")])):
        (out,) = fold.handleInputRows(("a",), iter(rows), TimerValues(0, mark))
        asked.append(list(calls))
        calls.clear()
    assert asked == [["get", "update"], ["get", ("registerTimer", 5000), "update"], ["get", ("deleteTimer", 5000), ("registerTimer", 5001), "update"], ["get", ("deleteTimer", 5001), ("registerTimer", 7001), "update"]]
    assert tuple(out) == ("a", "COMPLETED", 1_000_000, 2_000_000, 4_000_000)
