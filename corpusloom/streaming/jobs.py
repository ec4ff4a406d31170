"""The job fold over a stream of events: complete aggregates by micro-batch, or state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.constants import TTL_MS
from corpusloom.plans.jobs import TERMINAL


def event_stream(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A stream over one table in a folder, a file or a directory of files; `files` is how many make a batch at most."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()[:1]):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def run_available(stream: DataFrame, target: str, mode: str = "complete", stateful: bool = False, keep_batch: bool = False) -> DataFrame:
    """Runs a stream over what is there and gives the target table: the last batch in complete mode, else all of them, with
    the number of each with keep_batch. A batch that is run again replaces what it wrote, and a stream that is started again
    on the same target goes on after the last batch."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={0 if mode == 'complete' else number}")

    before = spark.conf.get(_PROVIDER, None)
    if stateful:
        spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{target}/state").foreachBatch(put).start()
        query.awaitTermination()
    finally:
        if stateful and before is not None:
            spark.conf.set(_PROVIDER, before)
        elif stateful:
            spark.conf.unset(_PROVIDER)
    names = [*stream.columns, *(["batch"] if keep_batch else [])]
    return spark.read.schema(StructType([*stream.schema.fields, *([StructField("batch", IntegerType())] if keep_batch else [])])).parquet(f"{target}/rows").select(*names)


def fold_all(events: DataFrame) -> DataFrame:
    """Status and times of each job by one aggregate over all its events, so any batches and any order give the rows of
    jobs.fold: the first terminal event is final, and what comes after it is passed over."""
    order, value = F.struct("ts", "seq"), F.col("value")
    status = F.col("kind") == "status"
    out = events.groupBy("job_id").agg(
        F.min(F.when(status & value.isin(*TERMINAL), F.struct("ts", "seq", "value"))).alias("end"),
        F.max_by(F.when(status, value), F.when(status, order)).alias("last"),
        F.min("ts").alias("created_at"),
        F.min(F.when(status & (value == "RUNNING"), order)).alias("run"),
    )
    ran = F.col("end").isNull() | (F.col("run") <= F.struct("end.ts", "end.seq"))
    return out.select("job_id", F.coalesce("end.value", "last", F.lit("QUEUED")).alias("status"), "created_at", F.when(ran, F.col("run.ts")).alias("started_at"), F.col("end.ts").alias("completed_at"))


#: Times are microseconds, which go between Spark and Python without conversion.
STATE = "status string, created long, started long, ended long, timer long, waiting array<struct<us: long, seq: long, value: string>>"
OUTPUT = "job_id string, status string, created long, started long, ended long"
_OUT = Row("job_id", "status", "created", "started", "ended")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple, ts: int, value: str | None) -> tuple:
    """The state (status, created, started, ended) after one more event in order; `value` is null for what is no status."""
    status, created, started, ended = state
    if created is None:
        created = ts
    if value is not None and status not in TERMINAL:
        status = value
        if value == "RUNNING" and started is None:
            started = ts
        if value in TERMINAL:
            ended = ts
    return status, created, started, ended


class JobFold(StatefulProcessor):
    """The fold of one job's events in the order of (ts, seq), whatever the order and the batches in which they come.

    Events that an earlier one may still follow wait in order; once the watermark has passed they are folded into the job's
    state for good. What is given is the state with all that wait. An hour after its end a job is forgotten by a timer. All of a
    job is one value, read and written once a batch, as each call goes from Python to Spark and back.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        status, created, started, ended, timer, waiting = self.job.get() or ("QUEUED", None, None, None, None, ())
        events = [*map(tuple, waiting), *((e.us, e.seq, e.value if e.kind == "status" else None) for e in rows)]
        events.sort(key=lambda e: e[:2])
        state, late = (status, created, started, ended), []
        for event in events:
            if event[0] // 1000 > mark:
                late.append(event)
            else:
                state = step(state, event[0], event[2])
        shown = state
        for us, _, value in late:
            shown = step(shown, us, value)
        due = max(shown[3] // 1000 + self.ttl_ms, mark + 1) if shown[3] is not None else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.job.update((*state, due, late))
        yield _OUT(key[0], *shown)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(value: str = "") -> list[Column]:
    """Status and times of rows, as timestamps."""
    names = {"created": "created_at", "started": "started_at", "ended": "completed_at"}
    return [F.col(f"{value}status"), *(F.timestamp_micros(f"{value}{c}").alias(name) for c, name in names.items())]


def fold_with_state(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Status and times of each job after each batch that has events of it, as jobs.fold gives them for all events so far.

    events are (job_id, seq, ts, kind, value) with a watermark on ts, which says how late an event may come; Spark leaves out
    those that come later. The state of a job is one row with the events that wait. Ended jobs are forgotten after the time to
    live. Needs the RocksDB state store, which run_available() sets with stateful=True.
    """
    own = events.select("job_id", "ts", F.unix_micros("ts").alias("us"), "seq", "kind", "value")
    out = own.groupBy("job_id").transformWithState(statefulProcessor=JobFold(ttl_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
    return out.select("job_id", *_timed())


def last_of_each(rows: DataFrame) -> DataFrame:
    """Of the rows of all batches, with their batch, the last of each job."""
    own = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*own), "batch").alias("r")).select("job_id", "r.*")


def known_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, status, created_at, started_at, completed_at) as folded for good, read from the state of a stream."""
    rows = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
    return rows.where("value.created IS NOT NULL").select("key.job_id", *_timed("value."))
