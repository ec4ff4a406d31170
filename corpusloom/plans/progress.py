"""Progress of a Spark job by the rows that its tasks have passed on."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Seconds between two looks at a job that runs.
EVERY = 0.2


@contextmanager
def counted(spark: SparkSession, told: Callable[[int], None]) -> Iterator[Callable[[int], None]]:
    """Gives passed(rows), for tasks to call with the rows that they are done with.

    While the block runs, told(rows) is called whenever the sum has grown. Spark adds the counts of a task when it ends, so
    the sum grows task by task; a task that is run twice may count twice, so the sum is for show. An error of told() ends the
    telling and no more.
    """
    total = spark.sparkContext.accumulator(0)
    over = threading.Event()

    def watch() -> None:
        last = 0
        while not over.wait(EVERY):
            if total.value != last:
                last = total.value
                try:
                    told(last)
                except Exception:  # the job notices by itself that it is to end
                    return

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield total.add
    finally:
        over.set()
        thread.join()


def through(df: DataFrame, passed: Callable[[int], None]) -> DataFrame:
    """The rows of df, counted as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed(len(batch))
            yield batch

    return df.mapInArrow(run, df.schema)
