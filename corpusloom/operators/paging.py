"""Pages of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.constants import PAGE_LIMIT, PAGE_LIMIT_MOST
from corpusloom.session import working_dir


def parse(page: object = None, limit: object = None) -> tuple[int, int]:
    """Numbers of a request: defaults for missing, zero or malformed ones, at most 500 rows; negative ones are refused."""

    def number(x: object, default: int) -> int:
        try:
            return int(str(x)) or default
        except ValueError:
            return default

    p, n = number(page, 1), number(limit, PAGE_LIMIT)
    if p < 0 or n < 0:
        raise ValueError("page and limit have to be positive")
    return p, min(n, PAGE_LIMIT_MOST)


def page_of(df: DataFrame, order: list[str], page: int, limit: int) -> DataFrame:
    """One page in a total order. The sort keeps (page * limit) rows a task, so no task holds all rows."""
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_info(df: DataFrame, page: int, limit: int) -> DataFrame:
    total = F.col("total")
    pages = F.ceil(total / limit)
    return df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total", pages.cast("long").alias("total_pages"), (pages > page).alias("has_next"), F.lit(page > 1).alias("has_prev"))


class PageIndex:
    """The rows of df in a total order, as ranges of some thousand rows in the shared folder, with the rows before each.

    A page lies in the ranges that its places fall in: one or two while ranges are longer than pages. Only those are read and
    sorted, whatever the page's number. The driver holds two numbers a range.
    """

    def __init__(self, df: DataFrame, order: list[str], rows: int = 50_000, folder: str | None = None):
        spark = df.sparkSession
        self.order, self.folder = order, folder or f"{working_dir(spark)}/pages/{uuid.uuid4().hex}"
        self.spark, self.schema = spark, df.schema
        ranges = max(1, -(-df.count() // rows))
        dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("_range").parquet(self.folder)
        counts = spark.read.schema(StructType([*df.schema.fields, StructField("_range", IntegerType())])).parquet(self.folder).groupBy("_range").count().orderBy("_range").collect()
        self.ranges, self.total = [], 0
        for r in counts:
            self.ranges.append((r["_range"], self.total, r["count"]))
            self.total += r["count"]

    def of(self, page: int, limit: int) -> list[tuple[int, int, int]]:
        """(range, rows before, rows) of the ranges that a page lies in."""
        first, last = (page - 1) * limit, page * limit
        return [r for r in self.ranges if r[1] < last and r[1] + r[2] > first]

    def page(self, page: int, limit: int) -> DataFrame:
        """The rows of page_of(df, order, page, limit)."""
        own = self.of(page, limit)
        if not own:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/_range={r}" for r, _, _ in own))
        return rows.orderBy(*self.order).offset((page - 1) * limit - own[0][1] if (page - 1) * limit > own[0][1] else 0).limit(limit)

    def info(self, page: int, limit: int) -> dict:
        """The row of page_info(df, page, limit), without a job."""
        pages = -(-self.total // limit)
        return {"page": page, "limit": limit, "total": self.total, "total_pages": pages, "has_next": pages > page, "has_prev": page > 1}
