"""Sessions and lasting intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "corpusloom", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset it is one in the warehouse, or
    a temporary one if all of Spark is one process. A cluster whose warehouse is a local folder too shares none: ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if spark.sparkContext._jsc.sc().isLocal():
            base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        elif warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = f"{warehouse}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def working_dir(spark: SparkSession) -> str:
    """Where the working tables of this application go, below the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def clear_working(spark: SparkSession) -> None:
    """Deletes the working tables of this application. Results that were not written elsewhere can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(working_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
