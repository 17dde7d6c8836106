"""Session settings shared by every entry point."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Partitions a shuffle starts with unless told otherwise; empty and small ones are merged when it is read.
SHUFFLE_PARTITIONS = 2_000


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE, Arrow.

    ``shuffle_partitions`` is for small local runs. Without it a shuffle starts with many partitions, which adaptive
    execution merges to the advised size, so tasks do not grow with the data.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("strataloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or SHUFFLE_PARTITIONS))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a session whose executors are all on this
    machine gets a temporary folder, removed when it ends; a cluster gets an error, since other machines could not read
    such a folder. A lost executor never invalidates what was written.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="strataloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan that fills less than half of the cores, dealt out to all of them; anything else as it is.

    For work in Python that is heavy per row, on tables of a few files. A scan of many files is never shuffled. Plans
    with more than scans and filters are left alone: asking them for their partitions would run them.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"Join|Aggregate|Window|Sort|Repartition|LogicalRDD|Union|Limit|InPandas|InArrow", plan):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
