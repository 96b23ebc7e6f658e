"""Session builder and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "scholarloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps and adaptive execution; ``conf`` wins over the defaults.

    The shuffle count is an upper bound: AQE coalesces small partitions and splits skewed ones,
    so a cluster should pass a large ``spark.sql.shuffle.partitions`` rather than a small one.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    A folder of our own is only made for local masters, where driver and executors share a disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="scholarloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back: lineage is cut, readers get their columns and filters only.

    Used between rounds of iterative jobs, for views that several queries read, and wherever a value that depends on
    partition placement must not change when a lost executor makes Spark recompute it.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    frame.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
