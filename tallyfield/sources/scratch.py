"""The shared folder of a job, and tables written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Without one, a local folder in local mode (tests), else an error: executors would each write their own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return str(have.get()).rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame, name: str = "settled", **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
