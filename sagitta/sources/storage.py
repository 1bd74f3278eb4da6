"""Intermediate and stored tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors share. Only a session in local mode that has none set
    gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sagitta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sagitta-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written and read back: cuts lineage, and no lost executor costs a recomputation."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``: only for tables that nothing else reads, or will."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("sagitta-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
