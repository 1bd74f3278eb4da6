"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of letters and digits: every character but ASCII controls, blanks and punctuation (A-Z is lower-cased first).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

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


def release() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of rows that go to a Python worker at once, where the session has Spark's own default of 64 MB.
BATCH_BYTES = 4 << 20


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for ``mapInArrow``, after which the worker gives the memory it freed back to the system: workers live on from
    stage to stage, and what they hold counts against the executor. Bounds the session's batches, too, in bytes, since a
    batch of long texts would else stand in the executor and in the worker at once."""
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if session and session.conf.get(key) in ("67108864b", "67108864", "64MB"):
        session.conf.set(key, BATCH_BYTES)

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and no lost executor costs a recomputation."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only (``lower`` would also change other scripts)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(m)


#: A key that more than one in HOT_SHARE of all rows carry is hot. There are at most HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 400


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join to ``right``, which has one row for each ``key`` and in ``weight`` how many rows of ``left`` carry it.

    Hot keys (at most HOT_SHARE of them, by their definition) go by broadcast, so that their rows stay where
    they are; all others go by a shuffle in which no key has more than 1/HOT_SHARE of the rows.
    """
    least = max(1000, total // HOT_SHARE)
    right = right.where(F.col(key).isNotNull())
    hot, cold = right.where(F.col(weight) > least), right.where(F.col(weight) <= least)
    at_hot = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return at_hot.unionByName(rest.join(cold, key, "left"))
