"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in this one process, as in tests, a temporary folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(context, "_pairloom_shared", None) or tempfile.mkdtemp(prefix="pairloom-")
        context._pairloom_shared = found
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: an executor's loss then costs no recomputation.

    The files stay until the folder is emptied with the application's other checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pairloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids are broadcast up to this many (16 MB as long values with their hash table), else shuffled.
BROADCAST_IDS = 300_000


def keep_ids(df: DataFrame, on: str, ids: DataFrame, count: int) -> DataFrame:
    """Semi-join with `count` distinct ids: broadcast when they are few, else by a shuffle."""
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, on, "left_semi")


def give_back() -> None:
    """Return freed memory to the system: workers stay for later stages, and several share an executor's bound."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)


def released(run):
    """The function over batches, with freed memory given back when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def binary(name: str) -> Column:
    """The UTF-8 bytes of a text column."""
    return F.col(name).cast("string").cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
