"""Structured Streaming forms of resumable appends, last-write-wins caches, running counts and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.operators.generation import count_accepts, priority, weighted_pick
from pairloom.sources.sinks import append_new


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def files_for(spark: SparkSession, path: str, batches: int, least: int = 1, fmt: str = "parquet") -> int:
    """Files a trigger with which the files there come in so many micro-batches at most.

    Each micro-batch of `append_once` compares its keys with the whole table so far; with a fixed number of files a trigger, that work is quadratic.
    """
    return max(least, -(-len(spark.read.format(fmt).load(path).inputFiles()) // batches))


def append_once(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Start an append of rows with new keys: a batch that is tried again adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows with keys not seen within the watermark."""
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; times without zone are taken in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def windowed_counts(stream: DataFrame, time: str, length: str, slide: str | None, by: list[str], delay: str, value: str) -> DataFrame:
    """Counts and sums in tumbling or sliding event-time windows; late rows within the delay count."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return _timed(stream, time, delay).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], delay: str) -> DataFrame:
    return _timed(stream, time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def last_write_wins(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Latest value of each key, as a complete or update output."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value))


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    accepted, weight = state.getOption or (0, 1.0)
    for frame in frames:
        accepted += int(frame["ok"].sum())
    weight = 1.0 / (1.0 + accepted)
    state.update((accepted, weight))
    yield pd.DataFrame({"family": [key[0]], "accepted": [accepted], "weight": [weight]})


def adaptive_weights(stream: DataFrame) -> DataFrame:
    """(family, accepted, weight): weights that fall with the accepts so far, kept as state; stream (family, ok)."""
    return stream.groupBy("family").applyInPandasWithState(_update, "family string, accepted long, weight double", "accepted long, weight double", "update", GroupStateTimeout.NoTimeout)


def pick_by_priority(stream: DataFrame, path: str, key: str, accepted: Column, checkpoint: str, *, seed: int = 3):
    """Start a stream of proposals (key, family, t_type, out_text) whose picks, a folder for each micro-batch, feed back into the weights of the next.

    The accepts of a micro-batch are written beside its picks, and the weights of a micro-batch come from those of earlier numbers alone: one that is
    tried again overwrites its own folders with the same rows.  All proposals of a row must come in one micro-batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        accepts: dict[str, int] = {}
        if number:
            known = spark.read.schema("family string, n long, batch long").parquet(f"{path}/accepts").where(F.col("batch") < number)
            accepts = {r["family"]: r["n"] for r in known.groupBy("family").agg(F.sum("n").alias("n")).collect()}  # a row for each family
        weighted_pick(batch, key, priority(accepts), seed).write.mode("overwrite").parquet(f"{path}/picks/batch={number}")
        new = count_accepts(spark.read.parquet(f"{path}/picks/batch={number}"), accepted)
        spark.createDataFrame(sorted(new.items()), "family string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/accepts/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def epochs(df: DataFrame, shard: str, n: int) -> DataFrame:
    """Each row once for each epoch, with the shard's place in the epoch's own order."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("order", F.xxhash64("epoch", shard))


def call_budget(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
