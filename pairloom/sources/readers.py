"""Sources with explicit schemas, tolerant of dirty rows."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.relational import first_per_key, last_per_key


def shard_slice(paths: list[str], start: int = 0, most: int | None = None) -> list[str]:
    return paths[start : None if most is None else start + most]


def parse_documents(lines: DataFrame, least: int = 0, longest: int | None = None) -> DataFrame:
    """Texts of JSON lines (value, shard): blank and broken lines, missing and short texts are dropped, long ones cut."""
    parsed = lines.where(F.trim("value") != "").withColumn("text", F.get_json_object("value", "$.text"))
    kept = parsed.where(F.col("text").isNotNull() & (F.length("text") >= least))
    return kept.withColumn("text", F.substring("text", 1, longest) if longest else F.col("text")).drop("value")


def read_documents(spark: SparkSession, paths: str | list[str], least: int = 0, longest: int | None = None) -> DataFrame:
    """Text shards of JSON lines, compressed or not; the readable prefix of a damaged shard counts."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(paths).select("value", F.input_file_name().alias("shard"))
    return parse_documents(lines, least, longest)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines by schema; bad lines are dropped, or kept in `_corrupt_record`."""
    if keep_corrupt:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_keyed(spark: SparkSession, path: str, schema: str, key: str, order: Column) -> DataFrame:
    """JSON lines of which the last of each key counts."""
    rows = read_jsonl(spark, path, schema).withColumn("_line", order)
    return last_per_key(rows, key, "_line").drop("_line")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; empty cells are null."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(schema).csv(path)


def read_json_map(spark: SparkSession, path: str, value: str, key: str = "key", into: str = "value") -> DataFrame:
    """A JSON object as a table of its entries."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, into))


def shuffled_shards(shards: DataFrame, shard: str, worker: int, workers: int, epoch: int = 0) -> DataFrame:
    """Every `workers`-th shard from `worker` on, in an order that changes with the epoch; `position` numbers it."""
    rank = F.row_number().over(Window.orderBy(shard)) - 1  # a row for each shard
    own = shards.select(shard).distinct().withColumn("_n", rank).where(F.pmod("_n", F.lit(workers)) == worker)
    order = Window.orderBy(F.xxhash64(F.lit(epoch), shard), shard)
    return own.withColumn("position", F.row_number().over(order) - 1).drop("_n")


def language_rows(df: DataFrame, language: str, *order: str, column: str = "language") -> DataFrame:
    """Rows of a language, numbered after the filter."""
    from pairloom.operators.sampling import number_rows

    return number_rows(df.where(F.col(column) == language), *order)


def paraphrase_pairs(df: DataFrame) -> DataFrame:
    """(src, tgt, t_type, reversible) of labelled sentence pairs: label 1 only, both directions."""
    return df.where("label = 1").select(F.col("sentence1").alias("src"), F.col("sentence2").alias("tgt"), F.lit("paws").alias("t_type"), F.lit(True).alias("reversible"))


def instruction_pairs(df: DataFrame, tasks: list[str]) -> DataFrame:
    """(src, tgt, t_type, reversible) of instructed edits: the instruction ends at the first ": "; rows without it are dropped."""
    body = F.regexp_extract("src", r"(?s)^.*?: (.*)$", 1)
    return df.where(F.col("task").isin(tasks) & F.col("src").contains(": ")).select(body.alias("src"), "tgt", F.col("task").alias("t_type"), (F.col("task") == "paraphrase").alias("reversible"))


def descriptions(df: DataFrame) -> DataFrame:
    """First non-empty description of each feature over batches (batch, line, f, description)."""
    return first_per_key(df.where(F.trim("description") != ""), "f", "batch", "line").select("f", "description")


def vectors_from_arrays(spark: SparkSession, arrays, key: str = "f", into: str = "v") -> DataFrame:
    """A bounded numpy vector as a table."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({key: range(len(arrays)), into: arrays}))


#: A file of arrays is read whole; larger ones are no vectors but tables.
ARRAY_BYTES = 64 * 1024 * 1024


def read_array(spark: SparkSession, path: str, name: str | None = None, key: str = "f", into: str = "v") -> DataFrame:
    """A numpy vector from an .npy file, or by name from an .npz file, on any store that Spark reads."""
    import io

    import numpy as np

    file = spark.read.format("binaryFile").load(path).select("length", "content").limit(1)
    if (size := file.select("length").first()[0]) > ARRAY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {ARRAY_BYTES} are read")
    found = np.load(io.BytesIO(bytes(file.first()["content"])), allow_pickle=False)
    return vectors_from_arrays(spark, found if name is None else found[name], key, into)


class ShardOrder:
    """A keyed permutation of n shards for each epoch that is computed, not sorted: i -> (a * i + b) mod n, a prime to n.

    `position` and `index` are inverse to each other, so a worker finds the shard at any step of its own without a
    table of the order, and a resumed worker starts where it left off.  a and b come from md5 of (seed, epoch).
    """

    def __init__(self, n: int, seed: int = 0):
        if not 0 < n < 1 << 31:
            raise ValueError("a permutation needs 1 to 2**31 - 1 shards")
        self.n, self.seed = n, seed

    def keys(self, epoch: int) -> tuple[int, int]:
        draw = lambda name: int(hashlib.md5(f"{self.seed}|{epoch}|{name}".encode()).hexdigest()[:8], 16)
        a = draw("a") % self.n
        while math.gcd(a, self.n) != 1:
            a += 1
        return a, draw("b") % self.n

    def position(self, index: Column, epoch: int) -> Column:
        a, b = self.keys(epoch)
        return F.pmod(index.cast("long") * a + b, F.lit(self.n))

    def index(self, position: Column, epoch: int) -> Column:
        a, b = self.keys(epoch)
        return F.pmod(F.pmod(position.cast("long") - b, F.lit(self.n)) * pow(a, -1, self.n), F.lit(self.n))

    def steps(self, spark: SparkSession, epoch: int, worker: int, workers: int, first: int = 0) -> DataFrame:
        """(epoch, worker, step, index) of the shards that a worker reads from its step `first` on: positions worker, worker + workers, ..."""
        count = max(0, -(-(self.n - worker) // workers))
        steps = spark.range(first, max(first, count)).withColumnRenamed("id", "step")
        return steps.select(F.lit(epoch).alias("epoch"), F.lit(worker).alias("worker"), "step", self.index(F.col("step") * workers + worker, epoch).alias("index"))
