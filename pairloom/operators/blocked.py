"""Every row against every row, in blocks: parts of the table as matrices, through which all rows pass in batches.

What a task holds is one part; what is sent is the table once for each part, and once for each share of the passing rows.  The work is quadratic by
definition, so its results must be bounded: the best of each row, or sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part, and rows that pass through it at a time.
PART, AT_ONCE = 16_384, 256

#: Rows that pass through a part in one task.
PASSING = 8 * PART

#: (ids, matrix) of the part and of some rows that pass through it -> columns of the result.
Step = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _through(step: Step, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, gathered, held = None, [], None
        for batch in batches:
            parts, passing = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((np.diff(parts) != 0) | (np.diff(passing.astype(np.int8)) != 0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    part, gathered, held = parts[a], [], None
                own = batch.slice(a, b - a)
                ids, matrix = own.column(2).to_numpy(), own.column(3).flatten().to_numpy().reshape(b - a, -1)
                if not passing[a]:
                    gathered.append((ids, matrix))
                    continue
                if held is None:
                    if not gathered:  # no row was dealt to this part
                        continue
                    held = tuple(np.concatenate(x) for x in zip(*gathered, strict=True))
                for cut in range(0, len(ids), AT_ONCE):
                    found = step(*held, ids[cut : cut + AT_ONCE], matrix[cut : cut + AT_ONCE])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, schema.types, strict=True)], schema=schema)

    return run


def every_pair(vectors: DataFrame, key: str, vector: str, step: Step, schema: pa.Schema, *, part: int = PART) -> DataFrame:
    """What `step` makes of all rows against all rows; vectors of one length, keys of integers, nulls left out."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    count = rows.count()
    parts = max(1, -(-count // part), min(spark.sparkContext.defaultParallelism, -(-16 * count // part)))
    shares = max(1, -(-count // PASSING))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # a unit is a part with a share of the passing rows, each in a task of its own, so that no task grows with the table
    dealt = rows.withColumn("share", every(shares)).select((F.pmod(F.xxhash64("id"), F.lit(parts)) * shares + F.col("share")).alias("part"), F.lit(False).alias("passing"), "id", "v")
    passing = rows.withColumn("own", every(parts)).select((F.col("own") * shares + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shares))).alias("part"), F.lit(True).alias("passing"), "id", "v")
    units = dealt.union(passing).repartitionById(parts * shares, F.col("part").cast("int")).sortWithinPartitions("part", "passing")
    return units.mapInArrow(_through(step, schema), ", ".join(f"{f.name} {({'int64': 'long', 'double': 'double'})[str(f.type)]}" for f in schema))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)
