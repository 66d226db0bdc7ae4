"""Sinks: rolling shards, nested arrays, idempotent appends, reports and manifests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_shards(df: DataFrame, path: str, rows_per_shard: int, fmt: str = "json") -> None:
    """Shards of at most so many rows each; Spark's committer makes each appear whole or not at all."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard)
    (writer.option("compression", "gzip") if fmt in ("json", "csv") else writer).format(fmt).save(path)


#: Rows that are gathered before they are packed: a worker holds so many at once, whatever the number in its task.
GATHERED = 32_768


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, from, n, orders, columns): a row of lists for each document of some gathered rows (document, order, columns).

    Orders that follow one another are not sent: the first of them says all.
    """

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        codes = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        if (codes[1:] < codes[:-1]).any():
            order = np.argsort(codes, kind="stable")
            rows, codes = rows.take(order), codes[order]
        docs, orders, *columns = (c.combine_chunks() for c in rows.columns)
        new = np.r_[True, codes[1:] != codes[:-1]]
        starts = np.flatnonzero(new)
        ends = np.r_[starts, len(codes)].astype(np.int32)
        follow = np.zeros(len(starts), bool)
        if pa.types.is_integer(orders.type):
            at, known = orders.fill_null(0).to_numpy(), orders.is_valid().to_numpy(zero_copy_only=False)
            follow = np.logical_and.reduceat((np.r_[True, at[1:] == at[:-1] + 1] | new) & known, starts)
        lists = [pa.ListArray.from_arrays(pa.array(ends), c) for c in (orders, *columns)]
        first = pc.if_else(pa.array(follow), orders.take(pa.array(starts)), pa.scalar(None, orders.type))
        lists[0] = pc.if_else(pa.array(follow), pa.scalar(None, lists[0].type), lists[0])
        n = pa.array(np.diff(ends))
        return pa.RecordBatch.from_arrays([docs.take(pa.array(starts)), first, n, *lists], [held[0].schema.names[0], "_from", "_n", *held[0].schema.names[1:]])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= GATHERED:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def ragged(tokens: DataFrame, doc: str, order: str, columns: list[str]) -> DataFrame:
    """Per-token rows as one row of arrays for each document, in token order.

    Rows of a document that lie together are packed where they lie, a column at a time; those runs are sent instead of tokens, and
    runs that follow one another are put together without a look at their tokens.
    """
    names = [f"_{i}" for i in range(len(columns))]
    rows = tokens.select(doc, *(F.col(c).alias(n) for c, n in zip([order, *columns], ["_o", *names], strict=True)))
    kind = rows.schema["_o"].dataType
    sent = [T.StructField("_from", kind), T.StructField("_n", T.IntegerType()), *(T.StructField(n, T.ArrayType(rows.schema[n].dataType)) for n in ("_o", *names))]
    runs = rows.mapInArrow(_runs, T.StructType([rows.schema[doc], *sent])).repartition(doc)
    whole = runs.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*(f.name for f in sent)))).alias("_r"))
    r, last = F.col("_r"), F.size("_r") - 1
    apart = F.lit(isinstance(kind, T.IntegralType)) & F.forall(r, lambda x: x["_from"].isNotNull())
    if isinstance(kind, T.IntegralType):
        follow = F.forall(F.sequence(F.lit(1), last), lambda i: r[i - 1]["_from"].cast("decimal(20)") + r[i - 1]["_n"] <= r[i]["_from"])
        apart = apart & ((last == 0) | F.when(last > 0, follow))
        each = lambda x: F.coalesce(x["_o"], F.transform(F.sequence(F.lit(0), x["_n"] - 1), lambda i: (x["_from"] + i).cast(kind)))
    else:
        each = lambda x: x["_o"]
    zipped = F.transform("_r", lambda x: F.arrays_zip(each(x), *(x[n] for n in names)))
    packed = whole.select(doc, "_r", F.when(~apart, F.array_sort(F.flatten(zipped))).alias("_t"))
    joined = lambda n: F.when(F.col("_t").isNull(), F.flatten(F.transform("_r", lambda x: x[n]))).otherwise(F.col("_t")[n])
    return packed.select(doc, *(joined(n).alias(c) for c, n in zip(columns, names, strict=True)))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table does not hold yet; returns how many.  Repeating it changes nothing."""
    spark = df.sparkSession
    if table_exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = df.dropDuplicates([key]).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def table_exists(spark: SparkSession, path: str, marker: str = "") -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/{marker}" if marker else path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output was committed."""
    return table_exists(spark, path, "_SUCCESS")


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """One JSON row of counts and settings; written last, it marks the run as complete."""
    spark.createDataFrame([{k: str(v) for k, v in facts.items()}]).coalesce(1).write.mode("overwrite").json(path)


#: Rows of a report in one file; a larger table is written in parallel, in files of at most so many rows.
REPORT_ROWS = 1_000_000


def _report(df: DataFrame) -> DataFrameWriter:
    whole = df.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS
    return (df.coalesce(1) if whole else df).write.mode("overwrite").option("maxRecordsPerFile", REPORT_ROWS)


def write_csv_report(df: DataFrame, path: str) -> None:
    _report(df).option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 1000, digits: int = 4) -> str:
    """A bounded result as a Markdown table, null as a dash; a result of more than `limit` rows is an error."""
    shown = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table of more than {limit} rows is no report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows])


def resume_point(spark: SparkSession, path: str, index: str, fmt: str = "json") -> tuple[int, int | None]:
    """(rows, largest index) of what can be read of a folder of shards: broken files, truncated ones and broken lines count for nothing.

    New rows go to new shards, from the index after the largest on.
    """
    if not table_exists(spark, path):
        return 0, None
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if fmt == "json":
        rows = reader.schema(f"`{index}` long, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken is null")
    else:
        rows = reader.format(fmt).load(path).select(F.col(index).cast("long").alias(index))
    found = rows.where(F.col(index).isNotNull()).agg(F.count("*").alias("n"), F.max(index).alias("last")).first()
    return int(found["n"]), found["last"]


def observed(df: DataFrame, **counters) -> tuple[DataFrame, Observation]:
    """`df` with running counters (named aggregate columns) that any action on it fills, without a pass of their own."""
    observation = Observation()
    return df.observe(observation, *(c.alias(name) for name, c in counters.items())), observation


def write_tsv_report(df: DataFrame, path: str) -> None:
    _report(df).option("header", True).option("sep", "\t").csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    _report(df).json(path)
