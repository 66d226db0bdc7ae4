"""Eligibility, caps, samples and splits, all by explicit positions and hashed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions.hashing import lcg
from pairloom.functions.text import let


#: Rows that one task numbers, ranges at most, and sampled keys for each range.
NUMBERED, RANGES, SAMPLED = 500_000, 1_000, 50


def _place(bounds: list[Column], key: Column) -> Column:
    """Number of the ascending bounds that do not pass the key: first among every so-manieth, then within what lies between two of these."""
    step = max(1, math.isqrt(len(bounds)))
    upto = lambda held: F.size(F.filter(held, lambda b: b <= key))
    within = lambda n: (n - 1) * step + upto(F.slice(F.array(*bounds), (n - 1) * step + 1, step))
    return let(upto(F.array(*bounds[::step])), lambda n: F.when(n > 0, within(n)).otherwise(0))


def number_rows(df: DataFrame, *order: str, into: str = "idx", start: int = 0, within: list[str] | None = None, numbered: int = NUMBERED) -> DataFrame:
    """Consecutive numbers in the given (ascending) order.

    Within groups, and over a table of at most `numbered` rows, it is one window.  A larger table is cut into
    ranges of the order's values whose bounds, from a sample picked by hash, are written into the plan: the
    range of a row follows from the row alone, however often it is computed.  Then sizes of the ranges are
    summed and ranks taken within them.
    """
    if within:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1 + start)
    count = df.count()
    ranges = min(RANGES, -(-count // numbered))
    if ranges <= 1:
        return df.withColumn(into, F.row_number().over(Window.orderBy(*order)) - 1 + start)
    key = F.struct(*(F.col(c) for c in order))
    keys = df.select(key.alias("k")).where(F.pmod(F.xxhash64(*(f"k.{c}" for c in order)), F.lit(max(1, count // (SAMPLED * ranges)))) == 0)
    # of some SAMPLED * ranges keys, at most 16 times as many where they repeat, every so-manieth is a bound
    sample = [r[0] for r in keys.orderBy("k").limit(16 * SAMPLED * ranges).collect()]
    bounds = list(dict.fromkeys(tuple(sample[i * len(sample) // ranges]) for i in range(1, ranges))) if sample else []
    types = df.select(key.alias("k")).schema["k"].dataType
    written = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, types, strict=True))) for b in bounds]
    part = _place(written, key) if bounds else F.lit(0)
    ranged = df.withColumn("_part", part)
    sizes = ranged.groupBy("_part").count()  # a row for each range
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_own") - 1 + start).drop("_part", "_own", "_before")


def head(df: DataFrame, n: int, *, by: list[str], order: str) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def random_rows(df: DataFrame, n: int, *, by: list[str], key: Column, seed: int = 0) -> DataFrame:
    """At most n rows of each group, drawn by a hash of `key`."""
    order = Window.partitionBy(*by).orderBy(lcg(key, seed), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def stride_rows(df: DataFrame, n: int, *, by: list[str], order: str) -> DataFrame:
    """The rows at the places floor(i * size / n) of each group, at most n."""
    group = Window.partitionBy(*by)
    ranked = df.withColumns({"_i": F.row_number().over(group.orderBy(order)) - 1, "_size": F.count("*").over(group)})
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_size") / n).cast("int"))
    return ranked.where(F.array_contains(places, F.col("_i").cast("int"))).drop("_i", "_size")


def eligible(df: DataFrame, size: Column, low: int, high: int) -> DataFrame:
    return df.where(size.between(low, high))


def partition_rows(df: DataFrame, idx: Column, stride: int, offset: int) -> DataFrame:
    """Worker `offset` of `stride`: disjoint and complete over all offsets."""
    return df.where(F.pmod(idx, F.lit(stride)) == offset)


def skip_rows(df: DataFrame, idx: Column, n: int) -> DataFrame:
    """Without the first n of rows numbered from 1."""
    return df.where(idx > n)


def limit_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hold_out_shards(df: DataFrame, shard: Column, train: int, more: int) -> DataFrame:
    return df.where((shard >= train) & (shard < train + more))


def shuffled_sample(df: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """Prefix of a hashed shuffle: smaller samples are parts of larger ones."""
    return df.orderBy(lcg(key, seed), key).limit(n)


def split_by_shuffle(df: DataFrame, key: Column, sizes: dict[str, int], rest: str, seed: int = 0) -> DataFrame:
    """Column `split`: the first rows of a hashed shuffle by name, the others `rest`."""
    ranked = number_rows(df.withColumn("_u", lcg(key, seed)).withColumn("_k", key), "_u", "_k", into="_r")
    edge, name = 0, None
    for split, n in sizes.items():
        edge += n
        name = F.when(F.col("_r") < edge, split) if name is None else name.when(F.col("_r") < edge, split)
    return ranked.withColumn("split", name.otherwise(rest)).drop("_u", "_k", "_r")


def families(family: Column, kind: Column, prefixes: dict[str, str], is_transform: Column) -> Column:
    """Families of a record: those named, else by the prefix of each kind; none for other records."""
    known = F.create_map(*(F.lit(x) for item in prefixes.items() for x in item))
    prefix = lambda t: F.element_at(F.split(F.element_at(F.split(t, "/"), 1), ":"), 1)
    derived = F.transform(F.split(kind, r"\+"), lambda t: F.coalesce(F.try_element_at(known, prefix(t)), prefix(t)))
    none = F.array().cast("array<string>")
    return F.when(~F.coalesce(is_transform, F.lit(False)), none).when(F.coalesce(family, F.lit("")) != "", F.split(family, r"\+")).when(F.coalesce(kind, F.lit("")) != "", derived).otherwise(none)


def keep_families(df: DataFrame, column: str, exclude: list[str] = (), only: list[str] = ()) -> DataFrame:
    """Drop rows with an excluded family; with `only`, keep those with one of them."""
    if exclude:
        df = df.where(~F.arrays_overlap(column, F.array(*map(F.lit, exclude))))
    return df.where(F.arrays_overlap(column, F.array(*map(F.lit, only)))) if only else df


def within_length(df: DataFrame, a: Column, b: Column, most: int) -> DataFrame:
    return df.where(F.greatest(F.size(a), F.size(b)) <= most)


def without_siblings(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")
