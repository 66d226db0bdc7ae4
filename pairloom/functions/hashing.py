"""Deterministic draws from keys, the same in every engine that has 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MODULUS = 2147483648


def lcg(key: Column, seed: int = 0) -> Column:
    """Integer from 0 to 2**31 - 1, by two steps of a linear congruence."""
    step = lambda x: F.pmod(x * 1103515245 + 12345, F.lit(_MODULUS))
    return step(step(F.pmod(key.cast("long") + seed * 7919, F.lit(_MODULUS))))


def uniform(key: Column, seed: int = 0) -> Column:
    """Draw from [0, 1)."""
    return lcg(key, seed) / _MODULUS


def sql_lcg(key: str, seed: int = 0) -> str:
    """The same integer in DuckDB's SQL."""
    step = lambda x: f"(({x}) * 1103515245 + 12345) % {_MODULUS}"
    return step(step(f"(CAST({key} AS HUGEINT) + {seed * 7919}) % {_MODULUS}"))


def sql_uniform(key: str, seed: int = 0) -> str:
    return f"(CAST({sql_lcg(key, seed)} AS DOUBLE) / {_MODULUS})"


def row_seed(index: Column, seed: int, offset: int = 0) -> Column:
    """Independent streams per row."""
    return F.lit(seed).cast("long") * 1000003 + index + offset


def crc_of(*parts: Column) -> Column:
    return F.crc32(F.concat_ws("|", *parts).cast("binary"))


def pick_index(u: Column, n: Column) -> Column:
    """Index from 0 to n - 1 by a draw."""
    return F.least(F.floor(u * n), n - 1).cast("int")


def log_uniform(u: Column, low: int, high: int) -> Column:
    """Integer from low to high, uniform in its logarithm."""
    return F.least(F.floor(F.exp(F.log(F.lit(float(low))) + u * (F.log(F.lit(high + 1.0)) - F.log(F.lit(float(low)))))), F.lit(high)).cast("int")


def categorical(u: Column, weights: dict[str, float]) -> Column:
    """Name drawn by cumulative weights, in the order given."""
    total, edge, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        edge += weights[name] / total
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def truncated_geometric(u: Column, p: float, low: int, high: int) -> Column:
    """Integer from low to high with odds falling by (1 - p), by inverse CDF."""
    edge, mass, out = 0.0, sum((1 - p) ** k for k in range(high - low + 1)), None
    for k in range(low, high):
        edge += (1 - p) ** (k - low) / mass
        out = F.when(u < edge, k) if out is None else out.when(u < edge, k)
    return F.lit(high) if out is None else out.otherwise(high)


def poisson(u: Column, rate: float, most: int = 12) -> Column:
    """Poisson count by inverse CDF, cut at `most` (chance below 1e-9 for rates up to 1)."""
    import math

    edge, out = 0.0, None
    for k in range(most):
        edge += math.exp(-rate) * rate**k / math.factorial(k)
        out = F.when(u < edge, k) if out is None else out.when(u < edge, k)
    return out.otherwise(most)


_WORDS32 = 4294967296


def text_uniform(*parts: Column) -> Column:
    """Draw from (0, 1), keyed by texts: the first 32 bits of their md5."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / _WORDS32


def sql_text_uniform(*parts: str) -> str:
    """The same draw in DuckDB's SQL."""
    return f"((CAST('0x' || md5(concat_ws('|', {', '.join(parts)}))[1:8] AS BIGINT) + 0.5) / {_WORDS32})"
