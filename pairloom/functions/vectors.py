"""Sparse and dense vector functions as native columns; sparse vectors are map<int,double>, missing keys 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def normalise(a: Column, eps: float = 1e-8) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(eps)))


def blend(a: Column, b: Column, alpha: float) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y)


def jump_relu(a: Column, threshold: float) -> Column:
    """Entries above the threshold as they are, others 0."""
    return F.transform(a, lambda x: F.when(x > threshold, x.cast("double")).otherwise(0.0))


def sparse(a: Column) -> Column:
    """Dense array to map of its non-zero entries, keyed from 0."""
    entries = F.transform(a, lambda x, i: F.struct(i.alias("key"), x.cast("double").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))


def dense(m: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def entries_by(m: Column, magnitude: bool = False, id_ascending: bool = True) -> Column:
    """Entries of a map, largest value (or magnitude) first; ties by id."""
    rank = lambda v: F.abs(v) if magnitude else v
    tie = F.lit(1 if id_ascending else -1)
    keyed = F.transform(F.map_entries(m), lambda e: F.struct((-rank(e["value"])).alias("r"), (e["key"] * tie).alias("t"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def top_k(m: Column, k: int, magnitude: bool = False, positive: bool = False) -> Column:
    """The k largest entries; `positive` keeps only those above 0."""
    found = F.slice(entries_by(m, magnitude), 1, k)
    return F.map_from_entries(F.filter(found, lambda e: e["value"] > 0) if positive else found)


def top_ids(m: Column, k: int) -> Column:
    """Ids of the k largest, of equal values the larger id first."""
    return F.transform(F.slice(entries_by(m, id_ascending=False), 1, k), lambda e: e["key"])


def top_change(a: Column, b: Column) -> Column:
    """Of two id sets: size of the larger less that of the intersection."""
    return F.greatest(F.size(a), F.size(b)) - F.size(F.array_intersect(a, b))


def combine(a: Column, b: Column, f) -> Column:
    """Outer combination of two sparse vectors by f(value or 0, value or 0)."""
    return F.map_zip_with(a, b, lambda k, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)


def l2_shift(a: Column, b: Column) -> Column:
    return F.sqrt(total(combine(a, b, lambda x, y: (x - y) * (x - y))))


def difference(a: Column, b: Column) -> Column:
    return combine(a, b, lambda x, y: y - x)


def intervention(source: Column, target: Column, k: int) -> Column:
    """struct(amp, sup): the k largest rises and falls from source to target."""
    delta = difference(source, target)
    part = lambda sign: top_k(F.map_filter(F.transform_values(delta, lambda _, v: v * sign), lambda _, v: v > 0), k)
    return F.struct(part(1).alias("amp"), part(-1).alias("sup"))


def satisfaction(delta: Column, amp: Column, sup: Column) -> Column:
    """Share of the wanted change that `delta` makes, each entry counted up to what was wanted; 0 if nothing was."""
    met = lambda want, sign: total(F.map_zip_with(want, delta, lambda k, a, d: F.when(a.isNotNull(), F.greatest(F.least(F.coalesce(d, F.lit(0.0)) * sign, a), -a)).otherwise(0.0)))
    wanted = total(amp) + total(sup)
    return F.when(wanted > 0, (met(amp, 1) + met(sup, -1)) / (wanted + 1e-8)).otherwise(0.0)


def scale(m: Column, by: Column | float) -> Column:
    return F.transform_values(m, lambda _, v: v * by)


def norm_of(m: Column) -> Column:
    return F.sqrt(total(F.transform_values(m, lambda _, v: v * v)))


def rescale(m: Column, wanted_norm: Column) -> Column:
    """To the wanted norm; a zero vector stays."""
    return F.when(norm_of(m) > 0, scale(m, wanted_norm / norm_of(m))).otherwise(m)


def source_gate(delta: Column, source_max: Column) -> Column:
    """Falls of features that the source does not show become 0."""
    return F.map_zip_with(delta, source_max, lambda k, d, s: F.when((d < 0) & (F.coalesce(s, F.lit(0.0)) <= 0), 0.0).otherwise(F.coalesce(d, F.lit(0.0))))


def without(m: Column, blocked: Column) -> Column:
    """Entries of blocked ids become 0."""
    return F.transform_values(m, lambda k, v: F.when(F.array_contains(blocked, k), 0.0).otherwise(v))


def prune(m: Column, threshold: float, digits: int) -> Column:
    """Entries of at least the threshold, rounded half to even."""
    return F.transform_values(F.map_filter(m, lambda _, v: v >= threshold), lambda _, v: F.bround(v, digits))


def size_bucket(n: Column) -> Column:
    bounds = ((0, "empty"), (2, "1-2"), (4, "3-4"), (8, "5-8"), (16, "9-16"), (32, "17-32"))
    out = F.when(n <= 0, "empty")
    for most, name in bounds[1:]:
        out = out.when(n <= most, name)
    return out.otherwise("33+")


def time_features(t: Column, dims: int = 128, base: float = 10000.0) -> Column:
    """Sines then cosines of t at geometric frequencies."""
    half = dims // 2
    frequency = lambda i: F.exp(-F.log(F.lit(base)) * i / half)
    at = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(at, lambda i: F.sin(t * frequency(i))), F.transform(at, lambda i: F.cos(t * frequency(i))))


def linear_score(align: Column, fluency: Column, content: Column, slots: Column, weights=(1.0, 1.0, 1.0, 0.1), gate: float | None = None) -> Column:
    """Weighted sum; minus infinity where `content` is below the gate."""
    w = weights
    value = w[0] * align + w[1] * fluency + w[2] * content - w[3] * slots
    return value if gate is None else F.when(content < gate, F.lit(float("-inf"))).otherwise(value)


def bounded_fluency(delta: Column) -> Column:
    return F.least(F.lit(0.0), F.tanh(delta))


def fire_probability(rate: Column, step: float) -> Column:
    return 1 - F.exp(-step * rate)


def guided(unconditional: Column, conditional: Column, strength: float) -> Column:
    return F.greatest(F.lit(0.0), unconditional + strength * (conditional - unconditional))


def kappa(t: Column) -> Column:
    return F.pow(t, F.lit(3.0))


def time_weight(t: Column, most: float = 20.0) -> Column:
    """3 t^2 / (1 - t^3), at most `most`."""
    return F.when(t >= 1, F.lit(most)).otherwise(F.least(3 * t * t / (1 - kappa(t)), F.lit(most)))


def harmonic3(a: Column, b: Column, c: Column) -> Column:
    return F.when(F.least(a, b, c) == 0, 0.0).otherwise(3 / (1 / F.nullif(a, F.lit(0)) + 1 / F.nullif(b, F.lit(0)) + 1 / F.nullif(c, F.lit(0))))


def effect(true_rate: Column, base_rate: Column, kind: str) -> Column:
    """Relative fall ("abl") or rise ("enh") of a rate against its base; null where it is undefined."""
    if kind == "abl":
        return F.when(true_rate > 0, (true_rate - base_rate) / true_rate)
    return F.when(base_rate < 1, (true_rate - base_rate) / (1 - base_rate))


def penalised(e: Column, weight: float = 0.5) -> Column:
    return F.when(e >= 0, e).otherwise(weight * F.abs(e))


def integrated_effect(enhance: Column, ablate: Column, weight: float = 0.5) -> Column:
    """Harmonic mean of two effects, wrong-way effects weighted down."""
    a, b = penalised(enhance, weight), penalised(ablate, weight)
    return F.when(a + b > 0, 2 * a * b / (a + b)).when(a.isNotNull() & b.isNotNull(), 0.0)


def lens_bias(projection: Column, mean: Column, std: Column, strength: float) -> Column:
    """Standardised projection; null where it hardly varies."""
    return F.when(std >= 1e-6, strength * (projection - mean) / std)
