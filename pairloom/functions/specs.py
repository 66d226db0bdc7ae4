"""Small text grammars of specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.hashing import log_uniform


@dataclass(frozen=True)
class FeatureSpec:
    """`+12` strengthens feature 12, `-12` weakens it."""

    feature: int
    sign: str

    @classmethod
    def parse(cls, text: str) -> FeatureSpec:
        found = re.fullmatch(r"\s*([+-])(\d+)\s*", text)
        if not found:
            raise ValueError(f"a feature specification starts with + or -: {text!r}")
        return cls(int(found[2]), found[1])

    @classmethod
    def parse_list(cls, text: str) -> list[FeatureSpec]:
        return [cls.parse(part) for part in text.split(",") if part.strip()]


def intervention_maps(specs: list[FeatureSpec], mu: Column, strength: float = 1.0) -> Column:
    """struct(amp, sup): the mean activations (map mu) of the features named, times the strength."""
    side = lambda sign: F.map_filter(F.transform_values(mu, lambda _, v: v * strength), lambda k, _: k.isin(*[s.feature for s in specs if s.sign == sign] or [-1]))
    return F.struct(side("+").alias("amp"), side("-").alias("sup"))


@dataclass(frozen=True)
class CountSpec:
    """`4` is fixed, `1-4` uniform, `log:1-32` uniform in the logarithm; bounds included."""

    mode: str
    low: int
    high: int

    @classmethod
    def parse(cls, text: str | int) -> CountSpec:
        found = re.fullmatch(r"(log:)?(\d+)(?:-(\d+))?", str(text).strip())
        if not found:
            raise ValueError(f"no count specification: {text!r}")
        return cls("log" if found[1] else "uniform", int(found[2]), int(found[3] or found[2]))

    def draw(self, u: Column) -> Column:
        """Count for a draw from [0, 1)."""
        if self.low >= self.high:
            return F.lit(self.low)
        if self.mode == "log":
            return log_uniform(u, self.low, self.high)
        return F.least(F.floor(u * (self.high - self.low + 1)) + self.low, F.lit(self.high)).cast("int")


@dataclass(frozen=True)
class SystemRef:
    """`name=path:mode`, or `label=path,mode[,condition]`."""

    name: str
    path: str
    mode: str
    condition: str = "true"

    @classmethod
    def parse(cls, text: str) -> SystemRef:
        name, _, rest = text.partition("=")
        if not rest:
            raise ValueError(f"a system is name=path:mode: {text!r}")
        if "," in rest:
            return cls(name, *rest.split(","))
        path, _, mode = rest.rpartition(":")
        return cls(name, path, mode)


def parse_sweep(text: str) -> dict[str, str]:
    """`k1=a:k4=b` by label."""
    return dict(part.split("=", 1) for part in text.split(":") if part)


def parse_grid(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


@dataclass(frozen=True)
class DecodeSpec:
    """`det`, `stoch` or `thr0.1`, with options `@cfg2` and `@temp0.7`."""

    mode: str
    threshold: float | None = None
    guidance: float = 1.0
    temperature: float = 1.0

    @classmethod
    def parse(cls, text: str) -> DecodeSpec:
        head, *options = text.split("@")
        found = re.fullmatch(r"(det|stoch|thr)([\d.]*)", head)
        if not found or (found[1] == "thr") != bool(found[2]):
            raise ValueError(f"no decoding specification: {text!r}")
        values = {}
        for option in options:
            part = re.fullmatch(r"(cfg|temp)([\d.]+)", option)
            if not part:
                raise ValueError(f"unknown option {option!r}")
            values[{"cfg": "guidance", "temp": "temperature"}[part[1]]] = float(part[2])
        return cls(found[1], float(found[2]) if found[2] else None, **values)


@dataclass(frozen=True)
class FillMode:
    """`parallel`, `seq-ltr`, `seq-conf`, or `cmlm8` with its number of passes."""

    mode: str
    passes: int = 1

    @classmethod
    def parse(cls, text: str) -> FillMode:
        found = re.fullmatch(r"(parallel|seq-ltr|seq-conf|cmlm)(\d*)", text.strip())
        if not found or (found[1] == "cmlm") != bool(found[2]) or found[2] and int(found[2]) < 1:
            raise ValueError(f"no fill mode: {text!r}")
        return cls(found[1], int(found[2] or 1))
