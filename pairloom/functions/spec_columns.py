"""The grammars of `functions.specs` over columns: each gives a struct of the parts and an `error`, null where the text is right.

All parts are null where there is an error; a null text is one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(right: Column, message: str, text: Column, **parts: Column) -> Column:
    fine = F.coalesce(right, F.lit(False))
    error = F.when(~fine, F.concat(F.lit(f"{message}: "), F.coalesce(text, F.lit("null"))))
    return F.struct(*(F.when(fine, v).alias(k) for k, v in parts.items()), error.alias("error"))


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the pattern; null where it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


FEATURE = r"^\s*([+-])(\d{1,9})\s*$"


def feature_list(text: Column) -> Column:
    """struct(features array<struct<feature, sign>>, error) of `+12,-7`."""
    items = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    made = F.transform(items, lambda x: F.struct(F.regexp_extract(x, FEATURE, 2).try_cast("int").alias("feature"), F.regexp_extract(x, FEATURE, 1).alias("sign")))
    return _checked(F.forall(items, lambda x: x.rlike(FEATURE)), "no feature specification", text, features=made)


COUNT = r"^(log:)?(\d{1,9})(?:-(\d{1,9}))?$"


def count_spec(text: Column) -> Column:
    """struct(mode, low, high, error) of `4`, `1-4` or `log:1-32`."""
    t = F.trim(text)
    low = _part(t, COUNT, 2).try_cast("int")
    mode = F.when(_part(t, COUNT, 1).isNull(), "uniform").otherwise("log")
    return _checked(t.rlike(COUNT), "no count specification", text, mode=mode, low=low, high=F.coalesce(_part(t, COUNT, 3).try_cast("int"), low))


NAMED, PLACED = r"^([^=]*)=(.+)$", r"^(.*):([^:]*)$"


def system_ref(text: Column) -> Column:
    """struct(name, path, mode, condition, error) of `name=path:mode` or `name=path,mode[,condition]`."""
    rest = F.regexp_extract(text, NAMED, 2)
    parts = F.split(rest, ",")
    listed = rest.contains(",")
    right = text.rlike(NAMED) & (F.when(listed, F.size(parts).between(2, 3)).otherwise(rest.rlike(PLACED)))
    path = F.when(listed, F.get(parts, 0)).otherwise(F.regexp_extract(rest, PLACED, 1))
    mode = F.when(listed, F.get(parts, 1)).otherwise(F.regexp_extract(rest, PLACED, 2))
    return _checked(right, "a system is name=path:mode", text, name=F.regexp_extract(text, NAMED, 1), path=path, mode=mode, condition=F.when(listed, F.coalesce(F.get(parts, 2), F.lit("true"))).otherwise("true"))


def sweep(text: Column) -> Column:
    """struct(paths map<label, path>, error) of `k1=a:k4=b`; of equal labels the last counts."""
    items = F.filter(F.split(text, ":"), lambda x: x != "")
    label = lambda x: F.regexp_extract(x, r"^([^=]*)=", 1)
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: label(y) == label(x)))
    pairs = F.transform(last, lambda x: F.struct(label(x).alias("k"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("v")))
    return _checked(F.forall(items, lambda x: x.contains("=")), "a sweep is label=path:label=path", text, paths=F.map_from_entries(F.when(F.forall(items, lambda x: x.contains("=")), pairs)))


def grid(text: Column) -> Column:
    """struct(values array<double>, error) of `0.1,2,3e-1`."""
    items = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    numbers = F.transform(items, lambda x: F.trim(x).try_cast("double"))
    plain = F.forall(items, lambda x: F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return _checked(plain, "a grid is numbers with commas", text, values=numbers)


DECODE = r"^(?:(det|stoch)|(thr)(\d+\.?\d*|\.\d+))((?:@(?:cfg|temp)(?:\d+\.?\d*|\.\d+))*)$"


def decode_spec(text: Column) -> Column:
    """struct(mode, threshold, guidance, temperature, error) of `det`, `stoch` or `thr0.1`, with `@cfg2` and `@temp0.7`; of equal options the last counts."""
    options = F.filter(F.split(F.regexp_extract(text, DECODE, 4), "@"), lambda x: x != "")

    def option(name: str) -> Column:
        own = F.filter(options, lambda x: x.startswith(name))
        return F.coalesce(F.substring(F.try_element_at(own, F.lit(-1)), len(name) + 1, 100).try_cast("double"), F.lit(1.0))

    mode = F.coalesce(_part(text, DECODE, 1), _part(text, DECODE, 2))
    return _checked(text.rlike(DECODE), "no decoding specification", text, mode=mode, threshold=_part(text, DECODE, 3).try_cast("double"), guidance=option("cfg"), temperature=option("temp"))


FILL = r"^(?:(parallel|seq-ltr|seq-conf)|(cmlm)0*([1-9]\d{0,8}))$"


def fill_mode(text: Column) -> Column:
    """struct(mode, passes, error) of `parallel`, `seq-ltr`, `seq-conf` or `cmlm8`."""
    t = F.trim(text)
    return _checked(t.rlike(FILL), "no fill mode", text, mode=F.coalesce(_part(t, FILL, 1), _part(t, FILL, 2)), passes=F.coalesce(_part(t, FILL, 3).try_cast("int"), F.lit(1)))
