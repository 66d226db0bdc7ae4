"""Queries: grammars of specifications over columns of texts that events spell, right and wrong ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import spec_columns as P

from . import base as B
from .registry import query

#: The same expression in both engines: texts by event, in turn right and wrong.
_FEATURES = "concat(CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '+' END, CAST(user_id AS STRING), ', -', CAST(event_id % 97 AS STRING), CASE WHEN event_id % 7 = 0 THEN ',x' ELSE ',' END)"
_COUNTS = "concat(CASE event_id % 3 WHEN 0 THEN 'log:' ELSE ' ' END, CAST(event_id % 11 AS STRING), CASE event_id % 4 WHEN 0 THEN concat('-', CAST(user_id AS STRING)) WHEN 1 THEN '-' ELSE '' END)"
_SYSTEMS = "concat(event_type, CASE event_id % 6 WHEN 0 THEN '' ELSE '=' END, CASE event_id % 5 WHEN 0 THEN 's3://a/b:steer' WHEN 1 THEN 'runs/x,clamp' WHEN 2 THEN 'runs/x,clamp,empty' WHEN 3 THEN 'runs,a,b,c' ELSE 'runs/only' END)"
_SWEEPS = "concat('k', CAST(event_id % 4 AS STRING), '=', event_type, ':k2=b=c:', CASE event_id % 3 WHEN 0 THEN 'bare' ELSE '' END)"
_GRIDS = "concat(CAST(event_id % 13 AS STRING), CASE event_id % 4 WHEN 0 THEN '.5' WHEN 1 THEN 'e-1' WHEN 2 THEN ' ' ELSE 'x' END, ', ,-.25')"
_DECODES = "concat(CASE event_id % 5 WHEN 0 THEN 'det' WHEN 1 THEN 'stoch' WHEN 2 THEN 'thr0.1' WHEN 3 THEN 'thr' ELSE 'det5' END, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '@cfg2' WHEN 2 THEN '@temp0.7@cfg3@cfg1.5' ELSE '@top2' END)"
_FILLS = "concat(CASE event_id % 6 WHEN 0 THEN 'parallel' WHEN 1 THEN 'seq-ltr' WHEN 2 THEN ' seq-conf ' WHEN 3 THEN 'cmlm' WHEN 4 THEN 'cmlm0' ELSE 'cmlm0' END, CASE WHEN event_id % 6 = 5 THEN CAST(event_id % 9 + 1 AS STRING) WHEN event_id % 12 = 0 THEN '2' ELSE '' END)"


def _texts(spark, d, expression: str):
    return B.table(spark, d, "events").select("event_id", F.expr(expression).alias("t"))


def _sql(expression: str, right: str, message: str, **parts: str) -> str:
    shown = ", ".join(f"CASE WHEN {right} THEN {v} END AS {k}" for k, v in parts.items())
    text = expression.replace("AS STRING", "AS VARCHAR")
    return f"SELECT event_id, {shown}, CASE WHEN NOT ({right}) THEN '{message}: ' || t END AS error FROM (SELECT event_id, {text} AS t FROM events)"


_ITEMS = "list_filter(string_split(t, '{0}'), lambda x: trim(x) <> '')"


@query("s213_feature_specs", _sql(_FEATURES, f"len(list_filter({_ITEMS.format(',')}, lambda x: NOT regexp_full_match(x, '\\s*[+-]\\d+\\s*'))) = 0", "no feature specification", features=f"array_to_string(list_transform({_ITEMS.format(',')}, lambda x: regexp_replace(trim(x), '^([+-])0*(\\d)', '\\1\\2')), ' ')"))
def s213_feature_specs(spark, d):
    p = _texts(spark, d, _FEATURES).withColumn("p", P.feature_list(F.col("t")))
    shown = F.array_join(F.transform("p.features", lambda x: F.concat(x["sign"], x["feature"].cast("string"))), " ")
    return p.select("event_id", shown.alias("features"), "p.error")


_COUNT = "regexp_full_match(trim(t), '(log:)?\\d+(-\\d+)?')"
_LOW = "CAST(regexp_extract(t, '(\\d+)', 1) AS INTEGER)"


@query("s213_count_specs", _sql(_COUNTS, _COUNT, "no count specification", mode="CASE WHEN trim(t) LIKE 'log:%' THEN 'log' ELSE 'uniform' END", low=_LOW, high=f"CASE WHEN contains(t, '-') THEN CAST(string_split(t, '-')[2] AS INTEGER) ELSE {_LOW} END"))
def s213_count_specs(spark, d):
    return _texts(spark, d, _COUNTS).withColumn("p", P.count_spec(F.col("t"))).select("event_id", "p.*")


_REST = "substr(t, strpos(t, '=') + 1)"
_SYSTEM = f"contains(t, '=') AND CASE WHEN contains({_REST}, ',') THEN len(string_split({_REST}, ',')) BETWEEN 2 AND 3 ELSE contains({_REST}, ':') END"


@query("s213_system_specs", _sql(_SYSTEMS, _SYSTEM, "a system is name=path:mode", name="string_split(t, '=')[1]", path=f"CASE WHEN contains({_REST}, ',') THEN string_split({_REST}, ',')[1] ELSE regexp_replace({_REST}, ':[^:]*$', '') END", mode=f"CASE WHEN contains({_REST}, ',') THEN string_split({_REST}, ',')[2] ELSE string_split({_REST}, ':')[-1] END", condition=f"coalesce(CASE WHEN contains({_REST}, ',') THEN string_split({_REST}, ',')[3] END, 'true')"))
def s213_system_specs(spark, d):
    return _texts(spark, d, _SYSTEMS).withColumn("p", P.system_ref(F.col("t"))).select("event_id", "p.*")


@query("s213_sweep_specs", _sql(_SWEEPS, "t NOT LIKE '%:bare'", "a sweep is label=path:label=path", k0="CASE WHEN event_id % 4 = 0 THEN regexp_extract(t, '=([^:]*)', 1) END", k2="'b=c'", labels="CASE WHEN event_id % 4 = 2 THEN 1 ELSE 2 END"))
def s213_sweep_specs(spark, d):
    p = _texts(spark, d, _SWEEPS).withColumn("p", P.sweep(F.col("t")))
    return p.select("event_id", F.try_element_at("p.paths", F.lit("k0")).alias("k0"), F.try_element_at("p.paths", F.lit("k2")).alias("k2"), F.when(F.col("p.paths").isNotNull(), F.size("p.paths")).alias("labels"), "p.error")


@query("s213_grid_specs", _sql(_GRIDS, "NOT contains(t, 'x')", "a grid is numbers with commas", n="2", first="CAST(trim(string_split(t, ',')[1]) AS DOUBLE)", last="CAST(-0.25 AS DOUBLE)"))
def s213_grid_specs(spark, d):
    p = _texts(spark, d, _GRIDS).withColumn("p", P.grid(F.col("t")))
    return p.select("event_id", F.when(F.col("p.values").isNotNull(), F.size("p.values")).alias("n"), F.get("p.values", 0).alias("first"), F.try_element_at("p.values", F.lit(-1)).alias("last"), "p.error")


@query("s213_decode_specs", _sql(_DECODES, "event_id % 5 < 3 AND event_id % 4 < 3", "no decoding specification", mode="regexp_extract(t, '^[a-z]+')", threshold="CASE WHEN t LIKE 'thr%' THEN CAST(regexp_extract(t, '^thr([0-9.]+)', 1) AS DOUBLE) END", guidance="CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END", temperature="CASE WHEN event_id % 4 = 2 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"))
def s213_decode_specs(spark, d):
    return _texts(spark, d, _DECODES).withColumn("p", P.decode_spec(F.col("t"))).select("event_id", "p.*")


_FILL = "regexp_full_match(trim(t), '(parallel|seq-ltr|seq-conf|cmlm0*[1-9][0-9]*)')"


@query("s213_fill_modes", _sql(_FILLS, _FILL, "no fill mode", mode="regexp_extract(trim(t), '^(parallel|seq-ltr|seq-conf|cmlm)')", passes="CASE WHEN t LIKE 'cmlm%' THEN CAST(regexp_extract(t, '([0-9]+)', 1) AS INTEGER) ELSE 1 END"))
def s213_fill_modes(spark, d):
    return _texts(spark, d, _FILLS).withColumn("p", P.fill_mode(F.col("t"))).select("event_id", "p.*")
