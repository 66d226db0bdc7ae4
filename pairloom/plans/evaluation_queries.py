"""Queries: joins, aggregates, windows, set operations, tests and streaming-like behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions import text as T
from pairloom.operators import evaluation as E
from pairloom.operators import relational as J

from . import base as B
from .registry import query

V = B.SQL_VERDICTS
KINDS = ["click", "purchase", "signup", "view", "error"]


def _events(spark, d):
    return B.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_SQL_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def _systems(spark, d):
    """(idx, sys, exact, gain): one row for each user and event type."""
    return B.table(spark, d, "events").groupBy(F.col("user_id").alias("idx"), F.col("event_type").alias("sys")).agg(F.avg("value").alias("gain"), F.avg((F.col("value") > 100).cast("int")).alias("exact"))


_SQL_SYSTEMS = "(SELECT user_id AS idx, event_type AS sys, avg(value) AS gain, avg(CAST(value > 100 AS INTEGER)) AS exact FROM events GROUP BY ALL)"


def _two_types(spark, d):
    names = [r[0] for r in B.table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return names


_FIRST, _SECOND = "(SELECT min(event_type) FROM events)", "(SELECT min(event_type) FROM events WHERE event_type > (SELECT min(event_type) FROM events))"


# Joins


@query("j1_systems_aligned", f"SELECT idx, sys, round(gain, 6) AS gain FROM {_SQL_SYSTEMS} WHERE idx IN (SELECT idx FROM {_SQL_SYSTEMS} WHERE sys IN ({_FIRST}, {_SECOND}) GROUP BY idx HAVING count(DISTINCT sys) = 2) AND sys IN ({_FIRST}, {_SECOND})")
def j1_systems_aligned(spark, d):
    return J.aligned(_systems(spark, d), "idx", "sys", _two_types(spark, d)).select("idx", "sys", F.round("gain", 6).alias("gain"))


@query("j2_two_file_join", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j2_two_file_join(spark, d):
    return B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("j3_j4_exclusion", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY lang")
def j3_j4_exclusion(spark, d):
    return B.documents(spark, d).join(B.table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query("j5_j6_defaults", "SELECT d.doc_id, coalesce(CAST(l.quality AS INTEGER), -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j5_j6_defaults(spark, d):
    return J.with_default(B.documents(spark, d).select("doc_id"), B.table(spark, d, "labels"), "doc_id", "quality", -1)


@query("j7_control_join", """WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT user_id, event_type, max(value) AS control FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, event_type, 'matched' AS part, round(v, 6) AS v, round(control, 6) AS control FROM a JOIN c USING (user_id, event_type) UNION ALL SELECT user_id, event_type, 'unmatched', round(v, 6), NULL FROM a ANTI JOIN c USING (user_id, event_type)""")
def j7_control_join(spark, d):
    e = B.table(spark, d, "events")
    keys = ["user_id", "event_type"]
    a = e.where("event_id % 2 = 0").groupBy(*keys).agg(F.max("value").alias("v"))
    c = e.where("event_id % 2 = 1").groupBy(*keys).agg(F.max("value").alias("control"))
    hit, miss = J.with_control(a, c, keys)
    value = lambda c: F.round(c, 6).alias(c)
    matched = hit.select(*keys, F.lit("matched").alias("part"), value("v"), value("control"))
    return matched.union(miss.select(*keys, F.lit("unmatched").alias("part"), value("v"), F.lit(None).cast("double").alias("control")))


@query("j8_direction_by_text", f"""WITH p AS (SELECT conv_id AS idx, turn, source_text AS s1, target_text AS s2, CAST(conv_id % 3 AS VARCHAR) AS feature FROM {B.SQL_TURNS} WHERE turn = 0),
s AS (SELECT feature, s1 AS tgt, 'enh' AS dir, idx, 0 AS o FROM p UNION ALL SELECT feature, s2, 'abl', idx, 1 FROM p), l AS (SELECT feature, tgt, arg_max(dir, idx * 2 + o) AS dir FROM s GROUP BY feature, tgt)
SELECT dir, count(*) AS n FROM (SELECT CAST(conv_id % 3 AS VARCHAR) AS feature, text AS tgt FROM conversations) JOIN l USING (feature, tgt) GROUP BY dir""")
def j8_direction_by_text(spark, d):
    feature = (F.col("conv_id") % 3).cast("string").alias("feature")
    pairs = B.turn_pairs(spark, d).where("turn = 0").select(F.col("conv_id").alias("idx"), feature, F.col("source_text").alias("sentence1"), F.col("target_text").alias("sentence2"))
    outputs = B.table(spark, d, "conversations").select(feature, F.col("text").alias("tgt"))
    return J.direction_by_text(pairs, outputs).groupBy("dir").agg(F.count("*").alias("n"))


@query("j9_outer_chain", """SELECT c.c_custkey, o.n AS orders, l.items, h.high FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c.c_custkey LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS high FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) h ON h.o_custkey = c.c_custkey""")
def j9_outer_chain(spark, d):
    o, l = B.table(spark, d, "orders"), B.table(spark, d, "lineitem")
    key = F.col("o_custkey").alias("c_custkey")
    n = o.groupBy(key).agg(F.count("*").alias("orders"))
    items = l.select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(key).agg(F.count("*").alias("items"))
    high = o.where("o_orderstatus = 'F'").groupBy(key).agg(F.round(F.max("o_totalprice"), 2).alias("high"))
    return J.outer_chain(B.table(spark, d, "customer").select("c_custkey"), [n, items, high], "c_custkey")


@query("j10_interval_overlap", f"""SELECT t.doc_id, count(*) AS n FROM (SELECT doc_id, pos * 3 AS cs, pos * 3 + 3 AS ce FROM {B.SQL_TOKENS} WHERE pos < 60) t JOIN (SELECT doc_id, 10 + doc_id % 7 AS rs, 40 + doc_id % 11 AS re FROM documents UNION ALL SELECT doc_id, 5, 5 FROM documents) r ON r.doc_id = t.doc_id AND rs < re AND ce > rs AND cs < re GROUP BY t.doc_id""")
def j10_interval_overlap(spark, d):
    t = B.tokens(spark, d).select("doc_id", (F.col("pos") * 3).alias("cs"), (F.col("pos") * 3 + 3).alias("ce"))
    docs = B.documents(spark, d)
    r = docs.select("doc_id", (10 + F.col("doc_id") % 7).alias("cs"), (40 + F.col("doc_id") % 11).alias("ce")).union(docs.select("doc_id", F.lit(5), F.lit(5)))
    return J.overlaps(t, r, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("j11_system_pairs", f"SELECT a.sys AS sys_a, b.sys AS sys_b, count(*) AS n, round(avg(a.gain - b.gain), 6) AS delta FROM {_SQL_SYSTEMS} a JOIN {_SQL_SYSTEMS} b USING (idx) WHERE a.sys < b.sys GROUP BY ALL")
def j11_system_pairs(spark, d):
    pairs = J.system_pairs(_systems(spark, d), "idx", "sys", "gain")
    return pairs.groupBy("sys_a", "sys_b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value_a") - F.col("value_b")), 6).alias("delta"))


@query("j12_set_pairs", """WITH s AS (SELECT DISTINCT user_id % 50 AS grp, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), z AS (SELECT grp, user_id, count(DISTINCT event_type || k) AS n FROM s GROUP BY ALL),
c AS (SELECT x.grp, x.user_id AS a, y.user_id AS b, count(*) AS c FROM s x JOIN s y ON x.grp = y.grp AND x.event_type = y.event_type AND x.k = y.k AND x.user_id < y.user_id GROUP BY ALL)
SELECT c.grp, a, b, round(c / (p.n + q.n - c), 6) AS jaccard FROM c JOIN z p ON p.user_id = a JOIN z q ON q.user_id = b""")
def j12_set_pairs(spark, d):
    e = _events(spark, d)
    sets = e.groupBy((F.col("user_id") % 50).alias("grp"), "user_id").agg(F.collect_set(F.concat("event_type", F.col("k").cast("string"))).alias("items"))
    return J.set_pairs(sets, "grp", "user_id", "items").select("grp", "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("j13_weight_grid", "SELECT w1, w2, round(max(w1 * l_quantity - w2 * l_discount * 100), 6) AS best, count(*) AS n FROM lineitem, (VALUES (0.5), (1.0)) a(w1), (VALUES (0.1), (0.2), (0.4)) b(w2) GROUP BY w1, w2")
def j13_weight_grid(spark, d):
    grid = J.grid(spark, w1=[0.5, 1.0], w2=[0.1, 0.2, 0.4])
    each = J.over_grid(B.table(spark, d, "lineitem").select("l_quantity", "l_discount"), grid)
    return each.groupBy("w1", "w2").agg(F.round(F.max(F.col("w1") * F.col("l_quantity") - F.col("w2") * F.col("l_discount") * 100), 6).alias("best"), F.count("*").alias("n"))


@query("j14_template_slots", "SELECT p_partkey, p_size % 4 AS gaps, least(CAST(3 ^ (p_size % 4) AS BIGINT), 20) AS n FROM part")
def j14_template_slots(spark, d):
    gaps = (F.col("p_size") % 4).alias("gaps")
    return B.table(spark, d, "part").select("p_partkey", gaps, F.size(J.template_slots(F.col("p_size") % 4, 3, 20)).cast("long").alias("n"))


@query("j18_sparse_outer", "SELECT coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(a.v, 0) - coalesce(b.v, 0), 6) AS dv FROM (SELECT user_id, sum(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1) a FULL JOIN (SELECT user_id, sum(value) AS v FROM events WHERE event_id % 3 = 1 GROUP BY 1) b USING (user_id)")
def j18_sparse_outer(spark, d):
    e = B.table(spark, d, "events")
    part = lambda r, n: e.where(f"event_id % 3 = {r}").groupBy("user_id").agg(F.sum("value").alias(n))
    return part(0, "a").join(part(1, "b"), "user_id", "full").select("user_id", F.round(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 6).alias("dv"))


@query("j19_semi", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def j19_semi(spark, d):
    returned = B.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("j20_both_conditions", "SELECT user_id, round(max(value) FILTER (WHERE event_id % 2 = 0), 6) AS value_true, round(max(value) FILTER (WHERE event_id % 2 = 1), 6) AS value_random FROM events GROUP BY user_id HAVING value_true IS NOT NULL AND value_random IS NOT NULL")
def j20_both_conditions(spark, d):
    e = B.table(spark, d, "events").withColumn("condition", F.when(F.col("event_id") % 2 == 0, "true").otherwise("random"))
    out = J.both_conditions(e, ["user_id"], "condition", "value")
    return out.select("user_id", F.round("value_true", 6).alias("value_true"), F.round("value_random", 6).alias("value_random"))


@query("j21_exactness_split", f"SELECT source_text = target_text AS same, count(*) AS n, round(avg(turn), 6) AS mean_turn FROM {B.SQL_TURNS} GROUP BY 1")
def j21_exactness_split(spark, d):
    t = B.turn_pairs(spark, d)
    return t.groupBy((F.col("source_text") == F.col("target_text")).alias("same")).agg(F.count("*").alias("n"), F.round(F.avg("turn"), 6).alias("mean_turn"))


@query("j22_label_lookup", "SELECT s_suppkey, substr(coalesce(n_name, ''), 1, 5) AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j22_label_lookup(spark, d):
    names = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")  # a row for each nation
    return B.table(spark, d, "supplier").join(F.broadcast(names), "s_nationkey", "left").select("s_suppkey", F.substring(F.coalesce("n_name", F.lit("")), 1, 5).alias("nation"))


@query("j23_probability_lookup", f"""WITH t AS (SELECT * FROM {B.SQL_TOKENS}), c AS (SELECT token, count(*) AS c FROM t WHERE doc_id % 2 = 0 GROUP BY token), z AS (SELECT sum(c) AS total, count(*) AS v FROM c)
SELECT doc_id, round(avg(coalesce(ln((c + 1.0) / (total + v + 1)), ln(1.0 / (total + v + 1)))), 6) AS mean_log_prob FROM t LEFT JOIN c USING (token), z GROUP BY doc_id""")
def j23_probability_lookup(spark, d):
    from pairloom.operators.generation import looked_up, unigrams

    t = B.tokens(spark, d).select("doc_id", "token")
    joined = looked_up(t, unigrams(t.where("doc_id % 2 = 0")))
    return joined.groupBy("doc_id").agg(F.round(F.avg("log_prob"), 6).alias("mean_log_prob"))


@query("j24_cached_reuse", "SELECT event_id FROM events WHERE event_id % 4 <> 0")
def j24_cached_reuse(spark, d):
    e = B.table(spark, d, "events").select("event_id")
    return e.join(e.where("event_id % 4 = 0"), "event_id", "left_anti")


@query("j25_paired_labels", "SELECT event_type AS label, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS value, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS value_base FROM events GROUP BY 1")
def j25_paired_labels(spark, d):
    e = B.table(spark, d, "events").withColumn("label", F.when(F.col("event_id") % 2 == 1, F.concat("event_type", F.lit("_rnd"))).otherwise(F.col("event_type")))
    return J.paired_labels(e, "label", "value").select("label", F.round("value", 6).alias("value"), F.round("value_base", 6).alias("value_base"))


# Aggregates


@query("a1_mean_table", "SELECT event_type, greatest(count(*) FILTER (WHERE k % 2 = 0), count(*) FILTER (WHERE k % 2 = 1)) AS n, round(avg(value) FILTER (WHERE k % 2 = 0), 6) AS even, round(avg(value) FILTER (WHERE k % 2 = 1), 6) AS odd FROM " + _SQL_EVENTS + " GROUP BY 1 HAVING n >= 5")
def a1_mean_table(spark, d):
    e = _events(spark, d).withColumn("cell", F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))
    out = E.mean_table(e, "event_type", "cell", ["even", "odd"], "value", 5)
    return out.select("event_type", "n", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


@query("a2_best_label", f"WITH m AS (SELECT event_type, k, avg(value) AS mean, count(value) AS n FROM {_SQL_EVENTS} GROUP BY ALL) SELECT event_type, k AS best, round(mean, 6) AS mean, n FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, k) = 1")
def a2_best_label(spark, d):
    return E.best_label(_events(spark, d), "event_type", "k", "value").select("event_type", "best", F.round("mean", 6).alias("mean"), "n")


@query("a2_weighted_oracle", f"WITH m AS (SELECT event_type, k, avg(value) AS mean, count(value) AS n FROM {_SQL_EVENTS} GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, k) = 1) SELECT round(sum(mean * n) / sum(n), 6) AS oracle, CAST(sum(n) AS BIGINT) AS n FROM b")
def a2_weighted_oracle(spark, d):
    return E.weighted_oracle(E.best_label(_events(spark, d), "event_type", "k", "value")).select(F.round("oracle", 6).alias("oracle"), "n")


@query("a3_mode_means", "SELECT l_shipmode_like AS mode, count(*) AS n, round(avg(exact), 6) AS exact FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like, CAST(l_quantity > 25 AS INTEGER) AS exact FROM lineitem) GROUP BY 1")
def a3_mode_means(spark, d):
    l = B.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode"), (F.col("l_quantity") > 25).cast("int").alias("exact"))
    return l.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("exact"), 6).alias("exact"))


_Q = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS p{int(q * 100):02d}" for q in E.QUANTILES)


@query("a4_a6_distribution", f"SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, {_Q} FROM lineitem GROUP BY 1")
def a4_a6_distribution(spark, d):
    out = E.distribution(B.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


@query("a5_grouping_sets", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY GROUPING SETS ((), (lang), (source)) HAVING count(*) >= 5")
def a5_grouping_sets(spark, d):
    out = E.grouping_summary(B.documents(spark, d), [[], ["lang"], ["source"]], ["lang", "source"], [F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")], F.col("n") >= 5)
    return out.select("lang", "source", "n", "mean")


@query("a7_w11_histogram", """WITH b AS (SELECT CASE WHEN l_quantity BETWEEN 0 AND 20 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN l_quantity BETWEEN 21 AND 50 THEN '21-50' WHEN l_quantity > 50 THEN '51+' ELSE 'other' END AS bucket,
 CASE WHEN l_quantity BETWEEN 0 AND 20 THEN CAST(l_quantity AS INTEGER) WHEN l_quantity BETWEEN 21 AND 50 THEN 21 WHEN l_quantity > 50 THEN 22 ELSE 23 END AS o FROM lineitem), c AS (SELECT bucket, o, count(*) AS n FROM b GROUP BY ALL)
SELECT bucket, n, round(n / sum(n) OVER (), 8) AS share, round(sum(n) OVER (ORDER BY o) / sum(n) OVER (), 8) AS cumulative FROM c""")
def a7_w11_histogram(spark, d):
    return E.histogram(B.table(spark, d, "lineitem"), F.col("l_quantity")).select("bucket", "n", F.round("share", 8).alias("share"), F.round("cumulative", 8).alias("cumulative"))


@query("a8_a37_count_buckets", "SELECT CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 8 THEN '4-8' ELSE '9+' END AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM " + _SQL_EVENTS + " GROUP BY 1")
def a8_a37_count_buckets(spark, d):
    return _events(spark, d).groupBy(E.count_bucket(F.col("k")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("a9_type_ratios", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS ratio FROM events GROUP BY 1")
def a9_type_ratios(spark, d):
    counts = B.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8))


@query("a10_gate_yield", f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 150) AS high, count(*) FILTER (WHERE value <= 150 AND k < 3) AS small, count(*) FILTER (WHERE value <= 150 AND k >= 3) AS ok, round(avg(CAST(value <= 150 AND k >= 3 AS INTEGER)), 6) AS pass_rate FROM {_SQL_EVENTS} GROUP BY 1")
def a10_gate_yield(spark, d):
    reason = E.gate_reason([("high", F.col("value") > 150), ("small", F.col("k") < 3)])
    return E.gate_yield(_events(spark, d), ["event_type"], reason, ["high", "small", "ok"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("a11_gate_sweep", f"SELECT t, m, round(avg(CAST(value <= t AND k >= m AS INTEGER)), 6) AS pass_rate FROM {_SQL_EVENTS}, (VALUES (50.0), (100.0), (150.0)) a(t), (VALUES (2), (5)) b(m) GROUP BY t, m")
def a11_gate_sweep(spark, d):
    grid = J.grid(spark, t=[50.0, 100.0, 150.0], m=[2, 5])
    each = J.over_grid(_events(spark, d).select("value", "k"), grid)
    reason = E.gate_reason([("high", F.col("value") > F.col("t")), ("small", F.col("k") < F.col("m"))])
    return E.gate_yield(each, ["t", "m"], reason, []).select("t", F.col("m").cast("int").alias("m"), F.round("pass_rate", 6).alias("pass_rate"))


def _tagged(spark, d):
    """(gold, predicted): classes 0 to 2 from labels and lengths, -100 where unlabelled."""
    docs = B.documents(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    gold = F.when(F.col("quality").isNull(), -100).otherwise(F.col("quality") + F.col("toxic"))
    return docs.select("doc_id", gold.alias("gold"), (F.col("n_chars") % 3).cast("int").alias("predicted"))


_SQL_TAGGED = "(SELECT doc_id, CASE WHEN quality IS NULL THEN -100 ELSE quality + toxic END AS gold, CAST(n_chars % 3 AS INTEGER) AS predicted FROM documents LEFT JOIN labels USING (doc_id))"


@query("a12_confusion", f"SELECT gold, predicted, count(*) AS n FROM {_SQL_TAGGED} WHERE gold <> -100 GROUP BY ALL")
def a12_confusion(spark, d):
    return E.confusion(_tagged(spark, d), "gold", "predicted")


_SQL_SCORES = f"""(SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, tp, gp, pp FROM (SELECT class, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN gp > 0 THEN tp / gp ELSE 0 END AS r, tp, gp, pp FROM
(SELECT class, count(*) FILTER (WHERE gold = class AND predicted = class) AS tp, count(*) FILTER (WHERE predicted = class) AS pp, count(*) FILTER (WHERE gold = class) AS gp FROM {_SQL_TAGGED}, (VALUES (0), (1), (2), (3)) c(class) WHERE gold <> -100 GROUP BY class)))"""


@query("a13_class_scores", f"SELECT class, precision, recall, f1 FROM {_SQL_SCORES}")
def a13_class_scores(spark, d):
    out = E.class_scores(E.confusion(_tagged(spark, d), "gold", "predicted"), "gold", "predicted", [0, 1, 2, 3])
    return out.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("a13_a20_macro_f1", f"SELECT 'all' AS kind, round(avg(f1), 5) AS macro_f1 FROM {_SQL_SCORES} UNION ALL SELECT 'present', round(avg(f1), 5) FROM {_SQL_SCORES} WHERE class <> 0 AND (gp > 0 OR pp > 0)")
def a13_a20_macro_f1(spark, d):
    s = E.class_scores(E.confusion(_tagged(spark, d), "gold", "predicted"), "gold", "predicted", [0, 1, 2, 3]).withColumn("f1", F.round("f1", 6))
    row = lambda kind, out: out.select(F.lit(kind).alias("kind"), F.round("macro_f1", 5).alias("macro_f1"))
    return row("all", E.macro_f1(s)).union(row("present", E.macro_f1(s, skip_absent=True, skip_zero=True)))


@query("a15_majority_baseline", f"SELECT gold, 0 AS predicted, count(*) AS n FROM {_SQL_TAGGED} WHERE gold <> -100 GROUP BY gold")
def a15_majority_baseline(spark, d):
    return E.majority_confusion(E.confusion(_tagged(spark, d), "gold", "predicted"), "gold", "predicted").select("gold", "predicted", "n")


@query("a14_threshold_scores", f"SELECT t AS threshold, count(*) FILTER (WHERE value >= t AND k >= 5) AS tp, count(*) FILTER (WHERE value >= t AND k < 5) AS fp, count(*) FILTER (WHERE value < t AND k >= 5) AS fn FROM {_SQL_EVENTS}, (VALUES (20.0), (60.0), (120.0)) a(t) GROUP BY t")
def a14_threshold_scores(spark, d):
    e = _events(spark, d).withColumn("gold", F.col("k") >= 5)
    return E.threshold_scores(e, "value", "gold", [20.0, 60.0, 120.0]).select("threshold", "tp", "fp", "fn")


@query("a16_mean_iou", """WITH s AS (SELECT user_id, list_distinct(list(event_type) FILTER (WHERE event_id % 2 = 0)) AS a, list_distinct(list(event_type) FILTER (WHERE event_id % 2 = 1)) AS b FROM events GROUP BY 1)
SELECT count(*) AS n, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS iou FROM (SELECT coalesce(a, []) AS a, coalesce(b, []) AS b FROM s) WHERE len(list_concat(a, b)) > 0""")
def a16_mean_iou(spark, d):
    e = B.table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return s.where(F.size("a") + F.size("b") > 0).agg(F.count("*").alias("n"), F.round(F.avg(T.jaccard(F.col("a"), F.col("b"))), 6).alias("iou"))


@query("a17_family_metrics", "WITH f AS (SELECT p_size, list_distinct(string_split(p_type, ' ')) AS m FROM part), e AS (SELECT p_size, unnest(CASE WHEN len(m) > 1 THEN list_append(m, '(composed)') ELSE m END) AS family FROM f) SELECT family, count(*) AS n, round(avg(p_size), 6) AS mean FROM e GROUP BY 1")
def a17_family_metrics(spark, d):
    p = B.table(spark, d, "part").withColumn("members", F.array_distinct(F.split("p_type", " ")))
    return E.family_metrics(p, "members", [F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean")])


@query("a18_a19_top_k_curve", f"""WITH r AS (SELECT row, grp, list(f ORDER BY v DESC, f) AS ids, count(*) AS c FROM {B.SQL_ACTIVATIONS} GROUP BY ALL)
SELECT k, CASE WHEN c <= 8 THEN '<=8' WHEN c <= 16 THEN '9-16' ELSE '17+' END AS bucket, count(*) AS n, round(avg(CAST(list_contains(ids[1:k], CAST(row % 64 AS INTEGER)) AS INTEGER)), 6) AS hit FROM r, (VALUES (1), (5), (10)) t(k) GROUP BY 1, 2""")
def a18_a19_top_k_curve(spark, d):
    r = B.activations(spark, d).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("o"), "f"))), lambda x: x["f"]).alias("ids"))
    bucket = F.when(F.size("ids") <= 8, "<=8").when(F.size("ids") <= 16, "9-16").otherwise("17+")
    each = r.withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    hit = F.array_contains(F.slice("ids", F.lit(1), F.col("k")), (F.col("row") % 64).cast("int")).cast("int")
    return each.groupBy("k", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("hit"))


@query("a31_rates", f"SELECT sys, count(realized) AS n, round(avg(CAST(realized AS INTEGER)), 6) AS rate FROM {V} GROUP BY sys HAVING count(realized) > 0")
def a31_rates(spark, d):
    return E.rate(B.verdicts(spark, d), ["sys"], "realized").select("sys", "n", F.round("rate", 6).alias("rate"))


@query("a32_net_rates", f"""SELECT sys, round(avg(CAST(realized AS INTEGER)) FILTER (WHERE event_id % 2 = 0), 6) AS true_rate, round(avg(CAST(realized AS INTEGER)) FILTER (WHERE event_id % 2 = 1), 6) AS base_rate,
 round(avg(CAST(realized AS INTEGER)) FILTER (WHERE event_id % 2 = 0) - avg(CAST(realized AS INTEGER)) FILTER (WHERE event_id % 2 = 1), 6) AS net FROM {V} GROUP BY sys""")
def a32_net_rates(spark, d):
    v = B.verdicts(spark, d).withColumn("condition", F.when(F.col("event_id") % 2 == 0, "true").otherwise("random"))
    out = E.net_rate(E.rate(v, ["sys", "condition"], "realized"), ["sys"], "condition")
    return out.select("sys", *(F.round(c, 6).alias(c) for c in ("true_rate", "base_rate", "net")))


@query("a35_half_selected", """WITH x AS (SELECT l_returnflag AS grp, l_linenumber AS factor, l_orderkey % 100 AS input_id, l_extendedprice AS score FROM lineitem), g AS (SELECT grp, factor, avg(score) AS m FROM x WHERE input_id < 50 GROUP BY grp, factor), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY m DESC, factor) = 1)
SELECT f.grp, f.factor, round(any_value(m), 4) AS selected_on, round(avg(score), 4) AS held_out, count(*) AS n FROM f JOIN x ON x.grp = f.grp AND x.factor = f.factor WHERE input_id >= 50 GROUP BY ALL""")
def a35_half_selected(spark, d):
    x = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("factor"), (F.col("l_orderkey") % 100).alias("input_id"), F.lit(100).alias("size"), F.col("l_extendedprice").alias("score"))
    return E.half_selected(x, "grp", "factor", "input_id", "size", "score").select("grp", "factor", F.round("selected_on", 4).alias("selected_on"), F.round("held_out", 4).alias("held_out"), "n")


@query("a36_category_rollup", "SELECT r_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a36_category_rollup(spark, d):
    n = B.table(spark, d, "nation").join(F.broadcast(B.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = B.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def _sweep(spark, d):
    """(grp, key, k, exact, gain) over line numbers as k."""
    return B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("k"), (F.col("l_quantity") > 30).cast("int").alias("exact"), F.col("l_discount").alias("gain")).groupBy("key", "k").agg(F.first("grp").alias("grp0"), F.max("exact").alias("exact"), F.max("gain").alias("gain"), F.min("grp").alias("grp"))


_SQL_SWEEP = "(SELECT l_orderkey AS key, l_linenumber AS k, max(CAST(l_quantity > 30 AS INTEGER)) AS exact, max(l_discount) AS gain, min(l_returnflag) AS grp FROM lineitem GROUP BY ALL)"


@query("a38_saturation", f"WITH m AS (SELECT grp, k, avg(exact) AS m FROM {_SQL_SWEEP} GROUP BY ALL), t AS (SELECT grp, arg_max(m, k) AS top FROM m GROUP BY grp) SELECT grp, min(k) FILTER (WHERE m >= 0.95 * top) AS r95 FROM m JOIN t USING (grp) GROUP BY grp")
def a38_saturation(spark, d):
    return E.saturation(_sweep(spark, d), ["grp"], "k", "exact")


@query("a39_minimal_k", f"SELECT coalesce(CAST(least AS VARCHAR), 'never') AS k, count(*) AS n FROM (SELECT key, min(k) FILTER (WHERE exact > 0) AS least FROM {_SQL_SWEEP} GROUP BY key) GROUP BY 1")
def a39_minimal_k(spark, d):
    return E.minimal_k(_sweep(spark, d), "key", "k", "exact")


@query("a40_threshold_choice", f"""WITH e AS (SELECT * FROM {_SQL_SWEEP}, (VALUES (0.02), (0.05), (0.08)) t(tau)), c AS (SELECT tau, key, coalesce(min(k) FILTER (WHERE gain >= tau), max(k)) AS k FROM e GROUP BY tau, key)
SELECT tau, round(avg(exact), 6) AS exact, round(avg(e.k), 6) AS mean_k FROM e JOIN c USING (tau, key, k) GROUP BY tau""")
def a40_threshold_choice(spark, d):
    return E.threshold_choice(_sweep(spark, d), "key", "k", "gain", ["exact"], [0.02, 0.05, 0.08]).select("tau", F.round("exact", 6).alias("exact"), F.round("mean_k", 6).alias("mean_k"))


@query("a41_oracle_systems", f"SELECT idx, sys, round(gain, 6) AS gain FROM {_SQL_SYSTEMS} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY exact DESC, gain DESC, sys) = 1")
def a41_oracle_systems(spark, d):
    return E.oracle_rows(_systems(spark, d), "idx", ["exact", "gain"], "sys").select("idx", "sys", F.round("gain", 6).alias("gain"))


@query("a42_k9_router", f"""WITH x AS (SELECT user_id, avg(value) FILTER (WHERE event_id % 2 = 0) AS few, avg(value) FILTER (WHERE event_id % 2 = 1) AS many, count(*) AS n FROM events GROUP BY 1 HAVING few IS NOT NULL AND many IS NOT NULL)
SELECT t AS threshold, user_id % 2 = 0 AS tune, round(avg(CASE WHEN n % 4 <= t THEN few ELSE many END), 6) AS routed FROM x, (VALUES (0), (1), (2), (3)) a(t) GROUP BY 1, 2""")
def a42_k9_router(spark, d):
    e = B.table(spark, d, "events").withColumn("condition", F.when(F.col("event_id") % 2 == 0, "true").otherwise("random"))
    x = e.groupBy("user_id").agg(F.avg(F.when(F.col("condition") == "true", F.col("value"))).alias("few"), F.avg(F.when(F.col("condition") == "random", F.col("value"))).alias("many"), (F.count("*") % 4).alias("n")).dropna(subset=["few", "many"])
    each = [x.select(F.lit(t).alias("threshold"), (F.col("user_id") % 2 == 0).alias("tune"), E.route_by_count(x, "n", t, "few", "many").alias("r")) for t in range(4)]
    whole = each[0].union(each[1]).union(each[2]).union(each[3])
    return whole.groupBy("threshold", "tune").agg(F.round(F.avg("r"), 6).alias("routed"))


@query("a43_perplexity", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 8) AS perplexity FROM lineitem GROUP BY 1")
def a43_perplexity(spark, d):
    return E.perplexity(B.table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity").select("l_returnflag", F.round("loss", 8).alias("loss"), F.round("perplexity", 8).alias("perplexity"))


@query("a44_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, round(median(value), 6) AS median FROM events GROUP BY 1")
def a44_moments(spark, d):
    out = E.moments(B.table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high", "median")))


@query("a47_information", "WITH p AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type), g AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS q FROM events GROUP BY event_type) SELECT user_id, round(sum(p * (ln(p) - ln(q))), 6) AS kl FROM p JOIN g USING (event_type) GROUP BY 1")
def a47_information(spark, d):
    e = B.table(spark, d, "events")
    p = e.groupBy("user_id", "event_type").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("user_id")))
    g = e.groupBy("event_type").agg(F.count("*").alias("c2"))
    q = g.withColumn("q", F.col("c2") / F.sum("c2").over(Window.partitionBy()))
    joined = p.join(F.broadcast(q), "event_type").select("user_id", "p", F.log("q").alias("la"), F.log("p").alias("lb"))
    return E.information_gain(joined, ["user_id"], "p", "la", "lb").select("user_id", F.round("kl", 6).alias("kl"))


@query("a48_key_metrics", "SELECT event_type, round(avg(CAST(k % 3 = 0 AS INTEGER)), 6) AS output_rate, round(avg(CAST(k % 3 = 1 AS INTEGER)), 6) AS p_absent FROM " + _SQL_EVENTS + " GROUP BY 1")
def a48_key_metrics(spark, d):
    key = F.concat_ws("|", "event_type", F.when(F.col("k") % 3 == 0, "out").when(F.col("k") % 3 == 1, "none").otherwise("src"))
    rows = _events(spark, d).select(F.split(key, r"\|").alias("p"))
    share = lambda v: F.round(F.avg((F.col("p")[1] == v).cast("int")), 6)
    return rows.groupBy(F.col("p")[0].alias("event_type")).agg(share("out").alias("output_rate"), share("none").alias("p_absent"))


@query("a49_agreement", f"""WITH j AS (SELECT user_id, max(realized) FILTER (WHERE event_id % 2 = 0) AS a, max(realized) FILTER (WHERE event_id % 2 = 1) AS b FROM (SELECT idx AS user_id, event_id, CAST(realized AS INTEGER) AS realized FROM {V}) GROUP BY 1)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n, round(avg(CAST(a = b AS INTEGER)), 6) AS decided, round(avg(CAST(a IS NOT DISTINCT FROM b AS INTEGER)), 6) AS raw FROM j""")
def a49_agreement(spark, d):
    v = B.verdicts(spark, d).withColumn("r", F.col("realized").cast("int"))
    j = v.groupBy("idx").agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("event_id") % 2 == 1, F.col("r"))).alias("b"))
    both = (F.col("a") == F.col("b")).cast("int")
    return j.agg(F.count(both).alias("n"), F.round(F.avg(both), 6).alias("decided"), F.round(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")), 6).alias("raw"))


@query("a54_u6_pseudo_systems", f"SELECT sys, count(*) AS n, round(avg(gain), 6) AS gain FROM (SELECT idx, sys, gain FROM {_SQL_SYSTEMS} UNION ALL SELECT idx, 'copy', min(gain) FROM {_SQL_SYSTEMS} GROUP BY idx UNION ALL SELECT idx, 'oracle', max(gain) FROM {_SQL_SYSTEMS} GROUP BY idx) GROUP BY sys")
def a54_u6_pseudo_systems(spark, d):
    s = _systems(spark, d).select("idx", "sys", "gain")
    extra = lambda name, agg: s.groupBy("idx").agg(agg("gain").alias("gain")).select("idx", F.lit(name).alias("sys"), "gain")
    whole = s.unionByName(extra("copy", F.min)).unionByName(extra("oracle", F.max))
    return whole.groupBy("sys").agg(F.count("*").alias("n"), F.round(F.avg("gain"), 6).alias("gain"))


@query("a55_a56_condition_table", "SELECT l_returnflag AS condition, l_linestatus AS mode, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1, 2")
def a55_a56_condition_table(spark, d):
    l = B.table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "condition", "l_linestatus": "mode"})
    out = E.condition_table(l, "condition", "mode", ["l_quantity", "l_discount"])
    return out.select("condition", "mode", "n", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query("a57_two_weightings", "WITH p AS (SELECT o_orderpriority AS grp, l_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS hits, count(*) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT grp, round(sum(hits) / sum(total), 6) AS token_weighted, round(avg(hits / total), 6) AS pair_weighted FROM p GROUP BY 1")
def a57_two_weightings(spark, d):
    l = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = l.groupBy(F.col("o_orderpriority").alias("grp"), "l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("hits"), F.count("*").alias("total"))
    return E.token_and_pair_means(p, ["grp"], "hits", "total").select("grp", F.round("token_weighted", 6).alias("token_weighted"), F.round("pair_weighted", 6).alias("pair_weighted"))


@query("a26_worker_merge", "SELECT sum(n) AS samples, max(seen) AS seen FROM (SELECT doc_id % 4 AS w, count(*) AS n, max(doc_id) AS seen FROM documents GROUP BY 1)")
def a26_worker_merge(spark, d):
    parts = B.documents(spark, d).groupBy((F.col("doc_id") % 4).alias("w")).agg(F.count("*").alias("n"), F.max("doc_id").alias("seen"))
    return parts.agg(F.sum("n").alias("samples"), F.max("seen").alias("seen"))


def _sql_overlap(out: str, ref: str, most: int) -> str:
    """(grp, n, hit, outs, refs) of the n-grams of two list columns."""
    grams = lambda c: f"SELECT grp, conv_id, turn, n, w[i:i + n - 1] AS g, count(*) AS c FROM (SELECT grp, conv_id, turn, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT conv_id % 5 AS grp, conv_id, turn, {c} AS w FROM {B.SQL_TURNS}), (SELECT unnest(range(1, {most + 1})) AS n) WHERE len(w) >= n) GROUP BY ALL"
    return f"""o AS ({grams(out)}), r AS ({grams(ref)}), k AS (SELECT DISTINCT grp, n FROM (SELECT conv_id % 5 AS grp FROM {B.SQL_TURNS}), (SELECT unnest(range(1, {most + 1})) AS n)),
z AS (SELECT k.grp, k.n, coalesce(hit, 0) AS hit, coalesce(outs, 0) AS outs, coalesce(refs, 0) AS refs FROM k LEFT JOIN (SELECT o.grp, o.n, sum(least(o.c, r.c)) AS hit FROM o JOIN r USING (conv_id, turn, n, g) GROUP BY ALL) USING (grp, n)
LEFT JOIN (SELECT grp, n, sum(c) AS outs FROM o GROUP BY ALL) USING (grp, n) LEFT JOIN (SELECT grp, n, sum(c) AS refs FROM r GROUP BY ALL) USING (grp, n))"""


@query("a51_corpus_bleu", f"""WITH {_sql_overlap('src', 'tgt', 4)}, l AS (SELECT grp, CAST(max(outs) FILTER (WHERE n = 1) AS BIGINT) AS out_len, CAST(max(refs) FILTER (WHERE n = 1) AS BIGINT) AS ref_len, min(hit) AS least, avg(CASE WHEN hit > 0 THEN ln(hit / outs) END) AS log_p FROM z GROUP BY grp)
SELECT grp, out_len, ref_len, round(CASE WHEN least > 0 THEN 100 * exp(log_p) * CASE WHEN out_len >= ref_len THEN 1 ELSE exp(1 - ref_len / out_len) END ELSE 0 END, 6) AS bleu FROM l""")
def a51_corpus_bleu(spark, d):
    found = E.bleu_statistics(B.turn_pairs(spark, d).withColumn("grp", F.col("conv_id") % 5), ["grp"], "src", "tgt")
    return found.select("grp", "out_len", "ref_len", F.round("bleu", 6).alias("bleu"))


_SQL_CHARS = "list_filter(string_split(regexp_replace({0}, '\\s', '', 'g'), ''), lambda x: x <> '')"


@query("a51_corpus_chrf", f"""WITH {_sql_overlap(_SQL_CHARS.format('source_text'), _SQL_CHARS.format('target_text'), 6)}, m AS (SELECT grp, avg(hit / outs) AS p, avg(hit / refs) AS r FROM z WHERE outs > 0 AND refs > 0 GROUP BY grp)
SELECT grp, round(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM m""")
def a51_corpus_chrf(spark, d):
    found = E.chrf_statistics(B.turn_pairs(spark, d).withColumn("grp", F.col("conv_id") % 5), ["grp"], "source_text", "target_text")
    return found.select("grp", F.round("chrf", 6).alias("chrf"))


# Tests


_SQL_DISCORDANT = f"(SELECT x.sys AS sys_a, y.sys AS sys_b, count(*) AS n, count(*) FILTER (WHERE x.r AND NOT y.r) AS b, count(*) FILTER (WHERE NOT x.r AND y.r) AS c FROM (SELECT idx, sys, bool_or(realized) AS r FROM {V} GROUP BY ALL) x JOIN (SELECT idx, sys, bool_or(realized) AS r FROM {V} GROUP BY ALL) y USING (idx) WHERE x.sys < y.sys AND x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY ALL)"


@query("st1_mcnemar", f"""SELECT sys_a, sys_b, n, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(CAST(b + c + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(b + c - i + 1 AS DOUBLE)) - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS i))) END, 6) AS p FROM {_SQL_DISCORDANT}""")
def st1_mcnemar(spark, d):
    per = B.verdicts(spark, d).groupBy("idx", "sys").agg(F.bool_or("realized").alias("r"))
    pairs = J.system_pairs(per, "idx", "sys", "r")
    return E.mcnemar(pairs, ["sys_a", "sys_b"], "value_a", "value_b").select("sys_a", "sys_b", "n", "b", "c", F.round("p", 6).alias("p"))


@query("st2_sign_test", """WITH c AS (SELECT event_type, user_id % 40 AS part, count(*) FILTER (WHERE value > 40) AS up, count(*) FILTER (WHERE value < 40) AS down FROM events GROUP BY ALL),
k AS (SELECT event_type, part, up, down, unnest(range(0, least(up, down) + 1)) AS i FROM c)
SELECT event_type, part, up, down, round(least(1.0, 2 * sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))), 6) AS p FROM k GROUP BY ALL""")
def st2_sign_test(spark, d):
    e = B.table(spark, d, "events").select("event_type", (F.col("user_id") % 40).alias("part"), (F.col("value") - 40).alias("delta"))
    return E.sign_test(e, ["event_type", "part"], "delta").select("event_type", "part", "up", "down", F.round("p", 6).alias("p"))


@query("st3_wilson", f"""SELECT sys, k, n, round(greatest(0, (p + z / (2 * n)) / (1 + z / n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n)) / (1 + z / n)), 6) AS low, round(least(1, (p + z / (2 * n)) / (1 + z / n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n)) / (1 + z / n)), 6) AS high
FROM (SELECT sys, count(*) FILTER (WHERE realized) AS k, count(realized) AS n, 1.96 * 1.96 AS z, count(*) FILTER (WHERE realized) / count(realized) AS p FROM {V} GROUP BY sys)""")
def st3_wilson(spark, d):
    c = B.verdicts(spark, d).groupBy("sys").agg(F.count_if("realized").alias("k"), F.count("realized").alias("n"))
    w = c.withColumn("w", E.wilson(F.col("k"), F.col("n")))
    return w.select("sys", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("st4_paired_difference", """WITH x AS (SELECT user_id, event_type, avg(value) FILTER (WHERE event_id % 2 = 0) AS a, avg(value) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT event_type, count(a - b) AS n, round(avg(a - b), 5) AS mean, round(avg(a - b) - 1.96 * stddev_samp(a - b) / sqrt(count(a - b)), 5) AS low, round(avg(a - b) + 1.96 * stddev_samp(a - b) / sqrt(count(a - b)), 5) AS high, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses FROM x GROUP BY 1""")
def st4_paired_difference(spark, d):
    half = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    x = B.table(spark, d, "events").groupBy("user_id", "event_type").agg(half(0).alias("a"), half(1).alias("b"))
    out = E.paired_difference(x, ["event_type"], "a", "b")
    return out.select("event_type", "n", *(F.round(c, 5).alias(c) for c in ("mean", "low", "high")), "wins", "losses")


@query("st6_spearman", """WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY doc_id % 97) + (count(*) OVER (PARTITION BY lang, doc_id % 97) - 1) / 2.0 AS b FROM documents)
SELECT lang, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY lang""")
def st6_spearman(spark, d):
    docs = B.documents(spark, d).withColumn("other", F.col("doc_id") % 97)
    return E.spearman(docs, ["lang"], "n_chars", "other").withColumn("rho", F.round("rho", 6))


@query("st8_w10_trend", """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), s AS (SELECT event_type, avg(value) FILTER (WHERE i * 3 // n = 0) AS early, avg(value) FILTER (WHERE i * 3 // n = 2) AS late FROM p GROUP BY 1)
SELECT event_type, round((early - late) / early, 6) AS change, CASE WHEN (early - late) / early >= 0.4 THEN 'improving' WHEN (early - late) / early >= 0.15 THEN 'slowing' ELSE 'flat' END AS verdict FROM s""")
def st8_w10_trend(spark, d):
    return E.trend_verdict(B.table(spark, d, "events"), "event_type", "event_id", "value").select("event_type", F.round("change", 6).alias("change"), "verdict")


@query("st9_control_verdict", f"""WITH m AS (SELECT event_type, avg(value / 100) FILTER (WHERE k % 3 = 0) AS t, avg(value / 100) FILTER (WHERE k % 3 = 1) AS e, avg(value / 100) FILTER (WHERE k % 3 = 2) AS r FROM {_SQL_EVENTS} GROUP BY 1)
SELECT event_type, CASE WHEN t - greatest(e, r) >= 0.05 THEN 'USED' WHEN t - greatest(e, r) >= 0.01 THEN 'WEAK' ELSE 'IGNORED' END AS verdict FROM m""")
def st9_control_verdict(spark, d):
    part = lambda r: F.avg(F.when(F.col("k") % 3 == r, F.col("value") / 100))
    m = _events(spark, d).groupBy("event_type").agg(part(0).alias("t"), part(1).alias("e"), part(2).alias("r"))
    return m.select("event_type", E.control_verdict(F.col("t"), F.col("e"), F.col("r")).alias("verdict"))


# Windows and set operations


@query("w1_average_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r FROM part")
def w1_average_rank(spark, d):
    return B.table(spark, d, "part").select("p_partkey", E.average_rank(["p_brand"], "p_size").alias("r"))


@query("w3_top_magnitude", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - 4000) DESC, c_custkey) <= 3")
def w3_top_magnitude(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc(F.abs(F.col("c_acctbal") - 4000)), "c_custkey")
    return B.table(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_mktsegment", "c_custkey")


@query("w4_parity_split", "SELECT lang, half, count(*) AS n FROM (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 AS half FROM documents) GROUP BY ALL")
def w4_parity_split(spark, d):
    half = F.pmod(F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1, F.lit(2)).cast("long")
    return B.documents(spark, d).select("lang", half.alias("half")).groupBy("lang", "half").agg(F.count("*").alias("n"))


@query("w5_e4_islands", """WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, g AS island, count(*) AS length FROM x GROUP BY ALL""")
def w5_e4_islands(spark, d):
    u = Window.partitionBy("user_id").orderBy("event_id")
    t = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    x = B.table(spark, d, "events").withColumn("island", F.row_number().over(u) - F.row_number().over(t))
    return x.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("length"))


@query("w6_w8_neighbours", """SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_id,
 CAST(sum(CAST(value > 50 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS place, coalesce(CAST(lag(value) OVER w > 50 AS INTEGER), 0) + coalesce(CAST(lead(value) OVER w > 50 AS INTEGER), 0) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def w6_w8_neighbours(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("value") > 50
    near = lambda c: F.coalesce((c > 50).cast("int"), F.lit(0))
    return B.table(spark, d, "events").select("event_id", F.last(F.when(hit, F.col("event_id")), ignorenulls=True).over(before).alias("left_id"), (F.sum(hit.cast("int")).over(upto) - 1).alias("place"), (near(F.lag("value").over(w)) + near(F.lead("value").over(w))).alias("near"))


@query("w9_changes", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type AS first_piece FROM events")
def w9_changes(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return B.table(spark, d, "events").select("event_id", (~before.eqNullSafe(F.col("event_type"))).alias("first_piece"))


@query("w12_first_accepted", f"SELECT user_id, min(event_id) FILTER (WHERE k >= 7) AS first_ok FROM {_SQL_EVENTS} GROUP BY 1 HAVING first_ok IS NOT NULL")
def w12_first_accepted(spark, d):
    from pairloom.operators.generation import first_accepted

    rows = _events(spark, d).select("user_id", F.col("event_id").alias("attempt"), (F.col("k") >= 7).alias("ok"))
    return first_accepted(rows, "user_id", "ok").select("user_id", F.col("attempt").alias("first_ok"))


@query("w14_group_order", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def w14_group_order(spark, d):
    counts = B.documents(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long"))


@query("u1_u3_id_sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT page_id FROM pages) UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT page_id FROM pages)")
def u1_u3_id_sets(spark, d):
    docs, pages, items = B.documents(spark, d).select("doc_id"), B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count("both", docs.intersect(pages)).union(count("any", docs.union(items).distinct())).union(count("only", docs.exceptAll(pages)))


@query("u4_e33_array_sets", f"SELECT conv_id, turn, len(list_intersect(src, tgt)) AS both, len(list_distinct(list_concat(src, tgt))) AS any, len(list_distinct(list_concat(src, tgt))) - len(list_intersect(src, tgt)) AS one FROM {B.SQL_TURNS}")
def u4_e33_array_sets(spark, d):
    t = B.turn_pairs(spark, d)
    size = lambda c, n: F.size(c).cast("long").alias(n)
    return t.select("conv_id", "turn", size(F.array_intersect("src", "tgt"), "both"), size(F.array_union("src", "tgt"), "any"), T.symmetric_difference_size(F.col("src"), F.col("tgt")).cast("long").alias("one"))


@query("u5_shard_union", "SELECT count(*) AS n, sum(n_chars) AS chars FROM documents")
def u5_shard_union(spark, d):
    docs = B.documents(spark, d)
    return docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1").drop("source"), allowMissingColumns=True).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("m6_last_write_wins", "SELECT user_id || '|' || event_type AS key, max_by(value, event_id) AS rel FROM events GROUP BY 1")
def m6_last_write_wins(spark, d):
    e = B.table(spark, d, "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return e.groupBy("key").agg(F.max_by("value", "event_id").alias("rel"))


@query("m7_call_budget", "SELECT event_id FROM events ORDER BY event_id LIMIT 40")
def m7_call_budget(spark, d):
    from pairloom.streaming.streams import call_budget

    return call_budget(B.table(spark, d, "events").select("event_id"), 40, "event_id")


@query("m4_epochs", "SELECT epoch, count(*) AS n FROM documents, (VALUES (0), (1), (2)) t(epoch) GROUP BY 1")
def m4_epochs(spark, d):
    from pairloom.streaming.streams import epochs

    return epochs(B.documents(spark, d), "source", 3).groupBy("epoch").agg(F.count("*").alias("n"))


@query("case_classification", f"""WITH m AS (SELECT event_type, avg(value) - 60 AS steer, count(*) FILTER (WHERE k > 7) - count(*) FILTER (WHERE k < 2) AS delta, count(*) FILTER (WHERE k = 9) AS b2 FROM {_SQL_EVENTS} GROUP BY 1)
SELECT event_type, CASE WHEN steer > 0 THEN 'A' WHEN delta > 0 THEN 'C' WHEN b2 > 0 THEN 'B' ELSE 'D' END AS class FROM m""")
def case_classification(spark, d):
    m = _events(spark, d).groupBy("event_type").agg((F.avg("value") - 60).alias("steer"), (F.count_if(F.col("k") > 7) - F.count_if(F.col("k") < 2)).alias("delta"), F.count_if(F.col("k") == 9).alias("b2"))
    return m.select("event_type", F.when(F.col("steer") > 0, "A").when(F.col("delta") > 0, "C").when(F.col("b2") > 0, "B").otherwise("D").alias("class"))
