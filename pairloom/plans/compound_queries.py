"""Queries: compound edits, editor arrays, specifications and decoding rules."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairloom.functions import specs as P
from pairloom.functions.hashing import sql_uniform, uniform
from pairloom.operators import alignment as A
from pairloom.operators import compound as C
from pairloom.operators import decoding as D
from pairloom.operators import features as X

from . import alignment_sql as Q
from . import base as B
from .registry import query


def _plain(spark, d):
    """Sentences of at least ten words with single spaces, and three operations on each."""
    s = B.sentences(spark, d).select("doc_id", "pos", F.col("sentence").alias("text"))
    # ten words need nine spaces: most sentences are left out before their words are looked for
    s = s.where((F.regexp_count("text", F.lit(r"(?U)[\s\x1c-\x1f]")) >= 9) & ~F.col("text").rlike(r"\s\s|[^\S ]"))
    s = s.withColumn("words", A.words_with_offsets(F.col("text"))).where(F.size("words") >= 10)
    op = lambda kind, ws, we, payload: F.struct(F.lit(kind).alias("op"), F.lit(ws).alias("ws"), F.lit(we).alias("we"), F.lit(payload).cast("string").alias("payload"))
    ops = F.array(op("repl", 1, 2, "blue"), op("repl", 1, 2, "red"), op("ins", 3, 5, None), op("del", 5, 5, "near"), op("del", 7, 7, "very"))
    return s.withColumn("ops", C.compatible(ops)).withColumn("made", C.apply_compound(F.col("text"), F.col("words"), F.col("ops")))


_SQL_PLAIN = f"(SELECT doc_id, pos, sentence AS text, string_split(sentence, ' ') AS w FROM {B.SQL_SENTENCES} WHERE NOT regexp_matches(sentence, '\\s\\s|[\\t\\r\\v\\f]') AND len(string_split(sentence, ' ')) >= 10)"
_SQL_EDITED = "array_to_string(list_concat([w[1], 'blue', w[3]], w[6:7], ['very'], w[8:]), ' ')"


@query("e25_e26_compound_edits", f"SELECT doc_id, pos, 3 AS n_ops, {_SQL_EDITED} AS edited FROM {_SQL_PLAIN}")
def e25_e26_compound_edits(spark, d):
    return _plain(spark, d).select("doc_id", "pos", F.size("ops").cast("long").alias("n_ops"), F.col("made.text").alias("edited"))


@query("e28_partial_reversal", f"SELECT doc_id, pos, array_to_string(list_concat(w[1:3], w[6:7], ['very'], w[8:]), ' ') AS half, {_SQL_EDITED} AS whole FROM {_SQL_PLAIN}")
def e28_partial_reversal(spark, d):
    r = _plain(spark, d).withColumn("r", C.rebase(F.col("text"), F.col("words"), F.col("ops"), F.array(F.lit(0))))
    return r.select("doc_id", "pos", F.col("r.text").alias("half"), A.splice(F.col("r.text"), F.col("r.edits")).alias("whole"))


def _ranged(spark, d):
    p = _plain(spark, d).withColumn("xp_words", A.words_with_offsets(F.col("made.text")))
    return p.withColumn("ranges", C.token_ranges(F.col("words"), F.col("ops"), F.col("made.places"), F.col("words"), F.col("xp_words")))


@query("e24_t7_token_ranges", f"SELECT doc_id, pos, [[1, 1, NULL], [3, NULL, 3], [NULL, 5, NULL]] AS ranges, 3 AS x_ranges, 3 AS xp_ranges FROM {_SQL_PLAIN}")
def e24_t7_token_ranges(spark, d):
    r = _ranged(spark, d)
    sides = C.edited_ranges(F.col("text"), F.col("words"), F.col("ops"), F.col("made.places"))
    return r.select("doc_id", "pos", F.transform("ranges", lambda t: F.array(t["xs"], t["ps"], t["gap"])).alias("ranges"), F.size(sides["x"]).cast("long").alias("x_ranges"), F.size(sides["xp"]).cast("long").alias("xp_ranges"))


@query("e23_t12_training_arrays", f"SELECT doc_id, pos, 3 AS edits, len(w) + 1 AS n_template, 2 * len(w) + 1 - 1 + 1 - 1 AS n_input FROM {_SQL_PLAIN}")
def e23_t12_training_arrays(spark, d):
    ids = lambda c: F.transform(c, lambda w: F.crc32(w["w"].cast("binary")))
    r = _ranged(spark, d).withColumns({"x_ids": ids(F.col("words")), "xp_ids": ids(F.col("xp_words"))})
    r = r.withColumn("g", C.compound_gold(F.col("ranges"), F.col("x_ids"), F.col("xp_ids"), -1, -2, -3))
    pair = C.editor_pair(F.col("xp_ids"), F.col("g.input"), F.col("g.target"), -4, -3, -5)
    return r.select("doc_id", "pos", F.size(F.filter("g.tags", lambda t: t != 0)).cast("long").alias("edits"), F.size("g.input").cast("long").alias("n_template"), F.size(pair["input"]).cast("long").alias("n_input"))


@query("t6_opcode_ranges", Q.over(Q.WORDS, "SELECT {k}, CAST(count(*) FILTER (WHERE tag IN ('replace', 'delete')) AS INTEGER) AS x_ranges, CAST(count(*) FILTER (WHERE tag IN ('replace', 'insert')) AS INTEGER) AS xp_ranges FROM p LEFT JOIN ops USING ({k}) GROUP BY {k}"))
def t6_opcode_ranges(spark, d):
    t = B.turn_pairs(spark, d).withColumns({"a": A.words_with_offsets(F.col("source_text")), "b": A.words_with_offsets(F.col("target_text"))})
    word = lambda c: F.transform(c, lambda w: w["w"])
    t = t.withColumn("ops", A.opcodes(word("a"), word("b")))
    r = C.opcode_ranges(F.col("ops"), F.col("a"), F.col("b"))
    return t.select("conv_id", "turn", F.size(r["x"]).alias("x_ranges"), F.size(r["xp"]).alias("xp_ranges"))


@query("t10_firing_mask", f"SELECT row, count(*) FILTER (WHERE f IN (3, 5)) AS fires FROM {B.SQL_ACTIVATIONS} GROUP BY row HAVING fires > 0")
def t10_firing_mask(spark, d):
    """Each entry of a vector as a token of its own."""
    rows = B.activations(spark, d).groupBy("row").agg(F.collect_list(F.create_map("f", "v")).alias("tokens"))
    m = rows.withColumn("m", C.firing_mask(F.col("tokens"), F.array(F.lit(3), F.lit(5)))).where("m is not null")
    return m.select("row", F.size(F.filter("m", lambda x: x)).cast("long").alias("fires"))


@query("v9_named_features", "SELECT 'amp' AS side, f, round(mu * 2, 6) AS v FROM (SELECT f, sum(v) / (SELECT count(*) FROM embeddings) AS mu FROM " + B.SQL_ACTIVATIONS + " GROUP BY f) WHERE f IN (1, 2) UNION ALL SELECT 'sup', f, round(mu * 2, 6) FROM (SELECT f, sum(v) / (SELECT count(*) FROM embeddings) AS mu FROM " + B.SQL_ACTIVATIONS + " GROUP BY f) WHERE f = 7")
def v9_named_features(spark, d):
    n = B.table(spark, d, "embeddings").count()
    mu = X.mean_activation(B.activations(spark, d), n).agg(F.map_from_entries(F.collect_list(F.struct("f", "mu"))).alias("mu"))
    maps = mu.select(P.intervention_maps(P.FeatureSpec.parse_list("+1,-7,+2"), F.col("mu"), 2.0).alias("m"))
    side = lambda s: maps.select(F.lit(s).alias("side"), F.explode(f"m.{s}").alias("f", "v")).select("side", "f", F.round("v", 6).alias("v"))
    return side("amp").union(side("sup"))


@query("v21_count_draws", f"SELECT doc_id, CAST(least(floor({sql_uniform('doc_id', 3)} * 4) + 1, 4) AS INTEGER) AS k, CAST(least(floor(exp(ln(1.0) + {sql_uniform('doc_id', 3)} * (ln(33.0) - ln(1.0)))), 32) AS INTEGER) AS k_log, 4 AS fixed FROM documents")
def v21_count_draws(spark, d):
    u = uniform(F.col("doc_id"), 3)
    return B.documents(spark, d).select("doc_id", P.CountSpec.parse("1-4").draw(u).cast("int").alias("k"), P.CountSpec.parse("log:1-32").draw(u).alias("k_log"), P.CountSpec.parse("4").draw(u).alias("fixed"))


@query("k4_plan_thresholds", "SELECT user_id, count(*) AS plans FROM (SELECT DISTINCT user_id, ops FROM (SELECT user_id, day, list(event_type ORDER BY pos, event_type) AS ops FROM (SELECT user_id, event_id % 3 AS day, event_id % 5 AS pos, event_type FROM events WHERE value >= 60 AND event_id % 5 > 0) GROUP BY user_id, day)) GROUP BY user_id")
def k4_plan_thresholds(spark, d):
    e = B.table(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("plan"), (F.col("event_id") % 5).alias("pos"), F.col("event_type").alias("op"), F.col("value").alias("prob"))
    plans = D.kept_plans(e, "user_id", 60.0).select("user_id", F.transform("ops", lambda o: o["op"]).alias("ops")).distinct()
    return plans.groupBy("user_id").agg(F.count("*").alias("plans"))


@query("k5_alternatives", "WITH a AS (SELECT * FROM (SELECT user_id, event_id % 5 AS pos, event_id AS tok, value AS score FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY score DESC, tok) <= 2) SELECT user_id, pos, tok FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, user_id, pos, tok) <= 6")
def k5_alternatives(spark, d):
    c = B.table(spark, d, "events").select("user_id", (F.col("event_id") % 5).alias("pos"), F.col("event_id").alias("tok"), F.col("value").alias("score"))
    return D.alternatives(c, ["user_id", "pos"], 2, 6, "user_id").select("user_id", "pos", "tok")


@query("k7_remasking", "SELECT user_id, count(*) FILTER (WHERE r <= floor(n * cos(pi() / 2 * 2 / 4))) AS masked FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id")
def k7_remasking(spark, d):
    e = D.remask(B.table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 1, 4)
    return e.groupBy("user_id").agg(F.count_if("masked").alias("masked"))


@query("k8_chosen_operations", """WITH s AS (SELECT * FROM (SELECT user_id, event_id % 11 AS pos, event_type AS kind, value / 100 AS rate FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY rate DESC, kind) = 1),
q AS (SELECT *, sum(rate * 0.5) OVER (PARTITION BY user_id) AS mass, row_number() OVER (PARTITION BY user_id ORDER BY rate DESC, pos) AS k FROM s)
SELECT user_id, pos FROM q WHERE k <= CASE WHEN mass >= 1 THEN floor(mass) WHEN mass > 0.1 THEN 1 ELSE 0 END""")
def k8_chosen_operations(spark, d):
    r = B.table(spark, d, "events").select("user_id", (F.col("event_id") % 11).alias("pos"), F.col("event_type").alias("kind"), (F.col("value") / 100).alias("rate"))
    return D.choose_operations(r, "user_id", step=0.5).select("user_id", "pos")


@query("h2_row_seeds", "SELECT doc_id, 7 * 1000003 + doc_id AS a, 7 * 1000003 + doc_id + 500000 AS b FROM documents")
def h2_row_seeds(spark, d):
    from pairloom.functions.hashing import row_seed

    return B.documents(spark, d).select("doc_id", row_seed(F.col("doc_id"), 7).alias("a"), row_seed(F.col("doc_id"), 7, 500000).alias("b"))


def _sql_poisson(u: str, rate: float = 0.5, most: int = 12) -> str:
    edges, edge = [], 0.0
    for k in range(most):
        edge += math.exp(-rate) * rate**k / math.factorial(k)
        edges.append(f"WHEN {u} < {edge!r} THEN {k}")
    return f"CASE {' '.join(edges)} ELSE {most} END"


_SLOT_KEY = "(conv_id * 65536 + turn * 1024 + slot)"


@query("e11_h4_local_firing", f"""WITH c AS (SELECT *, {sql_uniform(_SLOT_KEY, 31)} < 0.3 AS own, {_sql_poisson(sql_uniform(_SLOT_KEY, 32))} AS l, {_sql_poisson(sql_uniform(_SLOT_KEY, 33))} AS r FROM (SELECT conv_id, turn, unnest(src) AS w, generate_subscripts(src, 1) - 1 AS slot FROM {B.SQL_TURNS}) WHERE length(w) % 4 = 2),
h AS (SELECT DISTINCT c.conv_id, c.turn, c.slot FROM c JOIN c o ON o.conv_id = c.conv_id AND o.turn = c.turn AND o.own AND c.slot >= o.slot - o.l AND c.slot < o.slot + o.r + 1)
SELECT conv_id, turn, count(*) AS ops, count(*) FILTER (WHERE own) AS own, count(*) FILTER (WHERE h.slot IS NOT NULL) AS fired FROM c LEFT JOIN h USING (conv_id, turn, slot) GROUP BY conv_id, turn""")
def e11_h4_local_firing(spark, d):
    """Firing that spreads: each operation fires at its own time and carries Poisson many slots on each side with it."""
    from pairloom.functions.hashing import poisson

    c = B.turn_pairs(spark, d).select("conv_id", "turn", F.posexplode("src").alias("slot", "w")).where(F.length("w") % 4 == 2)
    key = F.col("conv_id") * 65536 + F.col("turn") * 1024 + F.col("slot")
    fired = c.withColumns({"own": uniform(key, 31) < 0.3, "left": poisson(uniform(key, 32), 0.5), "right": poisson(uniform(key, 33), 0.5)})
    cover = fired.where("own").select("conv_id", "turn", (F.col("slot") - F.col("left")).alias("cs"), (F.col("slot") + F.col("right") + 1).alias("ce"))
    hit = fired.join(cover, ["conv_id", "turn"]).where("slot >= cs and slot < ce").groupBy("conv_id", "turn", "slot").agg(F.count("*").alias("covers"))
    out = fired.join(hit, ["conv_id", "turn", "slot"], "left")
    return out.groupBy("conv_id", "turn").agg(F.count("*").alias("ops"), F.count_if("own").alias("own"), F.count("covers").alias("fired"))


@query("c1_word_priority", r"SELECT conv_id, turn, len(list_filter(range(len(w)), lambda i: i = 0 OR list_contains(['the', 'of', 'and', 'to', 'in'], lower(w[i + 1])))) AS high FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations) WHERE len(w) > 0")
def c1_word_priority(spark, d):
    """Words that overlap a token of a closed class (a tag table stands in for a tagger), or stand first."""
    c = B.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(A.words_with_offsets(F.col("text"))).alias("i", "w")).select("conv_id", "turn", "i", "w.*")
    tags = c.where(F.lower("w").isin("the", "of", "and", "to", "in")).select("conv_id", "turn", F.col("cs").alias("ts"), F.col("ce").alias("te"))
    near = c.join(tags, ["conv_id", "turn"], "left").where("te is null or (te > cs and ts < ce)").where("te is not null").select("conv_id", "turn", "i").distinct().withColumn("closed", F.lit(True))
    high = c.join(near, ["conv_id", "turn", "i"], "left").groupBy("conv_id", "turn").agg(F.count_if((F.col("i") == 0) | F.coalesce("closed", F.lit(False))).alias("high"))
    return high


@query("a46_conditional_means", "SELECT event_type, round(avg(value), 6) AS overall, round(avg(value) FILTER (WHERE event_id % 3 > 0), 6) AS edited FROM events GROUP BY 1")
def a46_conditional_means(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("overall"), F.round(F.avg(F.when(F.col("event_id") % 3 > 0, F.col("value"))), 6).alias("edited"))
