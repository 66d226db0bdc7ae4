"""Queries: alignment, edit algebra, spans, generation of edited pairs and rule-based rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.functions.hashing import sql_lcg, sql_uniform, uniform
from pairloom.operators import alignment as A
from pairloom.operators import features as X
from pairloom.operators import generation as G
from pairloom.operators import pairing as R
from pairloom.operators import proposing as N

from . import alignment_sql as Q
from . import base as B
from .registry import query


def _pairs(spark, d):
    """Consecutive turns with opcodes and slots (over word hashes), checkpointed by nothing: one Arrow pass."""
    t = B.turn_pairs(spark, d)
    ids = lambda c: F.transform(c, lambda w: F.crc32(w.cast("binary")))
    t = t.withColumns({"a": ids("src"), "b": ids("tgt")})
    return t.withColumn("ops", A.opcodes("a", "b"))


def _slots(spark, d):
    return _pairs(spark, d).withColumn("slots", A.slots(F.col("ops"), F.col("a"), F.col("b")))


@query("e1_opcodes", Q.over(Q.TURNS, "SELECT {k}, tag, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, CAST(j1 AS INTEGER) AS j1, CAST(j2 AS INTEGER) AS j2 FROM ops"))
def e1_opcodes(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.explode("ops").alias("o")).select("conv_id", "turn", "o.*")


@query("e2_e3_slots_round_trip", f"SELECT conv_id, turn, len(src) AS n_src, len(tgt) AS n_tgt, true AS source_back, true AS target_back FROM {B.SQL_TURNS}")
def e2_e3_slots_round_trip(spark, d):
    s = _slots(spark, d)
    return s.select("conv_id", "turn", F.size("src").cast("long").alias("n_src"), F.size("tgt").cast("long").alias("n_tgt"), (A.source_side(F.col("slots")) == F.col("a")).alias("source_back"), (A.target_side(F.col("slots")) == F.col("b")).alias("target_back"))


@query("e2_slot_operations", Q.over(Q.TURNS, "SELECT {k}, CAST(slot AS INTEGER) AS slot, kind, a1 AS tgt FROM slots WHERE kind IS NOT NULL"))
def e2_slot_operations(spark, d):
    s = _pairs(spark, d).withColumn("slots", A.slots(F.col("ops"), F.col("src"), F.col("tgt")))
    return s.select("conv_id", "turn", F.explode(A.slot_operations(F.col("slots"))).alias("o")).select("conv_id", "turn", "o.*")


@query("e4_runs", Q.over(Q.TURNS, "SELECT {k}, kind, CAST(min(slot) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS length FROM (SELECT {k}, slot, CASE kind WHEN 1 THEN 'del' ELSE 'ins' END AS kind, slot - row_number() OVER (PARTITION BY {k}, kind ORDER BY slot) AS island FROM slots WHERE kind < 2) GROUP BY {k}, kind, island"))
def e4_runs(spark, d):
    s = _slots(spark, d)
    each = lambda kind, name: s.select("conv_id", "turn", F.explode(A.runs(F.col("slots"), kind)).alias("r")).select("conv_id", "turn", F.lit(name).alias("kind"), "r.start", F.size("r.content").alias("length"))
    return each(A.DEL, "del").union(each(A.INS, "ins"))


@query("e5_e6_moves")
def e5_e6_moves(spark, d):
    s = _slots(spark, d)
    ops = A.with_moves(A.slot_operations(F.col("slots")), A.runs(F.col("slots"), A.DEL), A.runs(F.col("slots"), A.INS), F.transform("slots", lambda x: x["a0"]))
    return s.select("conv_id", "turn", F.explode(ops).alias("o")).select("conv_id", "turn", "o.*")


@query("e7_move_overlap", Q.over(Q.TURNS, ", n AS (SELECT {k}, w, least(count(*) FILTER (WHERE kind = 1), count(*) FILTER (WHERE kind = 0)) AS n FROM (SELECT {k}, kind, coalesce(a0, a1) AS w FROM slots WHERE kind < 2) GROUP BY {k}, w) SELECT {k}, CAST(coalesce(sum(n), 0) AS INTEGER) AS overlap FROM p LEFT JOIN n USING ({k}) GROUP BY {k}"))
def e7_move_overlap(spark, d):
    return _slots(spark, d).select("conv_id", "turn", A.move_overlap(F.col("slots")).alias("overlap"))


@query("e8_cached_slots", Q.pair_gold(Q.TURNS, "SELECT {k}, CAST(count(slot) AS INTEGER) AS n_slots FROM p JOIN b USING ({k}) LEFT JOIN slots USING ({k}) WHERE NOT coalesce(bad, false) AND NOT EXISTS (SELECT 1 FROM ops WHERE tag = 'delete' AND ops.conv_id = p.conv_id AND ops.turn = p.turn) GROUP BY {k}"))
def e8_cached_slots(spark, d):
    p = _pairs(spark, d)
    g = A.pair_gold(F.col("ops"), F.col("a"), F.col("b"), -1, -2)
    made = p.withColumn("g", g).where("g is not null and size(ops) > 0")
    made = made.withColumn("slots", A.cached_slots(F.col("g.input"), F.col("g.target"), F.col("a"), F.col("b"), F.col("ops"))).where("slots is not null")
    return made.select("conv_id", "turn", F.size("slots").alias("n_slots"))


@query("e9_e10_firing", f"SELECT event_id, round((event_id % 101 / 100.0) ^ 3, 6) AS kappa, {sql_uniform('event_id', 21)} < (event_id % 101 / 100.0) ^ 3 AS fires FROM events")
def e9_e10_firing(spark, d):
    t = (F.col("event_id") % 101) / 100.0
    return B.table(spark, d, "events").select("event_id", F.round(V.kappa(t), 6).alias("kappa"), (uniform(F.col("event_id"), 21) < V.kappa(t)).alias("fires"))


@query("e12_e13_states", Q.over(Q.TURNS, f""", f AS (SELECT *, kind IS NOT NULL AND {sql_uniform('(conv_id * 4096 + slot)', 5)} < 0.5 AS fired FROM slots),
s AS (SELECT *, CASE WHEN fired THEN a1 ELSE a0 END IS NOT NULL AS shown FROM f),
b AS (SELECT *, count(*) FILTER (WHERE shown) OVER (PARTITION BY {{k}} ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - shown::INT AS before FROM s),
m AS (SELECT DISTINCT {{k}}, CASE WHEN kind = 1 THEN before - 1 ELSE before END AS spot FROM b WHERE fired AND NOT (kind = 1 AND before = 0)),
t AS (SELECT {{k}}, count(*) FILTER (WHERE kind > 0) + count(DISTINCT before) FILTER (WHERE kind = 0 AND before > 0) AS pending FROM b WHERE kind IS NOT NULL AND NOT fired GROUP BY {{k}}),
n AS (SELECT {{k}}, count(*) FILTER (WHERE shown) AS n FROM b GROUP BY {{k}}),
a AS (SELECT {{k}}, count(*) AS near FROM m JOIN n USING ({{k}}), (VALUES (-1), (1)) d(step) WHERE spot + step >= 0 AND spot + step < n GROUP BY {{k}})
SELECT {{k}}, CAST(coalesce(n, 0) AS INTEGER) AS n, CAST(coalesce(pending, 0) AS INTEGER) AS pending, CAST(coalesce(n_marks, 0) AS INTEGER) AS n_marks, CAST(coalesce(near, 0) AS INTEGER) AS near
FROM p LEFT JOIN n USING ({{k}}) LEFT JOIN t USING ({{k}}) LEFT JOIN (SELECT {{k}}, count(*) AS n_marks FROM m GROUP BY {{k}}) USING ({{k}}) LEFT JOIN a USING ({{k}})"""))
def e12_e13_states(spark, d):
    """Size of the state, pending operations and marks of each pair, each operation fired by a hashed coin."""
    s = _slots(spark, d)
    ops = F.transform(A.slot_operations(F.col("slots")), lambda o: F.struct(o["slot"].alias("slot"), o["kind"].alias("kind"), o["tgt"].alias("tgt"), F.lit(None).cast("int").alias("dst")))
    s = s.withColumn("o", ops).withColumn("fired", F.transform("o", lambda o: uniform(F.col("conv_id") * 4096 + o["slot"], 5) < 0.5))
    s = s.withColumn("state", A.state_tokens(F.col("slots"), A.landed(F.col("o"), F.col("fired"))))
    s = s.withColumns({"marks": A.edit_marks("state", "o", "fired"), "todo": A.pending("state", "o", "fired")})
    x = A.compact(F.col("state"))
    near = F.aggregate(A.adjacency(F.col("marks"), F.size(x)), F.lit(0), lambda n, v: n + v)
    return s.select("conv_id", "turn", F.size(x).alias("n"), F.size("todo").alias("pending"), F.size("marks").alias("n_marks"), near.alias("near"))


@query("e14_e15_gold_sites", Q.over(Q.TURNS, f""", w AS (SELECT {{k}}, slot, kind, sum((a0 IS NOT NULL)::INT) OVER (PARTITION BY {{k}} ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (a0 IS NOT NULL)::INT AS place FROM slots),
g AS (SELECT DISTINCT {{k}}, CASE kind WHEN 0 THEN place - 1 ELSE place END AS i FROM w WHERE kind IS NOT NULL AND NOT (kind = 0 AND place = 0)),
n AS (SELECT {{k}}, count(*) AS n FROM g GROUP BY {{k}}),
r AS (SELECT {{k}}, i, row_number() OVER (PARTITION BY {{k}} ORDER BY {sql_uniform('(length(w) * 64 + i)', 2)} DESC, i) AS r FROM (SELECT {{k}}, unnest(src) AS w, generate_subscripts(src, 1) - 1 AS i FROM p)),
o AS (SELECT {{k}}, count(*) AS top, count(g.i) AS met FROM r JOIN n USING ({{k}}) LEFT JOIN g USING ({{k}}, i) WHERE r <= greatest(n, 1) GROUP BY {{k}})
SELECT {{k}}, CAST(coalesce(n, 0) AS INTEGER) AS sites, CASE WHEN n > 0 THEN round(coalesce(met, 0) / (coalesce(top, 0) + n - coalesce(met, 0)), 6) END AS iou FROM p LEFT JOIN n USING ({{k}}) LEFT JOIN o USING ({{k}})"""))
def e14_e15_gold_sites(spark, d):
    s = _slots(spark, d).withColumn("gold", A.gold_positions(F.col("slots")))
    rates = F.transform("src", lambda w, i: uniform(F.length(w) * 64 + i, 2))
    return s.select("conv_id", "turn", F.size("gold").alias("sites"), F.round(A.rate_iou(rates, F.col("gold")), 6).alias("iou"))


@query("e16_step", f"""SELECT conv_id, turn, array_to_string(list_concat(['new'], list_concat(CASE WHEN len(src) > 1 THEN [src[2], 'new'] ELSE [] END, src[4:])), ' ') AS made FROM {B.SQL_TURNS} WHERE len(src) > 0""")
def e16_step(spark, d):
    """Word 0 replaced, one put behind word 1, word 2 taken out, and one operation beyond the end."""
    t = B.turn_pairs(spark, d).where(F.size("src") > 0)
    op = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), F.lit("new").alias("tok"), F.lit(-1).alias("dst"))
    chosen = F.array(op(A.INS, 1), op(A.DEL, 2), op(A.SUB, 0), op(A.DEL, 1000000))
    return t.select("conv_id", "turn", F.array_join(A.apply_step(F.col("src"), chosen), " ").alias("made"))


@query("e17_e21_tags", f"SELECT conv_id, turn, len(list_filter(src, lambda w: length(w) % 4 = 2)) AS inserts, len(list_filter(src, lambda w: length(w) % 4 = 3)) AS deletes, len(src) - len(list_filter(src, lambda w: length(w) % 4 = 3)) + len(list_filter(src, lambda w: length(w) % 4 = 2)) AS cells FROM {B.SQL_TURNS}")
def e17_e21_tags(spark, d):
    t = B.turn_pairs(spark, d)
    tags = t.withColumn("tags", F.transform("src", lambda w: F.length(w) % 4)).withColumn("s", A.split_tags(F.col("tags")))
    ids = F.transform("src", lambda w: F.length(w).cast("long"))
    cells = A.template(ids, F.col("s.op3"), F.col("s.ins"), -1, -2)
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("long")
    return tags.select("conv_id", "turn", count("s.ins", 1).alias("inserts"), count("s.op3", 2).alias("deletes"), F.size(cells).cast("long").alias("cells"))


@query("e18_e20_templates", f"""WITH c AS (SELECT conv_id, turn, len(list_filter(t, lambda x: x = 2)) AS gaps, len(list_filter(t, lambda x: x = 1)) AS masks, len(t) - len(list_filter(t, lambda x: x = 3)) AS bodies, coalesce(list_sum(list_filter(n, lambda x: x % 4 IN (0, 2))), 0) AS kept
FROM (SELECT conv_id, turn, list_transform(src, lambda w: length(w)) AS n, list_transform(src, lambda w: length(w) % 4) AS t FROM {B.SQL_TURNS}))
SELECT conv_id, turn, CAST(bodies + gaps AS INTEGER) AS before, CAST(bodies + gaps + 2 AS INTEGER) AS after, CAST(kept + 5 * (masks + gaps + 2) AS BIGINT) AS total FROM c WHERE gaps > 0""")
def e18_e20_templates(spark, d):
    t = B.turn_pairs(spark, d).withColumn("tags", F.transform("src", lambda w: F.length(w) % 4)).withColumn("s", A.split_tags(F.col("tags")))
    ids = F.transform("src", lambda w: F.length(w).cast("long"))
    t = t.withColumn("cells", A.template(ids, F.col("s.op3"), F.col("s.ins"), -1, -2)).where(F.size(A.template_gaps(F.col("cells"))) > 0)
    first = F.element_at(A.template_gaps(F.col("cells")), 1)
    grown = A.resize_gap(F.col("cells"), first, F.lit(1), F.lit(3))
    decoded = A.decode_template(grown, F.transform(grown, lambda c: F.lit(5).cast("long")))
    return t.select("conv_id", "turn", F.size("cells").alias("before"), F.size(grown).alias("after"), F.aggregate(decoded, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("e21_run_lengths", f"""WITH m AS (SELECT conv_id, turn, list_filter(string_split(array_to_string(list_transform(src, lambda w: CASE WHEN length(w) % 4 = 2 THEN 'x' ELSE ' ' END), ''), ' '), lambda s: s <> '') AS r FROM {B.SQL_TURNS})
SELECT conv_id, turn, len(r) AS runs, coalesce(list_max(list_transform(r, lambda s: length(s))), 0) AS longest FROM m""")
def e21_run_lengths(spark, d):
    t = B.turn_pairs(spark, d)
    r = A.run_lengths(F.transform("src", lambda w: F.length(w) % 4), 2)
    return t.select("conv_id", "turn", F.size(r).cast("long").alias("runs"), F.coalesce(F.array_max(r), F.lit(0)).cast("long").alias("longest"))


@query("e36_first_insert", f"SELECT conv_id, turn, coalesce(list_position(list_transform(src, lambda w: length(w) % 4), 2), 0) - 1 AS first FROM {B.SQL_TURNS}")
def e36_first_insert(spark, d):
    return B.turn_pairs(spark, d).select("conv_id", "turn", A.first_insert(F.transform("src", lambda w: F.length(w) % 4)).alias("first"))


@query("e22_pair_gold", Q.pair_gold(Q.TURNS, "SELECT {k}, NOT coalesce(bad, false) AS valid, CASE WHEN NOT coalesce(bad, false) THEN coalesce(n_input, 0) END AS n_input, CASE WHEN NOT coalesce(bad, false) THEN coalesce(op_types, '') END AS op_types FROM p LEFT JOIN b USING ({k})"))
def e22_pair_gold(spark, d):
    g = _pairs(spark, d).withColumn("g", A.pair_gold(F.col("ops"), F.col("a"), F.col("b"), -1, -2))
    return g.select("conv_id", "turn", F.col("g").isNotNull().alias("valid"), F.size("g.input").alias("n_input"), F.array_join("g.op_types", ",").alias("op_types"))


@query("e27_e29_splice", f"SELECT conv_id, turn, substr(source_text, 1, 2) || 'XY' || substr(source_text, 5, length(source_text) - 5) || '!' AS edited, 0 AS change FROM {B.SQL_TURNS} WHERE length(source_text) > 8")
def e27_e29_splice(spark, d):
    t = B.turn_pairs(spark, d).where(F.length("source_text") > 8)
    n = F.length("source_text")
    edits = F.array(F.struct((n - 1).alias("cs"), n.alias("ce"), F.lit("!").alias("new")), F.struct(F.lit(2).alias("cs"), F.lit(4).alias("ce"), F.lit("XY").alias("new")))
    change = F.aggregate(edits, F.lit(0), lambda s, e: s + A.length_change(e))
    return t.select("conv_id", "turn", A.splice(F.col("source_text"), edits).alias("edited"), change.alias("change"))


@query("e30_partial_application", Q.over(Q.TURNS, f"SELECT {{k}}, CAST(coalesce(sum(CASE WHEN tag <> 'equal' AND {sql_uniform('(conv_id * 997 + op)', 8)} < 0.5 THEN j2 - j1 ELSE i2 - i1 END), 0) AS INTEGER) AS n FROM p LEFT JOIN ops USING ({{k}}) GROUP BY {{k}}"))
def e30_partial_application(spark, d):
    p = _pairs(spark, d).withColumn("fire", F.transform("ops", lambda o, i: uniform(F.col("conv_id") * 997 + i, 8) < 0.5))
    return p.select("conv_id", "turn", F.size(A.partial_application(F.col("ops"), F.col("a"), F.col("b"), F.col("fire"))).alias("n"))


def _near(spark, d):
    """Near copies among the sentences of the documents, with opcodes over their words."""
    ids = lambda c: F.transform(c, lambda w: F.crc32(w.cast("binary")))
    near = R.near_pairs(B.sentences(spark, d), "sentence", ["doc_id", "pos"]).withColumns({"a": ids("src"), "b": ids("tgt")})
    return near.withColumn("ops", A.opcodes("src", "tgt"))


_NEAR_IDS = ("doc_id", "pos", "other_doc_id", "other_pos")


@query("c21_near_pairs", Q.per_pair(Q.NEAR, f"{Q.HUNKS} AS hunks, {Q.EDITOR_OPS} AS editor_ops, {Q.SIMILARITY} AS similarity"))
def c21_near_pairs(spark, d):
    o = F.col("ops")
    return _near(spark, d).select(*_NEAR_IDS, A.hunk_count(o).alias("hunks"), A.editor_operations(o).alias("editor_ops"), F.round(A.similarity(o, F.col("a"), F.col("b")), 6).alias("similarity"))


@query("e22_near_pairs", Q.pair_gold(Q.NEAR, "SELECT {k}, NOT coalesce(bad, false) AS valid, CASE WHEN NOT coalesce(bad, false) THEN coalesce(n_input, 0) END AS n_input, CASE WHEN NOT coalesce(bad, false) THEN coalesce(op_types, '') END AS op_types FROM p LEFT JOIN b USING ({k})"))
def e22_near_pairs(spark, d):
    g = _near(spark, d).withColumn("g", A.pair_gold(F.col("ops"), F.col("a"), F.col("b"), -1, -2))
    return g.select(*_NEAR_IDS, F.col("g").isNotNull().alias("valid"), F.size("g.input").alias("n_input"), F.array_join("g.op_types", ",").alias("op_types"))


_SQL_ARTIFACTS = """, e AS (SELECT {k}, unnest(CASE tag WHEN 'equal' THEN list_transform(range(i1, i2), lambda i: {'keep': true, 'ins': false, 'del': false}) WHEN 'insert' THEN list_transform(range(j1, j2), lambda j: {'keep': false, 'ins': true, 'del': false})
ELSE list_transform(range(i1, i2), lambda i: {'keep': false, 'ins': false, 'del': i - i1 >= j2 - j1}) || list_transform(range(greatest(0, j2 - j1 - i2 + i1)), lambda j: {'keep': false, 'ins': true, 'del': false}) END) AS x FROM ops)
SELECT {k}, CAST(count(x) AS INTEGER) AS n_slots, CAST(count(*) FILTER (WHERE x.ins) AS INTEGER) AS inserts, CAST(count(*) FILTER (WHERE x.del) AS INTEGER) AS deletes, CAST(count(*) FILTER (WHERE NOT (x.keep OR x.ins OR x.del)) AS INTEGER) AS replaced FROM p LEFT JOIN e USING ({k}) GROUP BY {k}"""


@query("e8_near_pairs", Q.over(Q.NEAR, _SQL_ARTIFACTS))
def e8_near_pairs(spark, d):
    """Slots from the editor arrays of each pair: a gap for an inserted token, a mark for a deleted one."""
    p = _near(spark, d).withColumn("cells", A.editor_arrays(F.col("ops"), F.col("a"), F.col("b"), -1, -2, -3))
    s = p.withColumn("slots", A.artifact_slots(F.col("a"), F.col("b"), F.col("cells.input"), F.col("cells.target"), -2, -3))
    count = lambda kind: F.size(F.filter("slots", lambda x: A.kind(x) == kind))
    return s.where("slots is not null").select(*_NEAR_IDS, F.size("slots").alias("n_slots"), count(A.INS).alias("inserts"), count(A.DEL).alias("deletes"), count(A.SUB).alias("replaced"))


@query("e30_near_pairs", Q.over(Q.NEAR, f"SELECT {{k}}, array_to_string(flatten(list(CASE WHEN tag <> 'equal' AND {sql_uniform('(doc_id * 997 + op)', 8)} < 0.5 THEN tgt[j1 + 1:j2] ELSE src[i1 + 1:i2] END ORDER BY op)), ' ') AS made FROM p JOIN ops USING ({{k}}) GROUP BY {{k}}"))
def e30_near_pairs(spark, d):
    p = _near(spark, d).withColumn("fire", F.transform("ops", lambda o, i: uniform(F.col("doc_id") * 997 + i, 8) < 0.5))
    return p.select(*_NEAR_IDS, F.array_join(A.partial_application(F.col("ops"), F.col("src"), F.col("tgt"), F.col("fire")), " ").alias("made"))


# One row of the edit table for each source word: what deletion and substitution give, then insertions as a minimum over the cells before.
DISTANCE = f"""WITH RECURSIVE pairs AS (SELECT conv_id, turn, src, tgt FROM {B.SQL_TURNS}),
filled AS (
  SELECT conv_id, turn, src, tgt, 0 AS i, range(len(tgt) + 1) AS cells FROM pairs
  UNION ALL
  SELECT conv_id, turn, src, tgt, i + 1, list_transform(step, lambda c, j: list_min(list_transform(step[:j], lambda x, k: x + j - k)))
  FROM (SELECT *, [i + 1] || list_transform(range(1, len(tgt) + 1), lambda j: least(cells[j + 1] + 1, cells[j] + CAST(src[i + 1] <> tgt[j] AS BIGINT))) AS step FROM filled WHERE i < len(src))
)
SELECT conv_id, turn, CAST(cells[-1] AS INTEGER) AS distance FROM filled WHERE i = len(src)"""


@query("e31_token_distance", DISTANCE)
def e31_token_distance(spark, d):
    return B.turn_pairs(spark, d).select("conv_id", "turn", A.token_distance("src", "tgt").alias("distance"))


@query("e32_x5_x6_diff_metrics", Q.per_pair(Q.TURNS, f"{Q.HUNKS} AS hunks, {Q.EDITOR_OPS} AS editor_ops, {Q.SIMILARITY} AS similarity, CAST(1 AS DOUBLE) AS self_iou, {Q.EDITED} AS edited"))
def e32_x5_x6_diff_metrics(spark, d):
    p = _pairs(spark, d)
    o = F.col("ops")
    return p.select("conv_id", "turn", A.hunk_count(o).alias("hunks"), A.editor_operations(o).alias("editor_ops"), F.round(A.similarity(o, F.col("a"), F.col("b")), 6).alias("similarity"), F.round(A.location_iou(o, o), 6).alias("self_iou"), F.size(A.edited_positions(o)).alias("edited"))


@query("e34_markup", Q.per_pair(Q.TURNS, f"{Q.MARKUP} AS diff"))
def e34_markup(spark, d):
    p = B.turn_pairs(spark, d).withColumn("ops", A.opcodes("src", "tgt"))
    return p.select("conv_id", "turn", A.markup(F.col("ops"), F.col("src"), F.col("tgt")).alias("diff"))


@query("e37_gold_template", Q.per_pair(Q.TURNS, f"{Q.TEMPLATE} AS template"))
def e37_gold_template(spark, d):
    p = _pairs(spark, d)
    cells = A.gold_template(F.col("ops"), F.col("b"))
    return p.select("conv_id", "turn", F.array_join(F.transform(cells, lambda c: c["mark"]), "").alias("template"))


@query("e38_positional_difference", Q.over(Q.TURNS, "SELECT {k}, CAST(sum(length(tgt[j1 + 1]) - length(src[i1 + 1])) AS BIGINT) AS difference, count(*) AS blocks FROM p JOIN ops USING ({k}) WHERE tag = 'equal' GROUP BY {k}"))
def e38_positional_difference(spark, d):
    """Target less source word length at aligned equal positions: 0 everywhere, as a check of the positions."""
    p = _pairs(spark, d)
    at = p.select("conv_id", "turn", "src", "tgt", F.explode(F.filter("ops", lambda o: o["tag"] == "equal")).alias("o"))
    each = at.select("conv_id", "turn", F.length(F.element_at("src", F.col("o.i1") + 1)).alias("x"), F.length(F.element_at("tgt", F.col("o.j1") + 1)).alias("y"))
    return each.groupBy("conv_id", "turn").agg(F.sum(F.col("y") - F.col("x")).alias("difference"), F.count("*").alias("blocks"))


# Spans


@query("t1_words_with_offsets", f"""SELECT conv_id, turn, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars FROM (SELECT conv_id, turn, {B.SQL_WORDS.format('text')} AS w FROM conversations) WHERE len(w) > 0""")
def t1_words_with_offsets(spark, d):
    c = B.table(spark, d, "conversations").withColumn("w", A.words_with_offsets(F.col("text"))).where(F.size("w") > 0)
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["ce"] - x["cs"]).alias("chars"))


@query("t2_subword_spans")
def t2_subword_spans(spark, d):
    """Tokens of a public vocabulary file, and those that the first word of each turn covers."""
    import public_tokenizers

    c = B.table(spark, d, "conversations").withColumns({"tokens": A.subword_offsets(public_tokenizers.path("byte_bpe_50k.json"))("text"), "w": A.words_with_offsets(F.col("text"))})
    span = A.span_to_tokens(F.col("tokens"), F.get("w", 0)["cs"], F.get("w", 0)["ce"])
    return c.select("conv_id", "turn", F.size("tokens").alias("n_tokens"), F.size("w").alias("n_words"), (span["te"] - span["ts"]).alias("pieces"))


@query("t3_t5_spans", f"""WITH w AS (SELECT conv_id, turn, {B.SQL_WORDS.format('text')} AS w, text FROM conversations), p AS (SELECT conv_id, turn, w, list_transform(range(1, len(w) + 1), lambda i: i) AS i, text FROM w WHERE len(w) >= 4 AND NOT contains(text, chr(10)) AND NOT contains(text, '  ') AND text = trim(text))
SELECT conv_id, turn, 1 AS first, 2 AS at, 2 AS overlapping FROM p""")
def t3_t5_spans(spark, d):
    c = B.table(spark, d, "conversations").withColumn("w", A.words_with_offsets(F.col("text"))).where((F.size("w") >= 4) & ~F.col("text").contains("\n") & ~F.col("text").contains("  ") & (F.col("text") == F.trim("text")))
    second, third = F.element_at("w", 2), F.element_at("w", 3)
    span = A.span_to_tokens(F.col("w"), second["cs"], third["cs"])
    both = A.overlapping_tokens(F.col("w"), F.array(F.struct(second["cs"].alias("cs"), (third["cs"] + 1).alias("ce"))))
    return c.select("conv_id", "turn", span["ts"].alias("first"), A.token_at(F.col("w"), third["cs"]).alias("at"), F.size(both).alias("overlapping"))


@query("t8_word_labels", "SELECT p_partkey, [p_size, -100, p_size + 1] AS labels FROM part")
def t8_word_labels(spark, d):
    ids = F.array(F.lit(0), F.lit(0), F.lit(1))
    return B.table(spark, d, "part").select("p_partkey", A.word_labels(ids, F.array(F.col("p_size"), F.col("p_size") + 1)).alias("labels"))


@query("t9_first_subsequence", f"SELECT conv_id, turn, list_position(src, src[3]) IS NOT NULL AS found FROM {B.SQL_TURNS} WHERE len(src) >= 5")
def t9_first_subsequence(spark, d):
    t = B.turn_pairs(spark, d).where(F.size("src") >= 5)
    return t.select("conv_id", "turn", A.first_subsequence(F.col("src"), F.slice("src", 3, 2)).isNotNull().alias("found"))


def _pick(u: str, n: str) -> str:
    return f"1 + CAST(least(floor({u} * {n}), {n} - 1) AS INTEGER)"


# Generation


@query("c5_c7_draws", f"""SELECT doc_id, CASE WHEN u < 0.05 THEN 'identity' WHEN u < 0.6000000000000001 THEN 'single_op' WHEN u < 0.9500000000000001 THEN 'compound_2_3' ELSE 'compound_4_plus' END AS bucket FROM (SELECT doc_id, {sql_uniform('doc_id', 0)} AS u FROM documents)""")
def c5_c7_draws(spark, d):
    return B.documents(spark, d).select("doc_id", G.bucket(F.col("doc_id")).alias("bucket"))


def _drawn(spark, d):
    k = F.col("doc_id")
    base = B.documents(spark, d).select("doc_id", G.bucket(k).alias("bucket"))
    return base.withColumn("n", G.operation_count(F.col("bucket"), k)).withColumn("ops", G.operation_types(F.col("n"), k))


def _sql_edges(u: str, edges: list[float], values: list) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {e!r} THEN {v!r}" for e, v in zip(edges, values, strict=False)) + f" ELSE {values[-1]!r} END"


def _running(weights: list[float]) -> list[float]:
    out, edge, total = [], 0.0, sum(weights)
    for w in weights[:-1]:
        edge += w / total
        out.append(edge)
    return out


_SQL_BUCKETED = f"(SELECT doc_id, {_sql_edges(sql_uniform('doc_id', 0), _running(list(G.BUCKETS.values())), list(G.BUCKETS))} AS bucket, {sql_uniform('doc_id', 1)} AS u FROM documents)"
_SQL_COUNTED = f"""(SELECT doc_id, bucket, CASE bucket WHEN 'identity' THEN 0 WHEN 'single_op' THEN 1 WHEN 'compound_2_3' THEN {_sql_edges('u', _running([0.6**k for k in range(2)]), [2, 3])} ELSE {_sql_edges('u', _running([0.6**k for k in range(5)]), [4, 5, 6, 7, 8])} END AS n FROM {_SQL_BUCKETED})"""
_SQL_DRAWN = f"""(SELECT doc_id, bucket, n, list_transform(range(1, n + 1), lambda i: {_sql_edges(sql_uniform('(doc_id * 31 + i)', 2), _running(list(G.OP_WEIGHTS.values())), list(G.OP_WEIGHTS))}) AS ops FROM {_SQL_COUNTED})"""


@query("c6_c7_operation_counts", f"SELECT bucket, n, count(*) AS rows, CAST(sum(len(list_filter(ops, lambda o: o = 'REPL'))) AS BIGINT) AS repl FROM {_SQL_DRAWN} GROUP BY bucket, n")
def c6_c7_operation_counts(spark, d):
    return _drawn(spark, d).groupBy("bucket", "n").agg(F.count("*").alias("rows"), F.sum(F.size(F.filter("ops", lambda o: o == "REPL"))).alias("repl"))


@query("c8_rejection_loop", """WITH a AS (SELECT doc_id, attempt, (doc_id * 7 + attempt * 13) % 5 < 2 AS ok FROM documents, (VALUES (1), (2), (3), (4), (5), (6)) t(attempt)) SELECT attempt, count(*) AS n FROM (SELECT doc_id, min(attempt) AS attempt FROM a WHERE ok GROUP BY doc_id) GROUP BY attempt""")
def c8_rejection_loop(spark, d):
    a = G.attempts(B.documents(spark, d).select("doc_id"), 6).withColumn("ok", (F.col("doc_id") * 7 + F.col("attempt") * 13) % 5 < 2)
    return G.first_accepted(a, "doc_id", "ok").groupBy("attempt").agg(F.count("*").alias("n"))


@query("c9_subsets", f"""WITH d AS (SELECT doc_id, len(ops) AS n FROM {_SQL_DRAWN})
SELECT subset_kind, count(*) AS n, CAST(sum(kept) AS BIGINT) AS kept FROM (SELECT CASE WHEN n = 0 THEN 'identity' ELSE 'full' END AS subset_kind, n AS kept FROM d
UNION ALL SELECT 'partial', {_pick(sql_uniform('doc_id', 11), '(n - 1)')} FROM d WHERE n >= 2 AND {sql_uniform('doc_id', 13)} < 1.0 UNION ALL SELECT 'null', 0 FROM d WHERE n >= 1 AND {sql_uniform('doc_id', 14)} < 0.5) GROUP BY 1""")
def c9_subsets(spark, d):
    out = G.subsets(_drawn(spark, d), F.col("doc_id"), "ops")
    return out.groupBy("subset_kind").agg(F.count("*").alias("n"), F.sum(F.size("kept")).alias("kept"))


@query("c10_both_directions", f"SELECT kind, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS x_chars FROM (SELECT source_text AS x, 'edit' AS kind FROM {B.SQL_TURNS} UNION ALL SELECT target_text, 'edit/rev' FROM {B.SQL_TURNS}) GROUP BY kind")
def c10_both_directions(spark, d):
    t = B.turn_pairs(spark, d).select(F.col("source_text").alias("x"), F.col("target_text").alias("y"), F.lit("edit").alias("kind"))
    return G.both_directions(t, "x", "y", "kind").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("x_chars"))


def _rewritable(spark, d):
    """Sentences with patterns that the families know, made from the part table."""
    p = B.table(spark, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("w"))
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("It is hard to find "), F.col("w"), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("If she had "), F.col("w"), F.lit(", we left.")))
        .when(kind == 2, F.concat(F.lit("It was "), F.col("w"), F.lit(" who came.")))
        .when(kind == 3, F.lit('"Go now," said Anna.'))
        .when(kind == 4, F.lit("They do not sing every song here."))
        .otherwise(F.concat(F.lit("We saw the "), F.col("w"), F.lit(", and they saw us.")))
    )
    return p.select("p_partkey", text.alias("text"))


def _first_upper(s: str) -> str:
    return f"upper(substr({s}, 1, 1)) || substr({s}, 2)"


#: The proposals on these sentences, written out: (p_partkey, text, t_type, family, out_text).
_SQL_WORD = "split_part(p_name, ' ', 1)"
_SQL_REWRITTEN = f"""(SELECT p_partkey, 'It is hard to find ' || w || '.' AS text, 'TOUGH:IT->RAISED' AS t_type, 'TOUGH' AS family, {_first_upper('w')} || ' is hard to find.' AS out_text FROM z WHERE k = 0
UNION ALL SELECT p_partkey, 'If she had ' || w || ', we left.', 'INV:IF->AUX', 'INVERSION', 'Had she ' || w || ', we left.' FROM z WHERE k = 1
UNION ALL SELECT p_partkey, 'It was ' || w || ' who came.', 'CLEFT:-IT', 'CLEFT', {_first_upper('w')} || ' came.' FROM z WHERE k = 2
UNION ALL SELECT p_partkey, '"Go now," said Anna.', 'QI:VS->SV', 'QUOTINV', '"Go now," Anna said.' FROM z WHERE k = 3
UNION ALL SELECT p_partkey, 'They do not sing every song here.', 'CTR:FUSE', 'CONTRACT', 'They don''t sing every song here.' FROM z WHERE k = 4
UNION ALL SELECT p_partkey, 'They do not sing every song here.', 'DETQ:every->each', 'DETQUANT', 'They do not sing each song here.' FROM z WHERE k = 4
UNION ALL SELECT p_partkey, 'We saw the ' || w || ', and they saw us.', 'SPLIT:,and->.', 'SPLITJOIN', 'We saw the ' || w || '. They saw us.' FROM z WHERE k = 5)"""
_SQL_Z = f"z AS (SELECT p_partkey, p_partkey % 6 AS k, {_SQL_WORD} AS w FROM part)"


@query("c11_families", f"WITH {_SQL_Z} SELECT p_partkey, t_type, family, out_text FROM {_SQL_REWRITTEN}")
def c11_families(spark, d):
    return G.proposals(_rewritable(spark, d), "text").select("p_partkey", "t_type", "family", "out_text")


@query("c12_round_trips", f"WITH {_SQL_Z} SELECT p_partkey, family, out_text FROM {_SQL_REWRITTEN} WHERE family <> 'CLEFT' AND text <> out_text")
def c12_round_trips(spark, d):
    text = _rewritable(spark, d)
    return G.round_trips(G.proposals(text, "text"), "p_partkey", "text").select("p_partkey", "family", "out_text")


@query("c13_composed", f"""WITH {_SQL_Z} SELECT p_partkey, unnest(['CTR:FUSE+DETQ:every->each', 'DETQ:every->each+CTR:FUSE']) AS t_type, 'They don''t sing each song here.' AS out_text FROM z WHERE k = 4""")
def c13_composed(spark, d):
    found = G.proposals(_rewritable(spark, d), "text")
    return G.composed(found, "p_partkey", "text").select("p_partkey", "t_type", "out_text")


@query("c14_balanced_pick", f"""WITH {_SQL_Z}, o AS (SELECT p_partkey, count(DISTINCT family) AS families FROM {_SQL_REWRITTEN} GROUP BY 1) SELECT p_partkey, CAST(families AS BIGINT) AS families, true AS offered FROM o""")
def c14_balanced_pick(spark, d):
    """Each row's pick is one of its own proposals; which one, a test compares with a plain version."""
    found = G.proposals(_rewritable(spark, d), "text")
    offered = found.groupBy("p_partkey").agg(F.count_distinct("family").alias("families"), F.collect_set(F.struct("family", "t_type", "out_text")).alias("all"))
    picked = G.balanced_pick(found, "p_partkey").select("p_partkey", F.struct("family", "t_type", "out_text").alias("one"))
    return picked.join(offered, "p_partkey").select("p_partkey", "families", F.array_contains("all", F.col("one")).alias("offered"))


@query("c16_unigrams", f"WITH c AS (SELECT token, count(*) AS c FROM {B.SQL_TOKENS} GROUP BY token), z AS (SELECT sum(c) AS total, count(*) AS v FROM c) SELECT token, round(ln((c + 1.0) / (total + v + 1)), 6) AS log_prob, round(ln(1.0 / (total + v + 1)), 6) AS unk_log_prob FROM c, z")
def c16_unigrams(spark, d):
    return G.unigrams(B.tokens(spark, d)).select("token", F.round("log_prob", 6).alias("log_prob"), F.round("unk_log_prob", 6).alias("unk_log_prob"))


@query("c15_slor", f"""WITH t AS (SELECT doc_id, token, -3.0 - pos % 5 AS logp FROM {B.SQL_TOKENS}), c AS (SELECT token, count(*) AS c FROM t GROUP BY token), z AS (SELECT sum(c) AS total, count(*) AS v FROM c)
SELECT doc_id, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN (sum(logp) - sum(ln((c + 1.0) / (total + v + 1)))) / count(*) END, 5) AS slor FROM t JOIN c USING (token), z GROUP BY doc_id""")
def c15_slor(spark, d):
    t = B.tokens(spark, d)
    scored = t.withColumn("logp", -3.0 - F.col("pos") % 5)
    return G.slor(scored, G.unigrams(t), "doc_id").select("doc_id", "n", F.round("slor", 5).alias("slor"))


@query("c17_gates", "SELECT event_id, CASE WHEN n > 0 AND drop > 0.10 * n THEN 'slor' WHEN n > 0 AND change < 1 THEN 'topk' END AS reason FROM (SELECT event_id, event_id % 4 AS n, value / 500 AS drop, event_id % 3 AS change FROM events)")
def c17_gates(spark, d):
    e = B.table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("n"), (F.col("value") / 500).alias("drop"), (F.col("event_id") % 3).alias("change"))
    return e.select("event_id", G.gate(F.col("drop"), F.col("n"), F.col("change")).alias("reason"))


@query("c19_c20_run_statistics", """WITH r AS (SELECT event_id % 4 AS n, CASE WHEN event_id % 4 > 0 AND value / 500 > 0.10 * (event_id % 4) THEN 'slor' WHEN event_id % 4 > 0 AND event_id % 3 < 1 THEN 'topk' ELSE 'ok' END AS reason FROM events)
SELECT n, reason, count(*) AS rows FROM r GROUP BY GROUPING SETS ((n, reason), (reason), ())""")
def c19_c20_run_statistics(spark, d):
    n = F.col("event_id") % 4
    e = B.table(spark, d, "events").select(n.alias("n"), F.coalesce(G.gate(F.col("value") / 500, n, F.col("event_id") % 3), F.lit("ok")).alias("reason"))
    out = e.groupingSets([[F.col("n"), F.col("reason")], [F.col("reason")], []], F.col("n"), F.col("reason")).agg(F.count("*").alias("rows"))
    return out.select("n", "reason", "rows")


@query("c21_natural_pairs", f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(src) = 0 OR len(tgt) = 0 THEN 'empty' WHEN src = tgt THEN 'identical' WHEN NOT len(src) BETWEEN 5 AND 60 OR NOT len(tgt) BETWEEN 5 AND 60 THEN 'length' WHEN abs(len(src) - len(tgt)) NOT BETWEEN 1 AND 8 THEN 'n_ops' ELSE 'ok' END AS reason FROM {B.SQL_TURNS}) GROUP BY 1")
def c21_natural_pairs(spark, d):
    t = B.turn_pairs(spark, d).withColumn("n_ops", F.abs(F.size("src") - F.size("tgt")))
    return G.natural_pairs(t, 5, 60, 8).groupBy("reason").agg(F.count("*").alias("n"))


@query("c22_spec_rows", f"""WITH m AS (SELECT grp, f, sum(v) / any_value(n) AS mean FROM {B.SQL_ACTIVATIONS} JOIN {B.SQL_SIZES} USING (grp) GROUP BY grp, f), z AS (SELECT grp, sqrt(sum(mean * mean)) AS mn FROM m GROUP BY grp), r AS (SELECT grp, median(dn) AS md FROM (SELECT grp, row, sqrt(sum(v * v)) AS dn FROM {B.SQL_ACTIVATIONS} GROUP BY grp, row) GROUP BY grp)
SELECT grp, dir, f, round(mean * 2 * md / mn, 6) AS v FROM m JOIN z USING (grp) JOIN r USING (grp), (VALUES ('enh'), ('abl')) d(dir)""")
def c22_spec_rows(spark, d):
    specs = X.spec_summary(B.activations(spark, d), B.sizes(spark, d))
    rows = G.spec_rows(specs, 2.0)
    both = rows.select("grp", "dir", F.explode(F.map_concat("pos", "neg")).alias("f", "v"))
    return both.select("grp", "dir", "f", F.round("v", 6).alias("v"))


@query("c23_mismatched_partner", f"""WITH b AS (SELECT doc_id, {sql_lcg('doc_id', 6)} % (SELECT greatest(1, count(*) // {G.PARTNERS}) FROM documents) AS b, {sql_uniform('doc_id', 5)} AS o FROM documents)
SELECT doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS partner FROM b WINDOW w AS (PARTITION BY b ORDER BY o, doc_id)""")
def c23_mismatched_partner(spark, d):
    out = G.mismatched(B.documents(spark, d).select("doc_id", "lang"), F.col("doc_id"), "doc_id", "partner")
    return out.select("doc_id", "partner")


@query("c24_reencoded_columns", f"SELECT d.doc_id, d.lang, round(l.m, 6) AS mean_new FROM documents d JOIN (SELECT vec_id AS doc_id, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings) l USING (doc_id)")
def c24_reencoded_columns(spark, d):
    new = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("embedding")).alias("m"))
    return B.documents(spark, d).select("doc_id", "lang").join(new, "doc_id").select("doc_id", "lang", F.round("m", 6).alias("mean_new"))


@query("c25_class_weights", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round((1.0 / (n + 1)) / avg(1.0 / (n + 1)) OVER (), 6) AS weight FROM c")
def c25_class_weights(spark, d):
    return G.class_weights(B.table(spark, d, "events"), "event_type").select("event_type", "n", F.round("weight", 6).alias("weight"))


_SQL_PLACED = f"(SELECT conv_id, turn, src, conv_id * 1000 + turn AS k FROM {B.SQL_TURNS} WHERE len(src) >= 1)"
_SQL_TRIES = "(SELECT unnest(range(0, 3)) AS try)"


def _placed(spark, d):
    return B.turn_pairs(spark, d).where(F.size("src") >= 1).select("conv_id", "turn", "src", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))


def _made(t, op):
    """Rows with an operation, each computed once."""
    return t.select("conv_id", "turn", F.explode(F.filter(F.array(op), lambda o: o.isNotNull())).alias("op"))


@query("c2_replacements", f"""WITH t AS (SELECT *, list_filter(range(0, len(src)), lambda i: i % 3 <> 0) AS free FROM {_SQL_PLACED}),
p AS (SELECT conv_id, turn, src, try, k * 64 + try AS q, free[{_pick(sql_uniform('(k * 64 + try)', 21), 'len(free)')}] AS place FROM t, {_SQL_TRIES} WHERE len(free) > 0),
c AS (SELECT *, list_filter([src[(place + 1) % len(src) + 1], 'alpha', '12', src[place + 1], '##beta', 'extraordinarilylongcandidate', 'gamma'], lambda w: regexp_matches(w, '\\p{{L}}') AND NOT starts_with(w, '##') AND lower(trim(w)) <> lower(trim(src[place + 1])) AND length(w) <= greatest(20, 3 * length(src[place + 1]))) AS found FROM p)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, found[{_pick(sql_uniform('q', 22), 'least(len(found), 2)')}] AS payload FROM c WHERE len(found) > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY try) = 1""")
def c2_replacements(spark, d):
    """Candidates of a place: the next word, some fixed ones and some that must be passed over."""
    t = _placed(spark, d)
    n = F.size("src")
    fixed = lambda i: F.array(F.get("src", (i + 1) % n), F.lit("alpha"), F.lit("12"), F.get("src", i), F.lit("##beta"), F.lit("extraordinarilylongcandidate"), F.lit("gamma"))
    places = F.sequence(F.lit(0), n - 1)
    op = N.propose_replacement(F.col("src"), F.filter(places, lambda i: i % 3 == 0), F.transform(places, fixed), F.col("k"), top=4)
    return _made(t, op).select("conv_id", "turn", F.col("op.start").alias("place"), "op.payload")


@query("c3_gaps", f"""WITH s AS (SELECT conv_id, turn, k, len(src) AS n, a, a + b AS e FROM (SELECT *, unnest(range(1, len(src) - 1)) AS a FROM {_SQL_PLACED}), (SELECT unnest(range(1, 4)) AS b) WHERE b <= least(3, len(src) - a - 1)),
f AS (SELECT *, a % 2 = 0 AS high FROM s WHERE NOT (a <= 4 AND e >= 4)),
g AS (SELECT conv_id, turn, any_value(k) AS k, list(a ORDER BY a, e) FILTER (WHERE high) AS ha, list(e ORDER BY a, e) FILTER (WHERE high) AS he, list(a ORDER BY a, e) FILTER (WHERE NOT high) AS la, list(e ORDER BY a, e) FILTER (WHERE NOT high) AS le FROM f GROUP BY ALL),
o AS (SELECT conv_id, turn, k, CASE WHEN {sql_uniform('k', 23)} < 0.85 AND len(ha) > 0 THEN true WHEN len(la) > 0 THEN false ELSE true END AS up, ha, he, la, le FROM g),
z AS (SELECT conv_id, turn, k, CASE WHEN up THEN ha ELSE la END AS a, CASE WHEN up THEN he ELSE le END AS e FROM o)
SELECT conv_id, turn, CAST(a[{_pick(sql_uniform('k', 24), 'len(a)')}] AS INTEGER) AS low, CAST(e[{_pick(sql_uniform('k', 24), 'len(a)')}] AS INTEGER) AS high FROM z""")
def c3_gaps(spark, d):
    t = _placed(spark, d)
    op = N.propose_gap(F.col("src"), F.array(F.lit(4)), F.filter(F.sequence(F.lit(0), F.size("src") - 1), lambda i: i % 2 == 0), F.col("k"))
    return _made(t, op).select("conv_id", "turn", F.col("op.start").alias("low"), F.col("op.end").alias("high"))


#: What follows a word, best first: by its length, or nothing.
_SQL_AFTER = "CASE WHEN {0} IS NULL OR length({0}) % 4 = 3 THEN [] WHEN length({0}) % 2 = 0 THEN ['red', '##x', 'green', 'blue'] ELSE ['tall', 'grand'] END"
_SQL_AFTER_FOUND = f"list_filter({_SQL_AFTER}, lambda w: NOT starts_with(w, '##'))"


def _sql_grown(step: int, last: str) -> str:
    """The word of a step, null where growth ended."""
    found = _SQL_AFTER_FOUND.format(last)
    draw = f"(q * 16 + {step})"
    return f"CASE WHEN {step} <= wanted AND {last} IS NOT NULL THEN CASE WHEN {sql_uniform(draw, 27)} < 0.5 THEN ({found})[1] ELSE ({found})[{_pick(sql_uniform(draw, 28), f'least(len({found}), 2)')}] END END"


@query("c4_insertions", f"""WITH t AS (SELECT *, list_filter(range(1, len(src)), lambda i: i % 3 <> 0) AS free FROM {_SQL_PLACED}),
p AS (SELECT conv_id, turn, try, k * 64 + try AS q, {_pick(sql_uniform('(k * 64 + try)', 26), '3')} AS wanted, free[{_pick(sql_uniform('(k * 64 + try)', 25), 'len(free)')}] AS place, src FROM t, {_SQL_TRIES} WHERE len(free) > 0),
a AS (SELECT *, src[place] AS w0 FROM p), b AS (SELECT *, {_sql_grown(1, 'w0')} AS w1 FROM a), c AS (SELECT *, {_sql_grown(2, 'w1')} AS w2 FROM b), e AS (SELECT *, {_sql_grown(3, 'w2')} AS w3 FROM c)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, concat_ws(' ', w1, w2, w3) AS payload FROM e WHERE w1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY try) = 1""")
def c4_insertions(spark, d):
    t = _placed(spark, d)
    none = F.array().cast("array<string>")
    after = lambda w: F.when(F.length(w) % 4 == 3, none).when(F.length(w) % 2 == 0, F.array(*map(F.lit, ("red", "##x", "green", "blue")))).otherwise(F.array(*map(F.lit, ("tall", "grand"))))
    known = F.array_distinct(F.concat("src", F.array(*map(F.lit, ("red", "green", "blue", "tall", "grand")))))
    ranked = F.map_from_arrays(known, F.transform(known, after))
    op = N.propose_insertion(F.col("src"), F.filter(F.sequence(F.lit(0), F.size("src") - 1), lambda i: i % 3 == 0), ranked, F.col("k"), top=4)
    return _made(t, op).select("conv_id", "turn", F.col("op.start").alias("place"), "op.payload")


@query("c23_group_mean_mix", f"""WITH w AS (SELECT DISTINCT row, grp, 0.3 + 0.4 * {sql_uniform('row', 43)} AS w FROM {B.SQL_ACTIVATIONS}), m AS (SELECT grp, f, sum(v) / any_value(n) AS mean FROM {B.SQL_ACTIVATIONS} JOIN {B.SQL_SIZES} USING (grp) GROUP BY grp, f),
u AS (SELECT row, f, w * v AS v FROM {B.SQL_ACTIVATIONS} JOIN w USING (row) UNION ALL SELECT row, f, (1 - w) * mean FROM w JOIN m USING (grp)) SELECT row, f, round(sum(v), 6) AS v FROM u GROUP BY row, f""")
def c23_group_mean_mix(spark, d):
    return G.group_mean_mix(B.activations(spark, d), B.sizes(spark, d), "row", "grp").select("row", "f", F.round("v", 6).alias("v"))


@query("k11_operation_kind", "SELECT event_id, CASE WHEN nxt > cur AND nxt > prop THEN 'DEL' WHEN cur > 0.5 THEN 'INS' ELSE 'SUB' END AS kind FROM (SELECT event_id, (event_id % 7) / 7.0 AS nxt, (event_id % 5) / 5.0 AS cur, (event_id % 3) / 3.0 AS prop FROM events)")
def k11_operation_kind(spark, d):
    e = B.table(spark, d, "events").select("event_id", ((F.col("event_id") % 7) / 7.0).alias("nxt"), ((F.col("event_id") % 5) / 5.0).alias("cur"), ((F.col("event_id") % 3) / 3.0).alias("prop"))
    return e.select("event_id", F.when((F.col("nxt") > F.col("cur")) & (F.col("nxt") > F.col("prop")), "DEL").when(F.col("cur") > 0.5, "INS").otherwise("SUB").alias("kind"))
