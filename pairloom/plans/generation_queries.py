"""Queries: compound draws with claims, weighted picks with state, minimal subsets in step."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions import vectors as V
from pairloom.functions.hashing import sql_text_uniform, sql_uniform
from pairloom.operators import decoding as D
from pairloom.operators import generation as G
from pairloom.operators import proposing as N
from pairloom.sources.lineage import materialise

from . import base as B
from .edit_queries import _SQL_AFTER_FOUND, _pick, _running, _sql_edges
from .registry import query

# Compound draws


def _candidates():
    """A list for each place of column `src`: the next word, some fixed ones and some that must be passed over."""
    n = F.size("src")
    fixed = lambda i: F.array(F.get("src", (i + 1) % n), F.lit("alpha"), F.lit("12"), F.get("src", i), F.lit("##beta"), F.lit("extraordinarilylongcandidate"), F.lit("gamma"))
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), fixed)


def _ranked():
    """What follows each word of column `src`, best first: by its length, or nothing."""
    none = F.array().cast("array<string>")
    after = lambda w: F.when(F.length(w) % 4 == 3, none).when(F.length(w) % 2 == 0, F.array(*map(F.lit, ("red", "##x", "green", "blue")))).otherwise(F.array(*map(F.lit, ("tall", "grand"))))
    known = F.array_distinct(F.concat("src", F.array(*map(F.lit, ("red", "green", "blue", "tall", "grand")))))
    return F.map_from_arrays(known, F.transform(known, after))


def _compounds(spark, d):
    """(conv_id, turn, src, types, drawn) of all turns."""
    c = B.table(spark, d, "conversations").select("conv_id", "turn", T.words(F.lower(F.coalesce("text", F.lit("")))).alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    n = G.operation_count(G.bucket(F.col("k")), F.col("k"))
    c = c.withColumn("n", n).withColumns({"types": G.operation_types(F.col("n"), F.col("k")), "candidates": _candidates(), "ranked": _ranked()})
    high = F.filter(F.transform("src", lambda _, i: i), lambda i: i % 2 == 0)
    return c.withColumn("drawn", N.compound_draw(F.col("src"), F.col("types"), F.col("candidates"), high, F.col("ranked"), F.col("k"), top=4))


def _sql_compounds() -> str:
    """The same fold as a recursive CTE: one step for each operation."""
    words = B.SQL_WORDS.format("lower(coalesce(text, ''))")
    drawn = f"""t AS MATERIALIZED (SELECT conv_id, turn, src, k, n, list_transform(range(1, n + 1), lambda i: {_sql_edges(sql_uniform('(k * 31 + i)', 2), _running(list(G.OP_WEIGHTS.values())), list(G.OP_WEIGHTS))}) AS types
FROM (SELECT *, CASE bucket WHEN 'identity' THEN 0 WHEN 'single_op' THEN 1 WHEN 'compound_2_3' THEN {_sql_edges('u', _running([0.6**k for k in range(2)]), [2, 3])} ELSE {_sql_edges('u', _running([0.6**k for k in range(5)]), [4, 5, 6, 7, 8])} END AS n
FROM (SELECT *, {_sql_edges(sql_uniform('k', 0), _running(list(G.BUCKETS.values())), list(G.BUCKETS))} AS bucket, {sql_uniform('k', 1)} AS u FROM (SELECT conv_id, turn, {words} AS src, conv_id * 1000 + turn AS k FROM conversations))))"""
    fits = "regexp_matches(w, '\\p{L}') AND NOT starts_with(w, '##') AND lower(trim(w)) <> lower(trim(src[x.p + 1])) AND length(w) <= greatest(20, 3 * length(src[x.p + 1]))"
    found = f"list_filter([src[(x.p + 1) % len(src) + 1], 'alpha', '12', src[x.p + 1], '##beta', 'extraordinarilylongcandidate', 'gamma'], lambda w: {fits})"
    pick = lambda items, u, most=None: f"{items}[{_pick(u, f'len({items})' if most is None else f'least(len({items}), {most})')}]"

    def grown(step: int, last: str) -> str:
        after, draw = _SQL_AFTER_FOUND.format(last), f"(x.q * 16 + {step})"
        return f"CASE WHEN {step} <= x.wanted AND {last} IS NOT NULL THEN CASE WHEN {sql_uniform(draw, 27)} < 0.5 THEN ({after})[1] ELSE {pick(f'({after})', sql_uniform(draw, 28), 2)} END END"

    base = {"q": "x.q", "p": "x.p", "wanted": "x.wanted"}
    again = lambda **new: "{" + ", ".join(f"'{k}': {v}" for k, v in (base | new).items()) + "}"
    tries = "list_transform(range(0, 3), lambda z: own * 64 + z)"
    steps = f"""
SELECT * EXCLUDE (tried), list_filter(tried, lambda x: x.w <> '')[1] AS made FROM (
SELECT * EXCLUDE (tried), list_transform(tried, lambda x: {{'s': x.p, 'e': CASE WHEN kind = 'REPL' THEN x.p + 1 ELSE x.p END, 'w': CASE WHEN kind = 'REPL' THEN coalesce(x.w1, '') ELSE concat_ws(' ', x.w1, x.w2, x.w3) END}}) AS tried FROM (
SELECT * EXCLUDE (tried), list_transform(tried, lambda x: {again(w1="x.w1", w2="x.w2", w3=f"CASE WHEN kind = 'DEL' THEN {grown(3, 'x.w2')} END")}) AS tried FROM (
SELECT * EXCLUDE (tried), list_transform(tried, lambda x: {again(w1="x.w1", w2=f"CASE WHEN kind = 'DEL' THEN {grown(2, 'x.w1')} END")}) AS tried FROM (
SELECT * EXCLUDE (tried), list_transform(tried, lambda x: {again(w1=f"CASE WHEN kind = 'DEL' THEN {grown(1, 'src[x.p]')} ELSE {pick(found, sql_uniform('x.q', 22), 2)} END")}) AS tried FROM (
SELECT *, CASE WHEN kind = 'INS' OR len(free) = 0 THEN [] ELSE list_transform({tries}, lambda z: {{'q': z, 'wanted': {_pick(sql_uniform('z', 26), '3')}, 'p': CASE WHEN kind = 'REPL' THEN {pick('free', sql_uniform('z', 21))} ELSE {pick('free', sql_uniform('z', 25))} END}}) END AS tried FROM (
SELECT r.conv_id, r.turn, r.i, r.claimed, r.ops, t.src, t.types[r.i + 1] AS kind, t.k * 8 + r.i AS own, list_filter(range(CASE WHEN t.types[r.i + 1] = 'REPL' THEN 0 ELSE 1 END, len(t.src)), lambda x: NOT list_contains(r.claimed, x)) AS free,
list_filter(flatten(list_transform(range(1, greatest(1, len(t.src) - 1)), lambda a: list_transform(range(1, least(3, len(t.src) - a - 1) + 1), lambda b: {{'s': a, 'e': a + b}}))), lambda x: len(list_filter(r.claimed, lambda c: c >= x.s AND c <= x.e)) = 0) AS spans
FROM r JOIN t USING (conv_id, turn) WHERE r.i < t.n AND r.reason IS NULL))))))"""
    pool = f"CASE WHEN {sql_uniform('own', 23)} < 0.85 AND len(upper_) > 0 THEN upper_ WHEN len(lower_) > 0 THEN lower_ ELSE upper_ END"
    one = f"""SELECT *, CASE WHEN kind <> 'INS' THEN made WHEN len(pool) > 0 THEN {{'s': ({pick('pool', sql_uniform('own', 24))}).s, 'e': ({pick('pool', sql_uniform('own', 24))}).e, 'w': NULL::VARCHAR}} END AS op
FROM (SELECT *, {pool} AS pool FROM (SELECT *, list_filter(spans, lambda x: x.s % 2 = 0) AS upper_, list_filter(spans, lambda x: x.s % 2 <> 0) AS lower_ FROM ({steps})))"""
    return f"""{drawn},
r AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS claimed, CAST([] AS VARCHAR[]) AS ops, CASE WHEN len(src) < 3 THEN 'too_short_sentence' END AS reason FROM t
UNION ALL SELECT conv_id, turn, i + 1, CASE WHEN op IS NULL THEN claimed ELSE list_concat(claimed, range(op.s, CASE WHEN kind = 'INS' THEN op.e + 1 ELSE op.s + 1 END)) END,
CASE WHEN op IS NULL THEN ops ELSE list_append(ops, concat_ws(':', lower(kind), op.s, op.e, coalesce(op.w, ''))) END, CASE WHEN op IS NULL THEN 'ops_unsuitable' END FROM ({one})),
z AS (SELECT r.conv_id, r.turn, t.n, r.reason, CASE WHEN r.reason IS NULL THEN array_to_string(r.ops, '|') ELSE '' END AS ops FROM r JOIN t USING (conv_id, turn) WHERE r.reason IS NOT NULL OR r.i = t.n)"""


@query("c6_compound_draws", f"WITH RECURSIVE {_sql_compounds()} SELECT conv_id, turn, n, reason, ops FROM z")
def c6_compound_draws(spark, d):
    shown = F.transform("drawn.ops", lambda o: F.concat_ws(":", o["kind"], o["start"], o["end"], F.coalesce(o["payload"], F.lit(""))))
    return _compounds(spark, d).select("conv_id", "turn", "n", F.col("drawn.reason").alias("reason"), F.array_join(shown, "|").alias("ops"))


@query("c6_reasons", f"WITH RECURSIVE {_sql_compounds()} SELECT n, reason, count(*) AS rows FROM z GROUP BY n, reason")
def c6_reasons(spark, d):
    return _compounds(spark, d).groupBy("n", F.col("drawn.reason").alias("reason")).agg(F.count("*").alias("rows"))


# Picks whose accepts feed back

BATCHES = 4
_NAME = "CASE WHEN regexp_matches(w, '[0-9]') THEN 'NUMBER' WHEN length(w) < 4 THEN 'SHORT' WHEN length(w) < 8 THEN 'MIDDLE' ELSE 'LONG' END"


def _word_proposals(spark, d):
    """(k, batch, family, t_type, out_text): for each word of a turn a proposal to rewrite it, of a family by its form."""
    c = B.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), (F.col("conv_id") % BATCHES).cast("int").alias("batch"), F.posexplode(T.words(F.lower("text"))).alias("i", "w"))
    family = F.when(F.col("w").rlike("[0-9]"), "NUMBER").when(F.length("w") < 4, "SHORT").when(F.length("w") < 8, "MIDDLE").otherwise("LONG")
    return c.select("k", "batch", family.alias("family"), F.concat(family, F.lit(":"), F.length("w")).alias("t_type"), F.concat("i", F.lit(":"), "w").alias("out_text"))


def _accepted():
    return (F.length("out_text") + F.col("k")) % 3 != 0


def _sql_picks() -> str:
    """Batch after batch, each with the accepts of the earlier ones."""
    u = lambda *c: sql_text_uniform("'3'", "k", *c)
    steps = [f"pr AS MATERIALIZED (SELECT k, batch, family, family || ':' || length(w) AS t_type, i || ':' || w AS out_text FROM (SELECT k, batch, i, w, {_NAME} AS family FROM (SELECT conv_id * 1000 + turn AS k, conv_id % {BATCHES} AS batch, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM (SELECT *, {B.SQL_WORDS.format('lower(text)')} AS w FROM conversations))))"]
    for b in range(BATCHES):
        before = " UNION ALL ".join(f"SELECT family FROM pick{x} WHERE (length(out_text) + k) % 3 <> 0" for x in range(b))
        weight = f"(1.0::DOUBLE / (1 + coalesce((SELECT count(*) FROM ({before}) z WHERE z.family = o.family), 0)))" if b else "1.0::DOUBLE"
        steps.append(f"w{b} AS MATERIALIZED (SELECT family, {weight} AS w FROM (SELECT DISTINCT family FROM pr) o)")
        steps.append(f"pick{b} AS MATERIALIZED (SELECT k, family, t_type, out_text FROM pr JOIN w{b} USING (family) WHERE batch = {b} QUALIFY row_number() OVER (PARTITION BY k ORDER BY -ln({u('family')}) / w, family, {u('family', 't_type')}, t_type, {u('family', 't_type', 'out_text')}, out_text) = 1)")
    return "WITH " + ",\n".join(steps) + "\n" + " UNION ALL ".join(f"SELECT k, family, t_type, out_text FROM pick{b}" for b in range(BATCHES))


@query("c14_m8_weighted_picks", _sql_picks())
def c14_m8_weighted_picks(spark, d):
    return G.adaptive_picks(_word_proposals(spark, d), "k", _accepted(), "batch", BATCHES)


# Minimal subsets

_SQL_STRONGEST = f"(SELECT row, list(f ORDER BY m DESC, f) AS fs, list(m ORDER BY m DESC, f) AS ms FROM (SELECT row, f, CAST(round(v * 1000000) AS BIGINT) AS m FROM {B.SQL_ACTIVATIONS}) GROUP BY row)"
_SQL_WORKS = "10 * list_sum(list_transform({0}, lambda x: ms[x + 1])) >= 7 * list_sum(ms) AND len(list_filter({0}, lambda x: fs[x + 1] % 3 = 0)) > 0"


@query("k10_minimal_subsets", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM {_SQL_STRONGEST}),
w AS (SELECT row, fs, ms, len(list_filter(fs, lambda f: f % 3 = 0)) > 0 AS whole FROM t),
p AS MATERIALIZED (SELECT row, fs, ms, len(fs) AS n_full, CASE WHEN whole THEN list_filter(range(1, len(fs) + 1), lambda n: {_SQL_WORKS.format('range(n)')})[1] END AS prefix FROM w),
s AS (SELECT row, range(prefix) AS kept, prefix - 1 AS nxt FROM p WHERE prefix IS NOT NULL
UNION ALL SELECT row, CASE WHEN len(kept) > 1 AND ({_SQL_WORKS.format('trial')}) THEN trial ELSE kept END, nxt - 1 FROM (SELECT s.*, fs, ms, list_filter(kept, lambda x: x <> nxt) AS trial FROM s JOIN p USING (row) WHERE nxt >= 0))
SELECT p.row, CAST(n_full AS INTEGER) AS n_full, CAST(prefix AS INTEGER) AS prefix, array_to_string(list_transform(kept, lambda x: fs[x + 1]), ',') AS kept FROM p LEFT JOIN s ON s.row = p.row AND s.nxt < 0""")
def k10_minimal_subsets(spark, d):
    """The strongest activations of each vector that hold seven tenths of its mass and a feature divisible by three."""
    a = B.activations(spark, d).select("row", F.col("f"), F.round(F.col("v") * 1_000_000).cast("long").alias("m"))
    rows = a.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "f"))).alias("entries"))
    mass = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda s, x: s - F.get("entries", x)["m"])
    total = F.aggregate("entries", F.lit(0).cast("long"), lambda s, x: s - x["m"])
    third = F.exists("chosen", lambda x: F.get("entries", x)["f"] % 3 == 0)
    found = D.minimal_subsets(rows, "entries", lambda t: t.withColumn("works", (10 * mass(F.col("chosen")) >= 7 * total) & third), materialise)
    return found.select("row", "n_full", "prefix", F.array_join(F.transform("kept", lambda x: F.get("entries", x)["f"]), ",").alias("kept"))


# Small ones that stand alone

@query("x9_lower_tokens", f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {B.SQL_WORDS.format('lower(text)')} AS w FROM documents)")
def x9_lower_tokens(spark, d):
    t = B.documents(spark, d).select("doc_id", T.words(F.lower("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("v26_sparse_and_dense", "SELECT vec_id, len(list_filter(e, lambda x: x > 0.1)) AS entries, list_transform(e, lambda x: CASE WHEN x > 0.1 THEN CAST(x AS DOUBLE) ELSE 0.0 END) AS back FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def v26_sparse_and_dense(spark, d):
    """Dense to sparse above a threshold and back."""
    e = B.table(spark, d, "embeddings").select("vec_id", V.sparse(V.jump_relu(F.transform("embedding", lambda x: x.cast("double")), 0.1)).alias("m"))
    return e.select("vec_id", F.size("m").cast("long").alias("entries"), V.dense(F.col("m"), 64).alias("back"))


@query("v18_lens_bias", """WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CASE WHEN label = 0 THEN 2.0 ELSE CAST(embedding[2] AS DOUBLE) END AS y FROM embeddings)
SELECT vec_id, round(0.5 * (x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS bias, CASE WHEN label = 0 THEN NULL ELSE round(0.5 * (y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) END AS flat FROM p WINDOW w AS (PARTITION BY label)""")
def v18_lens_bias(spark, d):
    """Two projections standardised within each label; one label's second projection does not vary."""
    e = B.table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", 0).cast("double").alias("x"), F.when(F.col("label") == 0, 2.0).otherwise(F.get("embedding", 1).cast("double")).alias("y"))
    moments = e.groupBy("label").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    c = F.col
    return e.join(moments, "label").select("vec_id", F.round(V.lens_bias(c("x"), c("mx"), c("sx"), 0.5), 6).alias("bias"), F.round(V.lens_bias(c("y"), c("my"), c("sy"), 0.5), 6).alias("flat"))


@query("w7_running_position", "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS position FROM conversations")
def w7_running_position(spark, d):
    """Place of each long turn among the long turns of its conversation."""
    from pyspark.sql.window import Window

    long_ = F.when(F.length("text") > 200, 1)
    before = F.count(long_).over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.when(long_.isNotNull(), before).alias("position"))


@query("k6_fixpoint", "WITH RECURSIVE r AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS x FROM part UNION ALL SELECT p_partkey, CASE WHEN x % 2 = 0 THEN x // 2 ELSE x // 3 END FROM r WHERE x > 7) SELECT p_partkey, min(x) AS x FROM r GROUP BY p_partkey")
def k6_fixpoint(spark, d):
    """Numbers halved or cut to a third until none is above seven; as many rounds as the largest needs."""
    p = B.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("long").alias("x"))
    smaller = F.when(F.col("x") <= 7, F.col("x")).when(F.col("x") % 2 == 0, F.floor(F.col("x") / 2)).otherwise(F.floor(F.col("x") / 3))
    return D.to_fixpoint(p, lambda df: df.withColumn("x", smaller), 64, materialise)
