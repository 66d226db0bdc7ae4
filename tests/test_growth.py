"""What steps send and compare must not grow faster than their input."""

import pyspark.sql.functions as F

from pairloom.operators import relational as J
from pairloom.operators import sampling as S


def test_place_among_bounds_compares_few(spark):
    bounds = [F.lit(2 * i) for i in range(100)]
    rows = spark.range(-3, 203).select("id", S._place(bounds, F.col("id")).alias("n"))
    assert all(r.n == min(max(r.id // 2 + 1, 0), 100) for r in rows.collect())
    assert "slice" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert spark.range(5).select(S._place([F.lit(2)], F.col("id")).alias("n")).agg(F.sum("n")).first()[0] == 3


def test_overlaps_sends_no_spans_outside_all_ranges(spark):
    spans = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("cs"), (F.col("id") + 1).alias("ce"))
    ranges = spark.createDataFrame([(0, 5, 9), (1, 4, 6), (1, 900, 900), (2, 6, 8)], "k long, cs long, ce long")
    found = J.overlaps(spans, ranges, "k")
    assert sorted((r.k, r.cs) for r in found.select("k", spans["cs"]).collect()) == [(0, 6), (1, 4)] and "BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert J.overlaps(spans, ranges.where("k > 5"), "k").count() == 0


def test_retrieve_in_blocks_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "CELLS", 10)
    rows = [(i, i % 2, {f: float((i * 7 + f * 3) % 5 + 1) for f in range(6) if (i + f) % 3}) for i in range(40)] + [(40, 0, {}), (41, None, {1: 1.0})]
    df = spark.createDataFrame(rows, "row long, grp int, m map<int,double>")
    queries = df.where("row % 5 = 0").select(F.col("row").alias("qid"), "grp", F.col("m").alias("g"))
    pool = df.where("row % 5 <> 0").select(F.col("row").alias("pid"), "grp", "m", F.col("m").alias("delta"))
    want = set()
    for q, grp, g in rows:
        if q % 5 or grp is None:
            continue
        scored = sorted((-round(sum(g[f] * m[f] for f in g if f in m) / sum(v * v for v in m.values()) ** 0.5, 9), p, m) for p, other, m in rows if p % 5 and other == grp and g.keys() & m.keys())[:3]
        want |= {(q, f, round(sum(m.get(f, 0.0) for *_, m in scored) / len(scored), 6)) for f in {f for *_, m in scored for f in m}}
    assert {(r.qid, r.f, round(r.value, 6)) for r in J.retrieve(queries, pool, "grp", 3).collect()} == want
    monkeypatch.setattr(J, "CELLS", 4_000_000)
    assert J._projections(queries, pool, "grp", 3).where("qid = 0").count() <= 3 * 4  # the best of each block, of 16 rows


def test_parts_and_shares_have_tasks_of_their_own(spark, monkeypatch):
    import numpy as np

    from pairloom.operators import blocked
    from pairloom.operators import features as X

    monkeypatch.setattr(blocked, "PASSING", 8)
    vectors = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(32)] + [(3, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "k long, v array<double>")
    x = np.array([v for _, v in vectors])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    other = np.array([[a != b for b, _ in vectors] for a, _ in vectors])
    found = X.uniformity(df, "v", "k").first()
    assert found.pairs == other.sum() // 2 and abs(found.uniformity - np.log(np.exp(-2 * ((x[:, None] - x[None]) ** 2).sum(-1))[other].mean())) < 1e-9
    units = blocked.every_pair(df, "k", "v", lambda *a: [np.array([0.0]), np.array([0])], __import__("pyarrow").schema([("total", "float64"), ("pairs", "int64")]))
    assert "RepartitionById" in units._jdf.queryExecution().toString() or "REPARTITION" in units._jdf.queryExecution().executedPlan().toString().upper()
    assert units.count() >= 5  # at least a call for each share of a part


def test_threshold_choice_without_a_join(spark):
    from pairloom.operators import evaluation as E

    rows = [(1, 1, 0.01, 1.0), (1, 2, 0.06, 3.0), (1, 2, 0.0, 5.0), (2, 1, None, 7.0), (2, 4, 0.01, 9.0), (None, 1, 0.9, 50.0)]
    df = spark.createDataFrame(rows, "key int, k int, gain double, v double")
    found = E.threshold_choice(df, "key", "k", "gain", ["v"], [0.005, 0.05])
    assert {(r.tau, r.v, r.mean_k) for r in found.collect()} == {(0.005, 5.0, 2.5), (0.05, 17 / 3, 8 / 3)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_opcodes_and_moves_hold_no_objects_of_a_whole_batch(spark):
    import random
    import tracemalloc

    import pyarrow as pa

    from pairloom.operators import alignment as A

    rng = random.Random(4)
    words = [[rng.randint(0, 9) for _ in range(100)] for _ in range(400)]
    source, target = pa.array([*words, None], pa.list_(pa.int64())), pa.array([*words[1:], words[0], [1]], pa.list_(pa.int64()))
    tracemalloc.start()
    try:
        made = A._opcodes.func(source, target)
        assert tracemalloc.get_traced_memory()[1] < 4e6 and made[-1].as_py() is None
        slots = [[(k, A.DEL if (k // 3) % 2 else A.INS, x) for k, x in enumerate(row)] for row in words]
        kinds = lambda row, kind: [{"start": row[k][0], "content": [x for *_, x in row[k : k + 3]]} for k in range(0, 99, 3) if row[k][1] == kind]
        ops_type = pa.list_(pa.struct([("slot", pa.int32()), ("kind", pa.int32()), ("tgt", pa.int64())]))
        run_type = pa.list_(pa.struct([("start", pa.int32()), ("content", pa.list_(pa.int64()))]))
        ops = pa.array([[{"slot": k, "kind": kind, "tgt": x if kind == A.INS else None} for k, kind, x in row[:99]] for row in slots] + [None], ops_type)
        gone, new = (pa.array([kinds(row, kind) for row in slots] + [None], run_type) for kind in (A.DEL, A.INS))
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        moved = A.with_moves.func(ops, gone, new, pa.array([*words, None], pa.list_(pa.int64())))
        assert tracemalloc.get_traced_memory()[1] - before < 8e6
    finally:
        tracemalloc.stop()
    assert moved[-1].as_py() is None
    for row, d, i, own, out in zip(ops.to_pylist()[:-1], gone.to_pylist(), new.to_pylist(), words, moved.to_pylist(), strict=False):
        to, free = {}, [(r["start"], r["content"]) for r in i]
        for r in d:  # all runs are of one length
            hit = next((f for f in free if f[1] == r["content"]), None)
            if hit:
                free.remove(hit)
                to |= {r["start"] + x: hit[0] + x for x in range(3)}
        want = [{"slot": o["slot"], "kind": A.MOV, "tgt": own[o["slot"]], "dst": to[o["slot"]]} if o["slot"] in to else {**o, "dst": None} for o in row if o["slot"] not in to.values()]
        assert out == want
    assert any(o["kind"] == A.MOV for row in moved.to_pylist()[:-1] for o in row)


def test_rewrites_are_dealt_evenly(spark):
    from pairloom.operators import generation as G

    texts = spark.range(400, numPartitions=1).select("id", F.lit("They do not sing every song here.").alias("text"))
    found = G.proposals(texts, "text", ["CONTRACT", "DETQUANT"])
    for df in (found, G.composed(found, "id", "text"), G.round_trips(found, "id", "text")):
        parts = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count_distinct("id").alias("n")).collect()]
        assert sum(parts) == 400 and len(parts) == 4 and max(parts) < 150


def test_states_make_what_landed_once_and_marks_as_before(spark):
    """Of a pair of 3,000 words every second one is replaced; what landed is not made again for each slot."""
    import random
    import time

    import pyarrow as pa

    from pairloom.operators import alignment as A

    n = 3000
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.cast("long").alias("a0"), (k + k % 2).cast("long").alias("a1")))
    ops = F.transform(A.slot_operations(F.col("slots")), lambda o: F.struct(o["slot"].alias("slot"), o["kind"].alias("kind"), o["tgt"].alias("tgt"), F.lit(None).cast("int").alias("dst")))
    df = spark.range(4, numPartitions=1).withColumn("slots", slots).withColumn("o", ops).withColumn("fired", F.transform("o", lambda o: o["slot"] % 4 == 1))
    begun = time.time()
    state = df.select(A.state_tokens(F.col("slots"), A.landed(F.col("o"), F.col("fired"))).alias("s")).collect()
    assert all(r.s == [k + (k % 4 == 1) for k in range(n)] for r in state) and time.time() - begun < 12

    rng = random.Random(8)
    states, rows, fired = [], [], []
    for _ in range(300):
        size = rng.randint(1, 9)
        states.append([rng.choice((None, 5)) for _ in range(size)])
        chosen = sorted(rng.sample(range(size), rng.randint(0, size)))
        rows.append([{"slot": k, "kind": (kind := rng.randint(0, 3)), "tgt": rng.choice((None, 7)), "dst": rng.randrange(size) if kind == A.MOV else None} for k in chosen])
        fired.append([rng.random() < 0.5 for _ in chosen])
    given = pa.array([*states, None]), pa.array([*rows, None], pa.list_(pa.struct([("slot", pa.int32()), ("kind", pa.int32()), ("tgt", pa.int64()), ("dst", pa.int32())]))), pa.array([*fired, None])
    marks, todo = A.edit_marks.func(*given).to_pylist(), A.pending.func(*given).to_pylist()
    assert marks.pop() is None and todo.pop() is None
    for tokens, all_ops, done, mark, left in zip(states, rows, fired, marks, todo, strict=True):
        before = lambda slot: sum(x is not None for x in tokens[:slot])  # noqa: B023, E731
        want, anchors, want_left = set(), set(), []
        for number, (o, f) in enumerate(zip(all_ops, done, strict=True)):
            here, there = before(o["slot"]), before(o["dst"]) - 1 if o["kind"] == A.MOV else None
            if f:
                want |= {here - 1} if o["kind"] in (A.DEL, A.MOV) else set()
                want |= {there + 1 if o["kind"] == A.MOV else here} if o["kind"] != A.DEL else set()
                continue
            here -= o["kind"] == A.INS
            if o["kind"] == A.INS and (here < 0 or here in anchors) or there is not None and there < 0:
                continue
            anchors |= {here} if o["kind"] == A.INS else set()
            want_left.append({"kind": o["kind"], "pos": here, "tgt": o["tgt"], "op": number, "dst_pos": there})
        assert mark == sorted(m for m in want if m >= 0) and left == want_left


def test_stability_sends_counts_alone(spark):
    from pairloom.operators import features as X

    rows = [(g, f, row, row % 2 == g) for g in range(2) for row in range(60) for f in range(5) if (row * 7 + f * 3) % 4]
    entries = spark.createDataFrame(rows, "grp int, f int, row long, positive boolean")
    members = spark.createDataFrame([(g, row, row % 2 == g) for g in range(2) for row in range(60)], "grp int, row long, positive boolean")
    plain = X.split_half_stability(entries, members, 3, 2, once=True)
    assert "Expand" not in plain._jdf.queryExecution().executedPlan().toString()
    repeated = X.split_half_stability(entries.union(entries), members, 3, 2)
    assert sorted(plain.collect()) == sorted(repeated.collect()) and plain.count() == 6


def test_ragged_sends_runs_and_not_tokens(spark):
    from pairloom.sources import sinks

    words = [(d, p, f"w{p % 7}" if p % 5 else None, p / 2) for d in (3, 1, None) for p in range(400)]
    scattered = [(9, p, f"w{p}", 0.5) for p in (4, 2, 2, None)] + [(8, 1, "b", 1.0), (7, 1, "x", 1.0), (8, 0, "a", 2.0)]
    df = spark.createDataFrame([*words, *scattered], "d int, p int, w string, v double").coalesce(1)
    found = sinks.ragged(df, "d", "p", ["w", "v"])
    got = {r.d: (r.w, r.v) for r in found.collect()}
    for d in (3, 1, None):
        assert got[d] == ([w for k, _, w, _ in words if k == d], [v for k, _, _, v in words if k == d])
    assert got[9] == (["wNone", "w2", "w2", "w4"], [0.5] * 4) and got[8] == (["a", "b"], [2.0, 1.0]) and got[7] == (["x"], [1.0]) and len(got) == 6
    spread = {r.d: (r.w, r.v) for r in sinks.ragged(df.repartition(4, "p"), "d", "p", ["w", "v"]).collect()}
    assert spread == got  # runs of a document lie among each other
    runs = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
    assert "MapInArrow" in runs and "Aggregate" not in runs  # tokens are packed before they are sent
    batch = df.toArrow().combine_chunks().to_batches()[0]
    (made,) = sinks._runs([batch.rename_columns(["d", "_o", "_0", "_1"])])
    assert made.num_rows == 6 and made.column("_from").to_pylist()[:3] == [0, 0, 0] and made.column("_o").to_pylist()[:3] == [None] * 3


def test_group_means_are_spread_without_adding_up_all_rows(spark):
    from collections import defaultdict

    from pairloom.functions.hashing import uniform
    from pairloom.operators import generation as G

    rows = [(r, r % 3 if r % 7 else None, f, (r * 5 + f) % 11 / 4) for r in range(30) for f in range(8) if (r + f) % 3]
    odd = [(1, 1, 4, 0.5), (2, 0, 5, 1.0), (2, 2, 0, None), (3, 0, None, 2.0), (4, 5, 1, 1.0), (40, None, 1, 0.5), (40, None, 1, 0.75)]  # a feature twice, two groups, no feature, no size, no group
    sizes = {0: 10, 1: 9, 2: 30}
    frame = lambda r: G.group_mean_mix(spark.createDataFrame(r, "row long, grp int, f int, v double"), spark.createDataFrame([*sizes.items()], "grp int, n long"), "row", "grp")
    w = {r.id: 0.3 + 0.4 * r.u for r in spark.range(50).select("id", uniform(F.col("id"), 43).alias("u")).collect()}
    for given in (rows, rows + odd):
        means, want = defaultdict(float), defaultdict(float)
        for _, g, f, v in given:
            means[g, f] += (v or 0) / sizes.get(g, 1)
        for r, _, f, v in given:
            want[r, f] += w[r] * (v or 0)
        for r, g in {(r, g) for r, g, *_ in given if g in sizes}:
            for (h, f), m in means.items():
                if h == g:
                    want[r, f] += (1 - w[r]) * m
        found = frame(given)
        got = [(r.row, r.f, round(r.v, 9)) for r in found.collect()]
        assert len(got) == len(want) and {(r, f): v for r, f, v in got} == {k: round(v, 9) for k, v in want.items()}
    # what stands for a row of a group is made last: it is neither sent nor gathered
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_rows_of_a_frequent_token_stay_where_they_lie(spark, monkeypatch):
    from math import log

    from pairloom.operators import generation as G

    monkeypatch.setattr(G, "LIKELY", 16)
    rows = [(i % 50, "the" if i % 2 else f"w{i % 90}", -1.0 - i % 3) for i in range(2000)] + [(50, "never", -1.0), (50, None, -2.0), (51, "the", -3.0)]
    df = spark.createDataFrame(rows, "d long, token string, logp double").repartition(4)
    table = G.unigrams(df.where("token <> 'never'"))
    found = G.looked_up(df, table)
    held = [r.n for r in found.where("token = 'the'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 1001 and len(held) == 4 and max(held) < 300
    known = [t for _, t, _ in rows if t not in (None, "never")]
    below = len(known) + len(set(known)) + 1
    p = {t: log((known.count(t) + 1) / below) for t in set(known)}
    got = {r.d: (r.n, r.slor) for r in G.slor(df, table, "d").collect()}
    assert len(got) == 52 and got[51] == (1, None)
    for d in range(51):
        own = [(t, lp) for k, t, lp in rows if k == d]
        n, value = got[d]
        assert n == len(own) and abs(value - sum(lp - p.get(t, log(1 / below)) for t, lp in own) / n) < 1e-9
