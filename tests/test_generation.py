"""Compound draws, weighted picks, minimal subsets, near pairs, shard orders against plain versions."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import decoding as D
from pairloom.operators import generation as G
from pairloom.operators import pairing as R
from pairloom.operators import proposing as N
from pairloom.sources.lineage import materialise
from pairloom.sources.readers import ShardOrder


def _draw(key, seed):
    step = lambda x: (x * 1103515245 + 12345) % 2**31
    return step(step((key + seed * 7919) % 2**31)) / 2**31


def _plain_compound(words, types, candidates, high, ranked, key, top):
    """The draw as a loop, operation after operation."""
    if len(words) < 3:
        return [], "too_short_sentence"
    pick = lambda items, u: items[min(int(u * len(items)), len(items) - 1)]
    fine = lambda w: any(c.isalpha() for c in w) and not w.startswith("##")
    claimed, ops = set(), []

    def replacement(k):
        free = [i for i in range(len(words)) if i not in claimed]
        for t in range(3) if free else ():
            i, q = pick(free, _draw(k * 64 + t, 21)), k * 64 + t
            found = [c for c in candidates[i] if fine(c) and c.lower() != words[i].lower() and len(c) <= max(20, 3 * len(words[i]))]
            if found:
                return ("repl", i, i + 1, pick(found[: max(1, top // 2)], _draw(q, 22)))
        return None

    def gap(k):
        spans = [(s, s + n) for s in range(1, len(words) - 1) for n in range(1, min(3, len(words) - s - 1) + 1) if not any(c in claimed for c in range(s, s + n + 1))]
        upper, lower = [x for x in spans if x[0] in high], [x for x in spans if x[0] not in high]
        pool = upper if _draw(k, 23) < 0.85 and upper else lower or upper
        return ("ins", *pick(pool, _draw(k, 24)), None) if pool else None

    def insertion(k):
        free = [i for i in range(1, len(words)) if i not in claimed]
        for t in range(3) if free else ():
            q = k * 64 + t
            i, wanted, last, grown = pick(free, _draw(q, 25)), 1 + min(int(_draw(q, 26) * 3), 2), None, []
            last = words[i - 1]
            for step in range(1, wanted + 1):
                found = [c for c in ranked.get(last, []) if fine(c)]
                if not found:
                    break
                last = found[0] if _draw(q * 16 + step, 27) < 0.5 else pick(found[: max(1, top // 2)], _draw(q * 16 + step, 28))
                grown.append(last)
            if grown:
                return ("del", i, i, " ".join(grown))
        return None

    for n, t in enumerate(types):
        op = {"REPL": replacement, "INS": gap, "DEL": insertion}[t](key * 8 + n)
        if op is None:
            return [], "ops_unsuitable"
        claimed |= set(range(op[1], op[2] + 1)) if op[0] == "ins" else {op[1]}
        ops.append(op)
    return ops, None


def test_compound_draws_equal_a_loop(spark):
    rng = random.Random(5)
    vocabulary = ["one", "two", "three", "four", "x", "##y", "12", "Green", "extraordinarily"]
    rows = []
    for k in range(250):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        ranked = {w: [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))] for w in set(words) | set(vocabulary)}
        rows.append((k, words, [rng.choice(["REPL", "INS", "DEL"]) for _ in range(rng.randint(0, 5))], [[rng.choice(vocabulary) for _ in range(rng.randint(0, 4))] for _ in words], [i for i in range(len(words)) if rng.random() < 0.4], ranked))
    df = spark.createDataFrame(rows, "k long, words array<string>, types array<string>, candidates array<array<string>>, high array<int>, ranked map<string,array<string>>")
    c = F.col
    got = {r.k: ([tuple(o) for o in r.d.ops], r.d.reason) for r in df.select("k", N.compound_draw(c("words"), c("types"), c("candidates"), c("high"), c("ranked"), c("k"), top=4).alias("d")).collect()}
    want = {k: _plain_compound(w, t, cs, set(h), r, k, 4) for k, w, t, cs, h, r in rows}
    assert got == want
    assert {r for _, r in want.values()} == {None, "too_short_sentence", "ops_unsuitable"} and any(len(o) > 2 for o, _ in want.values())
    for k, (ops, _) in got.items():  # no two operations touch a place
        places = [p for kind, s, e, _ in ops for p in range(s, e + 1 if kind == "ins" else s + 1)]
        assert len(places) == len(set(places)), k


# Picks that feed back


def _uniform(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def _plain_picks(batches, accepted):
    accepts, out = Counter(), {}
    for rows in batches:
        found = {}
        for k, f, t, o in rows:
            found.setdefault(k, set()).add((f, t, o))
        picked = {k: min(ps, key=lambda p, k=k: (-math.log(_uniform(3, k, p[0])) * (1 + accepts[p[0]]), p[0], _uniform(3, k, *p[:2]), p[1], _uniform(3, k, *p), p[2])) for k, ps in found.items()}
        accepts += Counter(p[0] for k, p in picked.items() if accepted(k, p))
        out |= picked
    return out


def _proposals(seed):
    rng = random.Random(seed)
    made = lambda k: [(k, f, f"{f}:{rng.randint(0, 2)}", f"{rng.randint(0, 4)}") for f in rng.sample("ABCDE", rng.randint(1, 4)) for _ in range(rng.randint(1, 3))]
    return [[p for k in range(60) for p in made(100 * b + k)] for b in range(4)]


def test_weighted_picks_in_batches_equal_a_loop(spark):
    batches = _proposals(1)
    df = spark.createDataFrame([(*p, b) for b, rows in enumerate(batches) for p in rows], "k long, family string, t_type string, out_text string, batch int")
    ok = (F.col("k") + F.length("family")) % 3 != 0
    got = {r.k: (r.family, r.t_type, r.out_text) for r in G.adaptive_picks(df, "k", ok, "batch", 4).collect()}
    want = _plain_picks(batches, lambda k, p: (k + len(p[0])) % 3 != 0)
    assert got == want
    assert got != {k: p for rows in batches for k, p in _plain_picks([rows], lambda k, p: True).items()}  # the weights matter


def test_weighted_picks_in_a_stream_equal_a_loop(spark, tmp_path):
    from pairloom.streaming import streams as M

    schema = "k long, family string, t_type string, out_text string"
    batches = _proposals(2)
    source = str(tmp_path / "in")
    ok = F.col("k") % 4 != 0
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = M.file_stream(spark, source, schema)
        M.pick_by_priority(stream, str(tmp_path / "out"), "k", ok, str(tmp_path / "checkpoint")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "picks")).count() == 60 * (b + 1)
    got = {r.k: (r.family, r.t_type, r.out_text) for r in spark.read.parquet(str(tmp_path / "out" / "picks")).collect()}
    assert got == _plain_picks(batches, lambda k, p: k % 4 != 0)


def test_priority_of_unknown_families(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "family string").select("family", G.priority({"a": 3}).alias("w"))
    assert {r.family: r.w for r in df.collect()} == {"a": 0.25, "b": 1.0, None: 1.0}


# Minimal subsets


def _plain_subset(items, works):
    if not items or not works(items):
        return None, None
    prefix = next(n for n in range(1, len(items) + 1) if works(items[:n])) if True else 0
    low, high = 1, len(items)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if works(items[:mid]) else (mid + 1, high)
    kept = list(range(high))
    for place in reversed(range(high)):
        if len(kept) == 1:
            break
        rest = [p for p in kept if p != place]
        if works([items[p] for p in rest]):
            kept = rest
    assert prefix <= high
    return high, kept


def test_minimal_subsets_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randint(1, 9) for _ in range(rng.randint(0, 12))]) for k in range(120)] + [(500, None), (501, []), (502, [9])]
    calls = []

    def works(df):
        calls.append(1)
        chosen = F.transform("chosen", lambda p: F.get("items", p))
        return df.withColumn("works", (F.aggregate(chosen, F.lit(0), lambda s, x: s + x) >= 15) & F.exists(chosen, lambda x: x % 2 == 0))

    df = spark.createDataFrame(rows, "k int, items array<int>")
    got = {r.k: (r.prefix, r.kept) for r in D.minimal_subsets(df, "items", works, materialise).collect()}
    want = {k: _plain_subset(items or [], lambda x: sum(x) >= 15 and any(v % 2 == 0 for v in x)) for k, items in rows}
    assert got == want and any(kept and len(kept) < high for high, kept in want.values())
    assert len(calls) <= 1 + 4 + 12  # rounds do not grow with the rows
    with pytest.raises(ValueError, match="rounds"):
        D.minimal_subsets(df, "items", works, materialise, rounds=2)
    assert D.minimal_subsets(df.limit(0), "items", works, materialise).count() == 0


# Near pairs


def test_near_pairs_are_linear_in_a_group_and_hold_for_parts(spark):
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge".split()
    texts = [" ".join([*base[:k], f"w{k}", *base[k + 1 :]]) for k in range(len(base))] + [" ".join(base)] * 5 + ["short one", "something else entirely that is far from all the others here", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    pairs = R.near_pairs(df, "t", ["id"]).collect()
    assert 10 <= len(pairs) <= 4 * len(base)  # each key gives a pair fewer than it has texts
    known = {t: k for k, t in reversed(list(enumerate(texts)))}
    assert all(known[p.source_text] == p.id and known[p.target_text] == p.other_id and p.source_text != p.target_text for p in pairs)
    assert {p.id for p in pairs} | {p.other_id for p in pairs} >= set(range(len(base) - 1))
    parts = R.near_pairs(df, "t", ["id"], together=4).collect()
    assert 0 < len(parts) <= 4 * len(base) and all(p.source_text != p.target_text for p in parts)
    assert R.near_pairs(df.limit(0), "t", ["id"]).count() == 0


# Shard orders


@pytest.mark.parametrize("n", [1, 2, 7, 60, 1009])
def test_shard_orders_are_permutations(spark, n):
    order = ShardOrder(n, seed=5)
    rows = spark.range(n).select("id", *(order.position(F.col("id"), e).alias(f"p{e}") for e in range(3))).select("*", order.index(F.col("p1"), 1).alias("back")).collect()
    for e in range(3):
        assert sorted(r[f"p{e}"] for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    read = [[r["index"] for r in order.steps(spark, 1, w, 3).orderBy("step").collect()] for w in range(3)]
    assert sorted(sum(read, [])) == list(range(n))
    assert [r["index"] for r in order.steps(spark, 1, 1, 3, first=2).orderBy("step").collect()] == read[1][2:]
    with pytest.raises(ValueError):
        ShardOrder(0)


def test_near_pairs_of_a_large_group_are_those_of_its_whole_order(spark):
    texts = [f"common start of each text w{k * 7919 % 3000} w{k}" for k in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    found = lambda together: {(p.id, p.other_id) for p in R.near_pairs(df, "t", ["id"], least=0.0, together=together).collect()}
    whole = found(10**6)
    assert len(whole) >= 2000 and found(100) == whole
