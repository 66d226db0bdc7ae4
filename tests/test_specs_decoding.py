import pytest
from pyspark.sql import functions as F

from pairloom.functions import specs as P
from pairloom.operators import alignment as A
from pairloom.operators import compound as C
from pairloom.operators import decoding as D


def test_grammars():
    assert P.FeatureSpec.parse("+1234") == P.FeatureSpec(1234, "+") and P.FeatureSpec.parse("-5678").sign == "-"
    with pytest.raises(ValueError):
        P.FeatureSpec.parse("12")
    specs = [P.CountSpec.parse(x) for x in ("4", "1-4", "log:1-32")]
    assert [(s.mode, s.low, s.high) for s in specs] == [("uniform", 4, 4), ("uniform", 1, 4), ("log", 1, 32)]
    assert P.SystemRef.parse("a=x/y.jsonl:raw") == P.SystemRef("a", "x/y.jsonl", "raw") and P.SystemRef.parse("a=p,m,empty").condition == "empty"
    assert P.parse_sweep("k1=a:k4=b") == {"k1": "a", "k4": "b"} and P.parse_grid("1,2.5") == [1.0, 2.5]
    assert P.DecodeSpec.parse("thr0.1@cfg2@temp0.7") == P.DecodeSpec("thr", 0.1, 2.0, 0.7)
    with pytest.raises(ValueError):
        P.DecodeSpec.parse("thr")


def test_smallest_prefix():
    need = {3, 6}
    assert D.smallest_prefix([1, 3, 5, 6, 8], lambda s: need <= set(s)) == [3, 6]
    assert D.smallest_prefix([1], lambda s: need <= set(s)) == []


def test_fixpoint(spark):
    df = spark.createDataFrame([(1, 5), (2, 0)], "k int, n int")
    keep = lambda x: spark.createDataFrame(x.collect(), x.schema)
    out = D.to_fixpoint(df, lambda x: x.withColumn("n", F.greatest(F.col("n") - 1, F.lit(0))), 10, keep)
    assert {r.n for r in out.collect()} == {0}


def test_operation_kind(spark):
    r = spark.range(1).select(D.operation_kind(F.lit(0.9), F.lit(0.1), F.lit(0.2)), D.operation_kind(F.lit(0.1), F.lit(0.8), F.lit(0.2)), D.operation_kind(F.lit(0.1), F.lit(0.2), F.lit(0.3))).first()
    assert list(r) == ["DEL", "INS", "SUB"]


def _op(kind, ws, we, payload=None):
    return F.struct(F.lit(kind).alias("op"), F.lit(ws).alias("ws"), F.lit(we).alias("we"), F.lit(payload).cast("string").alias("payload"))


def test_conflicts(spark):
    cases = [(_op("repl", 1, 2, "a"), _op("repl", 1, 2, "b"), True), (_op("repl", 1, 2, "a"), _op("repl", 2, 3, "b"), False), (_op("ins", 1, 3), _op("repl", 3, 4, "b"), True), (_op("ins", 1, 3), _op("del", 3, 3, "b"), True), (_op("del", 2, 2, "a"), _op("del", 2, 2, "b"), True), (_op("del", 2, 2, "a"), _op("ins", 0, 2), True), (_op("del", 4, 4, "a"), _op("ins", 0, 2), False)]
    assert list(spark.range(1).select(*(C.conflicts(a, b) for a, b, _ in cases)).first()) == [c for *_, c in cases]


def test_compound(spark):
    df = spark.createDataFrame([("one two three four five six",)], "t string").withColumn("w", A.words_with_offsets(F.col("t")))
    ops = F.array(_op("del", 4, 4, "very"), _op("repl", 0, 1, "uno"), _op("ins", 2, 3))
    df = df.withColumn("o", ops).withColumn("m", C.apply_compound(F.col("t"), F.col("w"), F.col("o"))).withColumn("xw", A.words_with_offsets(F.col("m.text")))
    df = df.withColumn("r", C.token_ranges(F.col("w"), F.col("o"), F.col("m.places"), F.col("w"), F.col("xw")))
    ids = lambda c: F.transform(c, lambda x: F.crc32(x["w"].cast("binary")))
    g = C.compound_gold(F.col("r"), ids(F.col("w")), ids(F.col("xw")), -1, -2, -3)
    r = df.select("m", "r", g.alias("g"), C.rebase(F.col("t"), F.col("w"), F.col("o"), F.array(F.lit(0), F.lit(2))).alias("b")).first()
    assert r.m.text == "uno two four very five six" and r.m.places == [13, 0, 8]
    assert [(x.xs, x.xe, x.ps, x.pe, x.gap) for x in r.r] == [(None, None, 3, 4, None), (0, 1, 0, 1, None), (2, 3, None, None, 2)]
    assert r.g.tags == [1, 0, 2, 3, 0, 0] and r.g.input[0] == -1 and r.g.input[2] == -2
    assert r.b.text == "uno two three four five six"


def test_compound_steps_are_planned_once(spark, tmp_path):
    """Sentences too short for ten words do not reach the word function, and gold arrays are made in one pass over the tokens."""
    from pairloom.plans.compound_queries import e23_t12_training_arrays

    words = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, "en", "s", f"Too short. {words}. {words.replace(' ', chr(160))}.")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = e23_t12_training_arrays(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_gold(") < plan.index("_words_with_offsets(") < plan.index("(?U)[")
    assert [(r.pos, r.edits, r.n_template) for r in found.collect()][:1] == [(1, 3, 13)]
    assert C.gold_row([{"op": "ins", "xs": 0, "xe": 1, "ps": None, "pe": None, "gap": 0}, {"op": "repl", "xs": 1, "xe": 2, "ps": 0, "pe": 1, "gap": None}], [1, 2], [3], -1, -2, -3) is None


def test_fill_modes():
    import pytest

    from pairloom.functions.specs import FillMode

    assert FillMode.parse("parallel") == FillMode("parallel", 1) and FillMode.parse("cmlm8") == FillMode("cmlm", 8) and FillMode.parse("seq-conf").mode == "seq-conf"
    for text in ("cmlm", "cmlm0", "parallel3", "other"):
        with pytest.raises(ValueError, match="fill mode"):
            FillMode.parse(text)


def test_token_distance_against_a_table(spark):
    import random

    rng = random.Random(1)
    rows = [([rng.choice(["a", "bb", "é", "日本", ""]) for _ in range(rng.randint(0, 12))], [rng.choice(["a", "bb", "é", "x"]) for _ in range(rng.randint(0, 12))]) for _ in range(200)]
    rows += [([f"w{k}" for k in range(1500)], [f"w{k}" for k in range(3, 1503)]), (None, ["a"])]

    def plain(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return line[-1]

    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<string>, b array<string>")
    got = {r.k: r.d for r in df.select("k", A.token_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {k: None if a is None else plain(a, b) for k, (a, b) in enumerate(rows)}


def test_swapped_ids(spark):
    from pairloom.operators import generation as G

    df = spark.createDataFrame([(k, list(range(10)), list(range(5, 5 + k))) for k in range(12)], "k int, own array<int>, other array<int>")
    for r in df.select("k", "own", "other", G.swapped_ids(F.col("own"), F.col("other"), F.col("k")).alias("s")).collect():
        new = set(r.other) - set(r.own)
        gone = set(r.own) - set(r.s)
        assert len(set(r.s)) == 10 and set(r.s) - set(r.own) <= new and len(gone) == min(5, len(new))


def test_quota_is_summed_from_the_strongest_rate_on(spark):
    values = [0.61, 0.57, 0.12, 0.7]  # 2 from the strongest on, a little less in this order
    added = lambda rates: 0.0 + rates[0] + rates[1] + rates[2] + rates[3]
    assert added(sorted(values, reverse=True)) == 2 > added(values)
    rates = spark.createDataFrame([(u, p, "x", r) for u in range(50) for p, r in enumerate(values)], "u int, pos int, kind string, rate double")
    chosen = D.choose_operations(rates, "u", step=1.0).groupBy("u").count().collect()
    assert len(chosen) == 50 and {r["count"] for r in chosen} == {2}
