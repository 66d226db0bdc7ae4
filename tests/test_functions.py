import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions import vectors as V
from pairloom.operators import evaluation as E
from pairloom.operators import generation as G
from pairloom.operators import relational as J
from pairloom.operators import sampling as S


def _one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_quality(spark):
    cases = [("* foo bar baz.", False), ("See http://x.y now.", False), ("Two words", False), ("A fine sentence here.", True), ("Été à la mer !", True), ("", False), (None, False), ("a b ----- c d.", False), ('He said "no more."', True)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "s string").select(T.ProseQuality()(F.col("s"))).collect()
    assert [r[0] for r in rows] == [c[1] for c in cases]


def test_equality_and_sari(spark):
    r = _one(spark, T.exact_casefold(F.lit("Straße  x "), F.lit("STRASSE X")), T.exact_spaces(F.lit("a  b"), F.lit("a b ")), T.exact_strip(F.lit(" a"), F.lit("a")), T.sari(F.lit("a b c"), F.lit("a b d"), F.lit("a b d")), T.jaccard(F.array(F.lit(1)), F.array(F.lit(2))))
    assert r.c0 and r.c1 and r.c2 and r.c3 == pytest.approx(100.0) and r.c4 == 0


def test_parsers(spark):
    r = _one(spark, T.parse_relation(F.lit("less, no: more")), T.parse_choice(F.lit("B) because")), T.parse_choice(F.lit("Some say A, so C")), T.parse_yes_no(F.lit("No way")), T.parse_rating(F.lit("Rating: [[2]]")), T.parse_rating(F.lit("Rating: 9")), T.first_line(F.lit('\n Output: "x y"\n'), F.lit("z")), T.first_line(F.lit(""), F.lit("z")))
    assert list(r) == ["MORE", "B", "C", 0, 2, None, "x y", "z"]


def test_published_statistics(spark):
    """Figures that the tests' definitions must give: McNemar on discordant counts and a Wilson interval."""
    p = [E.binomial_two_sided(F.lit(b), F.lit(b + c)) for b, c in ((205, 67), (54, 12), (155, 59), (0, 0))]
    r = _one(spark, *p, E.wilson(F.lit(704), F.lit(714)))
    assert r.c0 == pytest.approx(1.93e-17, rel=5e-3) and r.c1 == pytest.approx(1.69e-07, rel=5e-3) and r.c2 == pytest.approx(3.94e-11, rel=5e-3) and r.c3 == 1.0
    assert (round(r.c4.low, 3), round(r.c4.high, 3)) == (0.974, 0.992)


def test_effects(spark):
    r = _one(spark, V.effect(F.lit(0.5), F.lit(0.25), "abl"), V.effect(F.lit(0.5), F.lit(0.25), "enh"), V.penalised(F.lit(-0.4)), V.integrated_effect(F.lit(0.5), F.lit(0.5)))
    assert (r.c0, r.c1, r.c2, r.c3) == (0.5, pytest.approx(1 / 3), 0.2, 0.5)


def test_vectors(spark):
    a = F.create_map(F.lit(1), F.lit(3.0), F.lit(2), F.lit(1.0))
    b = F.create_map(F.lit(2), F.lit(4.0), F.lit(3), F.lit(1.0))
    r = _one(spark, V.l2_shift(a, b), V.intervention(a, b, 1), V.top_ids(F.create_map(F.lit(1), F.lit(1.0), F.lit(2), F.lit(1.0)), 1), V.dense(a, 4), V.top_change(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))))
    assert r.c0 == pytest.approx(19**0.5) and r.c1.amp == {2: 3.0} and r.c1.sup == {1: 3.0} and r.c2 == [2] and r.c3 == [0.0, 3.0, 1.0, 0.0] and r.c4 == 1


def test_buckets(spark):
    assert list(_one(spark, *(G.bucket_of(F.lit(n)) for n in (0, 1, 3, 4)))) == ["identity", "single_op", "compound_2_3", "compound_4_plus"]
    assert list(_one(spark, *(E.count_bucket(F.lit(n)) for n in (1, 2, 8, 9)))) == ["1", "2-3", "4-8", "9+"]


def test_empty_class_auroc(spark):
    df = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, True)], "g string, s double, p boolean")
    assert E.auroc(df, ["g"], "s", "p").first().auroc == 0.5


def test_sparse_auroc_equals_dense(spark):
    import random

    from pairloom.operators import features as X

    rng = random.Random(1)
    rows = [(0, i, f, max(0.0, round(rng.uniform(-1, 1), 1)), i % 3 == 0) for i in range(60) for f in range(4)]
    df = spark.createDataFrame(rows, "grp int, row int, f int, v double, positive boolean")
    dense = {r.f: r.auroc for r in E.auroc(df, ["f"], "v", "positive").collect()}
    sizes = spark.createDataFrame([(0, 20, 40)], "grp int, n_pos int, n_neg int")
    for r in X.sparse_auroc(df.where("v > 0"), sizes).collect():
        assert r.auroc == pytest.approx(dense[r.f])


def test_numbering_is_dense(spark):
    got = S.number_rows(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), "k").collect()
    assert all(r.idx == r.k for r in got) and len(got) == 1000


def test_numbering_by_ranges(spark):
    """Ranges follow from the rows: ties, nulls and text keys, and the same numbers each time."""
    rows = [(None if k % 50 == 0 else f"w{k * 37 % 300:03d}", k % 7, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a string, b int, k int").repartition(5)
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])))}
    for numbered in (100, 1000, 10_000):
        got = S.number_rows(df, "a", "b", "k", numbered=numbered, start=5)
        assert {r.k: r.idx - 5 for r in got.collect()} == want == {r.k: r.idx - 5 for r in got.collect()}


def test_nested_samples(spark):
    df = spark.range(500)
    small, large = ({r.id for r in S.shuffled_sample(df, n, F.col("id"), 3).collect()} for n in (20, 80))
    assert small < large


def test_rewrites_round_trip(spark):
    texts = ["It is hard to find gold.", "If she had money, we left.", '"Go," said Anna.', "They do not sing.", "We saw the old man, and they saw us."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = G.proposals(df, "text")
    assert {r.family for r in G.round_trips(found, "k", "text").collect()} == {"TOUGH", "INVERSION", "QUOTINV", "CONTRACT", "SPLITJOIN"}


def test_split_half_stability_against_a_plain_version(spark):
    from pairloom.operators.features import split_half_stability

    def half(key):
        x = key % 2**31
        for _ in range(2):
            x = (x * 1103515245 + 12345) % 2**31
        return 0 if x / 2**31 < 0.5 else 1

    # group "few" has too few positive rows; rows 40 to 44 have no entry
    members = [(g, row, row % 3 == 0 if g == "big" else row < 5) for g in ("big", "few") for row in range(45)]
    entries = [(g, f, row, positive) for g, row, positive in members for f in range(6) if row < 40 and (row * 7 + f * f) % (f + 2) == 0]
    repeats, r = 3, 2

    def scores(repeat, side):
        part = [(row, positive) for g, row, positive in members if g == "big" and half(row * (2 * repeat + 1)) == side]
        n_pos, n_neg = sum(p for _, p in part), max(1, sum(not p for _, p in part))
        out = {}
        for f in range(6):
            rows = {row: positive for g, x, row, positive in entries if g == "big" and x == f}
            pos, neg = sum(rows.get(row) is True for row, _ in part), sum(rows.get(row) is False for row, _ in part)
            ps, pn = (pos / n_pos if n_pos else 0), 1 - neg / n_neg
            if pos:
                out[f] = 2 * ps * pn / (ps + pn) if ps + pn else 0.0
        return out, sorted(out, key=lambda f: (-round(out[f], 9), f))[:r]

    expected = {}
    for repeat in range(repeats):
        (here, top), (there, other) = scores(repeat, 0), scores(repeat, 1)
        expected[repeat] = (sum(here[f] for f in top) / len(top), sum(there.get(f, 0.0) for f in top) / len(top), len(set(top) & set(other)) / r)
    out = split_half_stability(spark.createDataFrame(entries, "grp string, f int, row long, positive boolean"), spark.createDataFrame(members, "grp string, row long, positive boolean"), repeats, r).collect()
    assert {x["grp"] for x in out} == {"big"}
    assert {x["repeat"]: tuple(round(x[c], 9) for c in ("in_sample", "out_of_sample", "overlap")) for x in out} == {k: tuple(round(x, 9) for x in v) for k, v in expected.items()}


def test_mean_jaccard_in_blocks_makes_no_row_for_a_pair(spark, monkeypatch):
    sets = [(g, k, [(k * 7 + i * i) % 23 for i in range((k + g) % 6)]) for g in range(3) for k in range(40)] + [(9, 0, [1])]
    df = spark.createDataFrame(sets, "g int, k int, s array<int>")
    jaccard = lambda a, b: len(a & b) / len(a | b) if a & b else 0.0
    expected = {}
    for g in range(3):
        own = [set(s) for h, _, s in sets if h == g]
        values = [jaccard(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        expected[g] = sum(values) / len(values)
    for block in (7, 4096):
        made = J.mean_jaccard(df, "g", "k", "s", block=block)
        assert {r.g: r.mean_jaccard for r in made.collect()} == {**{g: pytest.approx(v) for g, v in expected.items()}, 9: None}
    monkeypatch.setattr(J, "set_pairs", None)  # no list of pairs
    assert J.mean_jaccard(df, "g", "k", "s").count() == 4


def test_set_pairs_in_blocks_send_no_row_for_a_common_item(spark):
    sets = [(g, k, [(k * 5 + i * i) % 19 for i in range((k + g) % 5)]) for g in range(2) for k in range(30)]
    df = spark.createDataFrame(sets, "g int, k int, s array<int>")
    expected = {(g, a, b): len(set(s) & set(t)) / len(set(s) | set(t)) for g, a, s in sets for h, b, t in sets if g == h and a < b and set(s) & set(t)}
    for block in (7, 4096):
        assert {(r.g, r.a, r.b): r.jaccard for r in J.set_pairs(df, "g", "k", "s", block=block).collect()} == expected
