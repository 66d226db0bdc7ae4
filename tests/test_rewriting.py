"""Rewriting rules: texts in, texts out."""

import zlib

import pytest

from pairloom.functions.hashing import uniform
from pairloom.operators import generation as G

CASES = [
    ("It is hard to find gold.", {("TOUGH:IT->RAISED", "Gold is hard to find.")}),
    ("Gold is hard to find.", {("TOUGH:RAISED->IT", "It is hard to find gold.")}),
    ("It was easy to read the long book.", {("TOUGH:IT->RAISED", "The long book was easy to read.")}),
    ("It is green to find gold.", set()), ("It is hard to find gold", set()), ("It is hard to find.", set()),
    ("If she had come early, we left.", {("INV:IF->AUX", "Had she come early, we left.")}),
    ("Had she come early, we left.", {("INV:AUX->IF", "If she had come early, we left.")}),
    ("Were he here, now, we could go.", {("INV:AUX->IF", "If he were here, now, we could go.")}),
    ("If she had come early we left.", set()),
    ("It was Anna Lee who came first.", {("CLEFT:-IT", "Anna Lee came first.")}),
    ('"Go now," said Anna.', {("QI:VS->SV", '"Go now," Anna said.')}),
    ('"Go now, please!" Anna Lee said.', {("QI:SV->VS", '"Go now, please!" said Anna Lee.')}),
    ('"Go now," said the old man.', set()), ("Go now, said Anna.", set()),
    ("They do not sing every song here.", {("CTR:FUSE", "They don't sing every song here."), ("DETQ:every->each", "They do not sing each song here.")}),
    ("Don't go, I am here.", {("CTR:SPLIT", "Do not go, I am here."), ("CTR:FUSE", "Don't go, I'm here.")}),
    ("(It is not), is not.", {("CTR:FUSE", "(It isn't), is not.")}),
    ("Each can't see each", {("CTR:SPLIT", "Each cannot see each"), ("DETQ:each->every", "Every can't see each"), ("DETQ:each->every", "Each can't see every")}),
    ("We saw the sea, and they saw us.", {("SPLIT:,and->.", "We saw the sea. They saw us.")}),
    ("We saw the sea. They saw us.", {("JOIN:.->,and", "We saw the sea, and they saw us.")}),
    ("A big one, a red one, and they saw us.", {("SPLIT:,and->.", "A big one, a red one. They saw us.")}),
    ("She, and he left now.", set()), ("", set()), (None, set()), ("word " * 3000, set()),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, text string")
    got = {}
    for r in G.proposals(df, "text").collect():
        got.setdefault(r.k, set()).add((r.t_type, r.out_text))
    assert {k: got.get(k, set()) for k in range(len(CASES))} == {k: want for k, (_, want) in enumerate(CASES)}


def test_balanced_pick_against_a_plain_version(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)] + [(100 + k, "They do not sing every song here.") for k in range(60)], "k int, text string")
    found = G.proposals(df, "text")
    keys = {}
    for r in found.collect():
        keys.setdefault(r.k, []).append((r.family, r.t_type, r.out_text))
    draws = {}
    wanted = sorted({"|".join(map(str, (k, *p[:n]))) for k, ps in keys.items() for p in ps for n in (1, 2, 3)})
    from pyspark.sql import functions as F

    numbers = spark.createDataFrame([(w, zlib.crc32(w.encode()) + 3 * 7919) for w in wanted], "w string, n long")
    for r in numbers.select("w", uniform(F.col("n")).alias("u")).collect():
        draws[r.w] = r.u
    u = lambda k, *c: draws["|".join(map(str, (k, *c)))]
    want = {k: min(ps, key=lambda p, k=k: (u(k, p[0]), p[0], u(k, *p[:2]), p[1], u(k, *p), p[2])) for k, ps in keys.items()}
    picked = {r.k: (r.family, r.t_type, r.out_text) for r in G.balanced_pick(found, "k").collect()}
    assert picked == want
    assert len({picked[100 + k][0] for k in range(60)}) == 2  # both families come up


@pytest.mark.parametrize("rows", [0])
def test_no_rows(spark, rows):
    assert G.proposals(spark.createDataFrame([], "text string"), "text").count() == rows
