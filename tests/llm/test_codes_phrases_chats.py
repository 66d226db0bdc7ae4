"""Vector codes, collocations and chat formatting against plain versions; odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import chat_format as C
from pairloom.llm import collocations as P
from pairloom.llm import vector_codes as V

# Vector codes


def _plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, vector); Python's integers throughout."""
    kept = sorted(((i, lab, [math.floor(1024 * x) if abs(x) < 2.0**50 else 1024 * int(x) for x in v]) for i, lab, v in rows), key=lambda r: r[0])
    size = len(kept[0][2]) // parts
    books = [[r[2][p * size : (p + 1) * size] for r in kept[:entries]] for p in range(parts)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, _, x in kept:
                part = x[p * size : (p + 1) * size]
                groups[near(part, books[p])[0]].append(part)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    out = {}
    for i, lab, x in kept:
        found = [near(x[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        out[i] = (lab, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found))
    return out, books


def _coded(spark, rows, schema="vec_id long, embedding array<double>, label int", **how):
    return V.encode_vectors(spark.createDataFrame(rows, schema), **how)


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e6, 1e14, 1e60])
def test_codes_equal_plain_integers(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(8)], rng.randint(0, 2)) for i in rng.sample(range(1000), 90)]
    coded, books = _coded(spark, rows, entries=20)
    want, want_books = _plain_codes([(i, lab, v) for i, v, lab in rows], 4, 20, 4)
    assert [[list(map(int, e)) for e in b] for b in books] == want_books
    assert {r.vec_id: (r.label, r.code, int(r.error)) for r in coded.collect()} == {i: (lab, c, min(e, V.LARGEST)) for i, (lab, c, e) in want.items()}


def test_one_huge_vector_changes_no_other_result(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0, 0.5], 0) for i in range(40)] + [(99, [1e200, -1e200, 0.0, 3e30], 1)]
    coded, _ = _coded(spark, rows, entries=8)
    want, _ = _plain_codes([(i, lab, v) for i, v, lab in rows], 4, 8, 4)
    assert {r.vec_id: (r.code, int(r.error)) for r in coded.collect()} == {i: (c, min(e, V.LARGEST)) for i, (_, c, e) in want.items()}


def test_label_errors_and_odd_vectors(spark):
    bad = [(50, None, 1), (51, [1.0, None, 2.0, 3.0], 1), (52, [1.0, float("nan"), 2.0, 3.0], 1), (53, [1.0, float("inf"), 2.0, 3.0], 1), (54, [], 1), (55, [1.0, 2.0], 1)]
    good = [(i, [i / 3, -i / 7, i % 2 + 0.1, 2.0], None if i % 3 == 0 else i % 2) for i in range(30)] + [(None, [9.0, 9.0, 9.0, 9.0], 5)] + [(7, [7 / 3, -1.0, 1.1, 2.0], 1)] * 2
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as packed", "2 as v", "'x' as code", "3 as _of")
    coded, books = V.encode_vectors(df, entries=4)
    out = V.with_label_errors(coded, books).collect()
    assert len(out) == len(good) and {len(r.code) for r in out} == {8}
    label = defaultdict(int)
    by_code = [(r.vec_id, r.error, r.label_error) for r in out]
    labels = Counter()
    for (i, _, lab) in good:
        labels[i, lab] += 1
    of = {i: lab for i, _, lab in good}
    for i, e, _ in by_code:
        label[of[i]] += e
    assert all(t == label[of[i]] for i, _, t in by_code)
    text = ",".join(str(v) for b in books for e in b.tolist() for v in e)
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_nothing(spark):
    for rows in ([], [(1, [1.0, 2.0, 3.0], 0)], [(1, None, 0)]):
        coded, books = _coded(spark, rows)
        assert V.with_label_errors(coded, books).collect() == [] and books == []


def test_ball_tree_breaks_ties_to_the_lower_index():
    rng = np.random.default_rng(1)
    for kind, times in ((np.int64, 1), (np.int64, 2**25), (object, 2**90)):
        entries = rng.integers(-4, 4, (200, 3)).astype(kind) * times
        x = rng.integers(-6, 6, (500, 3)).astype(kind) * times
        index, least = V.BallTree(entries).nearest(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == [int(np.argmin(r)) for r in far] and all(least[k] == far[k, i] for k, i in enumerate(index))


def test_limbs():
    for v in (0, -1, 5, -(2**70), 2**100 + 3, 2**31, -(2**31)):
        assert V.join_limbs(V.split_limbs(v, 5)) == v


# Collocations


def _plain_phrases(rows, least=10, share=50, top=2000):
    count, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        sizes[lang] += 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            sizes[lang] += len(w)
            for n in (1, 2, 3):
                for k in range(len(w) - n + 1):
                    count[lang, tuple(w[k : k + n])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        inside = [x for (g, q), x in candidates.items() if g == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))] if len(p) == 2 else []
        if any(100 * x >= share * a for x in inside):
            continue
        score, k, left, right = min((1_000_000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, sizes[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def _texts(seed, n=500, languages=("en", "de", None)):
    rng = random.Random(seed)
    vocabulary = ["a", "of", "The", "new", "york", "città", "São", "x\x00y", "don't", "##", "😀", "b", "c"]
    made = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " : "]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice([made(), made(), None, ""]), rng.choice(languages)) for _ in range(n)]


@pytest.mark.parametrize(("seed", "patterns", "unit", "batch"), [(1, None, None, None), (2, 7, 300, 500), (3, 3, 1 << 20, 200)])
def test_collocations_equal_plain_counts(spark, monkeypatch, seed, patterns, unit, batch):
    """Also with automata of a few phrases, many buckets and salts, and small batches: the same rows."""
    rows = _texts(seed)
    if patterns:
        monkeypatch.setattr(P, "PATTERNS", patterns)
        monkeypatch.setattr(P, "SHARD_BYTES", unit)
        monkeypatch.setattr(P, "BATCH_BYTES", batch)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as n", "2 as phrase", "3 as bucket")
    got = sorted(tuple(r) for r in P.mine_collocations(df).collect())
    assert got == _plain_phrases(rows) and len(got) > 20


def test_collocations_are_exact_when_the_sketch_lets_all_through(spark, monkeypatch):
    rows = _texts(5)
    monkeypatch.setattr(P, "MOST_CELLS", 8)
    got = sorted(tuple(r) for r in P.mine_collocations(spark.createDataFrame(rows, "text string, lang string")).collect())
    assert got == _plain_phrases(rows)


def test_gaps_lead_back_to_places():
    rng = np.random.default_rng(2)
    for size, count in ((10, 0), (10, 10), (5_000, 3), (1 << 18, 900), (1 << 18, 60_000)):
        places = np.sort(rng.choice(size, count, replace=False))
        assert P.places_of(P.gaps_of(places)).tolist() == places.tolist()
    assert P.places_of(P.gaps_of(np.array([254, 255, 510, 766]))).tolist() == [254, 255, 510, 766]


def test_sketch_lets_few_rare_phrases_through(spark):
    """The bits of the merged sketch are those of plain counts of its cells."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(60)) for _ in range(800)] + ["one common phrase"] * 30
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(5)
    width = 1 << 16
    bits = P.sketch_bits(df, width, 10, 3)
    for row in range(P.ROWS):
        total = np.zeros(width, np.int64)
        for t in texts:
            words = P.Words([t.encode()])
            for n in (1, 2, 3):
                np.add.at(total, P.cells_of("en", words.grams(n)[1], row, width), 1)
        assert (np.unpackbits(bits[row]).astype(bool) == (total >= 10)).all()


def test_collocations_of_one_hot_phrase_and_of_nothing(spark):
    rows = [("same words here " * 500, "en")] * 30 + [("same words", "de")] * 10
    got = sorted(tuple(r) for r in P.mine_collocations(spark.createDataFrame(rows, "text string, lang string")).collect())
    assert got == _plain_phrases(rows)
    assert P.mine_collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert P.mine_collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 987654321098765, 999999999999999, 987654321098799
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(P.whole_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)


# Chat formatting


ODD = ["", "#", "##", "###", "####", "</turn>", "</tur", "<", "</turn", "\\", "é", "😀", ": ", "\n", "### assistant: ", "a b"]


def _plain_format(turns):
    """Formatted text and the unescaped texts of assistants, character by character."""

    def escaped(s, role):
        out = ""
        for k, c in enumerate(s):
            if c == "\\" or s.startswith("###", k) or s.startswith("</turn>", k) or (role and c == ":"):
                out += "\\"
            out += c
        return out

    return "".join(f"### {escaped(r, True)}: {escaped(t, False)}</turn>\n" for r, t in turns)


def _conversations(seed, n=40, most=12):
    rng = random.Random(seed)
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(ODD) for _ in range(rng.randint(0, 9)))
    return [(c, None if rng.random() < 0.03 else t, rng.choice(["user", "assistant", "system", "a:b", "### assistant", None, "é"]), text()) for c in [*range(n), None] for t in range(rng.randint(1, most))]


def _ordered(rows):
    found = defaultdict(list)
    low = lambda x: (x is not None, (x or "").encode())
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, low(v[2]), low(v[3]))):
        found[c].append((r or "", x or ""))
    return found


def _digest(turns):
    loss = "".join(x for r, x in turns if r == "assistant")
    whole = "".join(f"{r}\n{x}\n" for r, x in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(_plain_format(turns)))


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", [1, 7])
def test_formatted_texts_and_digests(spark, partitions):
    rows = _conversations(4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "2 as loss", "3 as whole", "4 as n_turns")
    made = C.format_conversations(df, partitions=partitions)
    want = _ordered(rows)
    texts, spoken = defaultdict(str), defaultdict(str)
    for r in made.orderBy("conv_id", "piece").collect():
        texts[r.conv_id] += r.text
        spoken[r.conv_id] += "".join(C.unescape(r.text[s.start : s.end]) for s in r.loss)
    assert texts == {c: _plain_format(t) for c, t in want.items()}
    assert {c: C.read_turns(t) for c, t in texts.items()} == dict(want)
    assert spoken == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    assert {r[0]: tuple(r[1:]) for r in C.digests(made).collect()} == {c: _digest(t) for c, t in want.items()}


def test_one_hot_conversation_is_spread_and_hashed_whole(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"### turn {k} </turn>" * 3) for k in range(5_000)] + _conversations(6, n=30)
    rows = [(c, t, r, x) for c, t, r, x in rows if c is None or c > 0]
    made = C.format_conversations(spark.createDataFrame(rows, SCHEMA), partitions=6)
    pieces = made.where("conv_id = 1 and n_turns > 100").count()
    assert pieces >= 5
    assert {r[0]: tuple(r[1:]) for r in C.digests(made).collect()} == {c: _digest(t) for c, t in _ordered(rows).items()}


def test_control_strings_stay_apart_from_marks():
    for seed in range(200):
        turns = [(r or "", x or "") for _, _, r, x in _conversations(seed, n=1)]
        made, *_ = C.assemble(pa.array([r for r, _ in turns]), pa.array([x for _, x in turns]))
        assert made.to_pybytes().decode() == _plain_format(turns)
        assert C.read_turns(made.to_pybytes().decode()) == turns
    with pytest.raises(ValueError, match="no turn"):
        C.read_turns("### user: open")


def test_long_texts_and_empty_tables(spark):
    long_ = "### é" * 600_000
    rows = [(1, 0, "user", long_), (1, 1, "assistant", long_ + "x"), (2, 0, "assistant", "")]
    made = C.format_conversations(spark.createDataFrame(rows, SCHEMA), partitions=2)
    assert {r[0]: tuple(r[1:]) for r in C.digests(made).collect()} == {c: _digest(t) for c, t in _ordered(rows).items()}
    assert C.digests(C.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


# Names, bounds


def test_user_columns_stay(spark):
    from pairloom.llm.decontamination import decontaminate
    from pairloom.llm.pii import pseudonymise

    docs = spark.createDataFrame([(1, "mail a@b.com", "mine", "too", "three", "four")], "doc_id long, text string, _found string, _pattern string, _Found_ string, _contamination string")
    out = pseudonymise(docs, key="k")
    assert out.columns == [*docs.columns, "pii"]
    row = out.first()
    assert (row["_found"], row["_pattern"], row["_Found_"]) == ("mine", "too", "three") and row["text"].endswith("@b.com") and row["text"] != "mail a@b.com"
    assert pseudonymise(docs.drop("_found"), key="k", into="_found").first()["_found"][0]["kind"] == "email"
    kept = decontaminate(docs, spark.createDataFrame([(1, "other words")], "item_id long, text string"))
    assert kept.columns == docs.columns and kept.first()["_contamination"] == "four"


def test_long_local_parts_get_pseudonyms(spark):
    from pairloom.llm.pii import pseudonymise

    texts = ["to " + "x" * n + "@mail.example now" for n in (64, 65, 200)]
    out = pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), key="k").collect()
    for t, r in zip(texts, out, strict=True):
        assert r.text != t and len(r.text) == len(t) and r.text.endswith("@mail.example now")
    back = pseudonymise(spark.createDataFrame([(r.text,) for r in out], "text string"), key="k", invert=True)
    assert [r.text for r in back.collect()] == texts


def test_labelled_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    from pairloom.llm import toxicity as T

    seen = []
    monkeypatch.setattr(T.Cnn, "fit", lambda self, texts, labels: seen.append((len(texts), sum(map(len, texts)))))
    monkeypatch.setattr(T.Cnn, "calibrate", lambda self, texts, labels: seen.append(len(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = spark.range(200).selectExpr("id as doc_id", "concat('word ', id) as text")
    hot = spark.range(30_000).selectExpr("cast(7 as long) as doc_id", "concat('same id ', id) as text")
    T.train(docs.union(hot), labels)
    assert seen[0][0] <= 2 * T.TRAIN_PER_LABEL and seen[1] <= T.CALIBRATE
    seen.clear()
    monkeypatch.setattr(T, "SAMPLE_BYTES", 16_000)
    T.train(docs.union(hot).selectExpr("doc_id", "concat(text, repeat(' x', 400)) as text"), labels)
    assert seen[0][0] <= 2 * 16_000 // 800 and seen[0][1] > 0


def test_owners_of_one_window_by_thousands(spark):
    import time

    from pairloom.llm import decontamination as D

    items = spark.range(60_000).selectExpr("id as item_id", "'one two three four five six seven eight nine ten' as text")
    began = time.time()
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y")], "doc_id long, text string")
    assert D.benchmark_hits(docs, items, into="f").selectExpr("size(f.items)").first()[0] == 60_000
    assert time.time() - began < 60
