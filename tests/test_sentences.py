"""The sentence splitter against a scanner that goes through a text character by character."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T

MARKS, CLOSE, BLANK = ".!?…", "\"'”’»)]", " \t\r\f\x0b"


def _plain(text):
    n, at, start, out = len(text), 0, 0, []
    of = lambda k, kinds: k < n and unicodedata.category(text[k])[0] in kinds
    small = lambda k: k < n and unicodedata.category(text[k]) == "Ll"

    def blanks(k, which=" \t"):
        while k < n and text[k] in which:
            k += 1
        return k

    def word(k):
        """Behind what is taken as one at the beginning of a word."""
        for t in T.TITLES:
            if text.startswith(t + ".", k):
                return k + len(t) + 1
        for t in T.LIGHT:
            if text.startswith(t + ".", k):
                to = blanks(k + len(t) + 1)
                if to > k + len(t) + 1 and to < n and (small(to) or text[to] in "0123456789,;("):
                    return to + 1
        for t in T.NUMBERED:
            if text.startswith(t + ".", k):
                to = blanks(k + len(t) + 1)
                if to < n and text[to] in "0123456789":
                    return to + 1
        to = k
        while of(to, "L") and text[to + 1 : to + 2] == ".":
            to += 2
        if to > k:
            return to
        while of(to, "LMN"):
            to += 1
        return to

    while at < n:
        c = text[at]
        if c == "\n":
            at = blanks(at, "\n")
            out.append(text[start:at])
            start = at
            continue
        partner = {'"': '"', "“": "”", "«": "»", "(": ")"}.get(c)
        if partner:
            stop = at + 1
            while stop < n and text[stop] not in (partner, "\n") and not (c == "(" and text[stop] == "("):
                stop += 1
            if stop < n and text[stop] == partner:
                at = stop + 1
                continue
        if of(at, "LMN"):
            at = word(at)
            continue
        if c not in MARKS:
            at += 1
            continue
        dots = 3 if text.startswith("...", at) else 1 if c == "…" else 0
        to = blanks(at + dots)
        if dots and to > at + dots and small(to):
            at = to + 1
            continue
        to = at
        while to < n and text[to] in MARKS:
            while to < n and text[to] in MARKS:
                to += 1
            while to < n and text[to] in CLOSE:
                to += 1
        if to < n and text[to] not in BLANK + "\n":
            at = to + 1
            continue
        at = blanks(to, BLANK) if to < n and text[to] in BLANK else blanks(to, "\n")
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


CASES = {
    "Dr. X met Mrs. Y. They spoke.": ["Dr. X met Mrs. Y. They spoke."],  # a single letter is an initial
    "Dr. Brown met Mrs. Green. They spoke.": ["Dr. Brown met Mrs. Green.", "They spoke."],
    "Pi is 3.14 and e is 2.71. See a.b.com now! Really?": ["Pi is 3.14 and e is 2.71.", "See a.b.com now!", "Really?"],
    'He said "Go. Now." and left. She stayed.': ['He said "Go. Now." and left.', "She stayed."],
    "Wait... then go. So… yes. Well... No.": ["Wait... then go.", "So… yes.", "Well...", "No."],
    "J. R. R. Tolkien wrote it. Fine.": ["J. R. R. Tolkien wrote it.", "Fine."],
    "Apples, pears, etc. are fruit. Bring some, etc. We wait.": ["Apples, pears, etc. are fruit.", "Bring some, etc.", "We wait."],
    "See No. 5 (cf. No. 6. Yes). Ok?!": ["See No. 5 (cf. No. 6. Yes).", "Ok?!"],
    "One line\nTwo lines\n\nThree.": ["One line", "Two lines", "Three."],
    "z. B. so und d. h. anders. Ende.": ["z. B. so und d. h. anders.", "Ende."],
    "Open \"quote. Then more. (never closed. End": ['Open "quote.', "Then more.", "(never closed.", "End"],
    "": [], "   ": [], "...": ["..."], "a": ["a"],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(spark, text):
    assert _plain(text) == CASES[text]
    assert spark.createDataFrame([(text,)], "t string").select(T.split_sentences(F.col("t"))).first()[0] == CASES[text]


def test_random_texts(spark):
    rng = random.Random(1)
    parts = ["Dr", "Mr", "etc", "No", "S", "a", "B", "word", "Grün", "7", "42", ".", ".", ".", "!", "?", "…", "...", " ", " ", " ", "\n", "\t", "\r", '"', "(", ")", "“", "”", "'", "»", "«", ",", "e.g.", "é", "]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4_000)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.split_sentences(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == _plain(texts[r.k]), repr(texts[r.k])


def test_long_texts_and_nulls(spark):
    long_ = "Dr. Brown wrote 3.14 words (so. many) to " * 20_000 + "nobody. The end."
    rows = [(0, long_), (1, "." * 200_000), (2, '"' * 100_001), (3, "(" * 100_000), (4, None), (5, "word " * 200_000)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, t string").select("k", T.split_sentences(F.col("t")).alias("s")).collect()}
    assert [len(got[0]), len(got[1]), len(got[2]), len(got[3]), got[4], len(got[5])] == [2, 1, 1, 1, None, 1]
