"""Near duplicates, personal data, decontamination, licences, repeated passages."""

import hashlib
import random
import re
from datetime import date, datetime, timedelta
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontamination as D
from pairloom.llm import licences as L
from pairloom.llm import ngram_jaccard as J
from pairloom.llm import pii as P
from pairloom.llm import sparse_suffix as S

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, tokens int, component int"


def _frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA)


def _corpus(seed, n, words=400, vocabulary=5000):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randint(0, vocabulary)}" for _ in range(k)]
    rows, passage = [], make(70)
    for i in range(n):
        text = make(rng.randint(5, words))
        if i % 3 == 0:
            text[2:2] = passage
        rows.append(text)
    for i in range(n // 2):
        text = list(rows[rng.randint(0, n // 4)])
        for _ in range(rng.randint(0, max(1, len(text) // 25))):
            text[rng.randint(0, len(text) - 1)] = f"x{rng.randint(0, 99)}"
        rows.append(text)
    out = [(i, " ".join(t)) for i, t in enumerate(rows)]
    return [*out, (900, None), (901, ""), (902, " \n "), (903, "Two Words"), (904, "two  WORDS"), (905, "lone"), (None, "no id at all here now"), (1, out[1][1])]


def _shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _components(rows, n, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(_shingles(t, n))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            for x in sets[ids[a]]:
                for y in sets[ids[b]]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = root(ids[a]), root(ids[b])
                        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("n", "percent", "large", "hot"), [(4, 85, 64, 2048), (4, 85, 3, 2), (5, 80, 64, 2048), (2, 60, 5, 2048), (2, 60, 5, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, n, percent, large, hot):
    monkeypatch.setattr(J, "HOT_CELL", hot)
    rows = _corpus(n, 90)
    got = J.ngram_jaccard_join(_frame(spark, rows), n=n, percent=percent, large_cell=large).collect()
    want = _components(rows, n, percent)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    size = {(i, len(_shingles(t, n))) for i, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == size


@pytest.mark.parametrize("hot", [2048, 2])
@pytest.mark.parametrize("families", [True, False])
def test_jaccard_hot_group(spark, monkeypatch, hot, families):
    """Many near copies of one text: blocks of a large cell, and links that join rather than all pairs; the trees of step 3 find all without those of step 2."""
    import pyarrow as pa

    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, 59)] = f"y{rng.randint(0, 999)}"
        rows.append((i, " ".join(t)))
    for name, value in (("BLOCK", 64), ("FAMILY", 64), ("BLOCK_SHINGLES", 64 * 40), ("HOT_CELL", hot)):
        monkeypatch.setattr(J, name, value)
    if not families:
        empty = pa.schema([("o", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        monkeypatch.setattr(J, "_families", lambda percent: lambda batches: (pa.RecordBatch.from_arrays([pa.array([], t) for t in empty.types], schema=empty) for _ in batches))
    got = {r.doc_id: r.component_id for r in J.ngram_jaccard_join(_frame(spark, rows), n=4, percent=85, large_cell=16, count_links=False).collect()}
    assert got == _components(rows, 4, 85)


@pytest.mark.parametrize("large", [64, 1])
def test_jaccard_documents_of_several_texts(spark, large):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (3, b), (7, c + " " + a), (7, c), (9, c + " end"), (8, a + " " + b)]
    got = {(r.doc_id, r.component_id) for r in J.ngram_jaccard_join(_frame(spark, rows), n=4, percent=85, large_cell=large).collect()}
    assert got == set(_components(rows, 4, 85).items()) == {(1, 1), (5, 1), (3, 1), (7, 7), (9, 7), (8, 8)}


def test_forest():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        n, m = 30, int(rng.integers(0, 60))
        a = rng.integers(0, n - 1, m)
        b = a + 1 + (rng.integers(0, n, m) % (n - 1 - a))
        weight = rng.integers(0, 5, m)
        keep = J.forest(a, b, weight, n)
        whole = _closure(zip(a.tolist(), b.tolist(), strict=True), n)
        assert whole == _closure(zip(a[keep].tolist(), b[keep].tolist(), strict=True), n) and keep.sum() == n - len(set(whole))


def _closure(pairs, n):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("unit", [256, 7])
def test_jaccard_counts_all_links(spark, monkeypatch, unit):
    monkeypatch.setattr(J, "UNIT", unit)
    rng = random.Random(8)
    rows = [(k, " ".join(f"{c}{i}" for i in range(40)) + f" end{k}") for k, c in enumerate("aaabbc")]
    base = [f"w{k}" for k in range(60)]
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, 59)] = f"y{rng.randint(0, 999)}"
        rows.append((100 + i, " ".join(t)))
    rows += [(i + 1000, t) for i, t in rows[::5]] + [(500, rows[0][1]), (500, rows[3][1])]
    got = {r.doc_id: r.n_links for r in J.ngram_jaccard_join(_frame(spark, rows), n=4, percent=85, large_cell=16).collect() if r.doc_id != 500}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(frozenset(_shingles(t, 4)))
    reps = {}
    for i, sets in texts.items():
        for s in sets:
            reps[s] = min(i, reps.get(s, i))
    linked = lambda a, b: any(100 * len(x & y) >= 85 * len(x | y) for x in texts[a] for y in texts[b])
    nodes = set(reps.values())
    want = {i: sum(linked(reps[s], b) for b in nodes if b != reps[s]) for i, sets in texts.items() if i != 500 for s in sets}
    assert got == want and [got[k] for k in range(6)] == [2, 2, 2, 1, 1, 0] and max(want.values()) > 10


def _sent_to_driver(spark):
    """Bytes of results by stage."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).resultSize() for k in range(stages.size())}


@pytest.mark.parametrize("pipeline", [False, True])
def test_jaccard_sends_the_driver_each_frequent_shingle_once(spark, monkeypatch, pipeline):
    """The driver gets FREQUENT shingles in all, not as many from each task; which of them they are changes no link."""
    monkeypatch.setattr(J, "FREQUENT", 4000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(4000))) for i in range(80)]
    rows += [(i + 100, t + " end") for i, t in rows]  # some 48,000 shingles of prefixes stand twice
    partitions = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in partitions}
    earlier = _sent_to_driver(spark)
    for k, v in partitions.items():
        spark.conf.set(k, v)
    try:
        docs = _frame(spark, rows).withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")}).repartition(2)
        if pipeline:
            assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()} == set(range(80))
        else:
            got = J.ngram_jaccard_join(docs, n=4, percent=85, count_links=False).collect()
            assert {r.doc_id: r.component_id for r in got} == {i: i % 100 for i, _ in rows}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    largest = max(v for k, v in _sent_to_driver(spark).items() if k not in earlier)
    assert largest < 400_000, largest


@pytest.mark.parametrize("limit", [0, 1, 7, 300, 2000, 5000])
def test_most_frequent_shingles_come_last(spark, limit):
    """Short of the limit by less than the rows of one part, and none is left out that is more frequent by a step."""
    rng = random.Random(limit)
    times = {rng.randrange(-(2**63), 2**63): rng.choice([2, 2, 2, 3, 5, 1023, 1024, rng.randrange(1024, 10**9)]) for _ in range(3000)}
    rows = [(1, t, n - n // 2) for t, n in times.items()] + [(1, t, n // 2) for t, n in times.items()] + [(0, 5, 10**6)]
    got = J._most_frequent(spark.createDataFrame(rows, "kind byte, doc_id long, n int"), limit).view("int64").tolist()
    assert got == sorted(got, key=lambda t: (times[t], -t)) and min(limit, 3000) - 8 <= len(set(got)) == len(got) <= limit
    assert not got or max((n for t, n in times.items() if t not in set(got)), default=0) <= 1.02 * times[got[0]]


def test_jaccard_empty(spark):
    assert J.ngram_jaccard_join(_frame(spark, [])).count() == 0
    assert J.keep_one(_frame(spark, [])).columns == SCHEMA.replace(",", "").split()[::2]


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (8, "other words stand in this one"), (None, "x"), (9, None)]
    assert {r.doc_id for r in J.keep_one(_frame(spark, rows)).collect()} == {3, 8, None, 9}


def test_signature_tree_bounds():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 40, np.uint64)) for _ in range(50)]
    sets += [np.unique(np.concatenate([s[:38], rng.integers(0, 2**63, 2, np.uint64)])) for s in sets[:20]]
    size = min(len(J.bitmap(s)) for s in sets)
    tree = J.SignatureTree(np.array([len(s) for s in sets]), np.arange(len(sets)), np.stack([J.fold(J.bitmap(s), size) for s in sets]))
    left = {(min(a, b), max(a, b)) for a, b in zip(*J.dual_traversal(tree, tree, 85)[:2], strict=True)}
    true = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert true and true <= left and len(left) < 60


PII_TEXTS = [
    "card 4282026678195914 x", "call +1 (847) 555-7819 4795326016703902 now", "ip 4405935324758010 16.120.181.235 que", "mail ebs.68@mail3.example.com foo", "2024-02-29 31.12.1999, 12/31/2000; 31/12/2000 2023-02-30",
    "ssn 123-45-6789 000-12-3456", "DE89370400440532013000 ok GB82WEST12345698765432", "4111 1111 1111 1111", "+49 30 123456 hi +33123456789.", "no 4.0 and 3. 1234567890123456 256.1.1.1 1.2.3.4.5", "", None, "plain",
]


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pii_round_trip_and_formats(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id int, text string").withColumn("pii", F.lit("clash"))
    hidden = P.pseudonymise(docs, key="pairloom")
    back = P.pseudonymise(hidden.select("doc_id", "text"), key="pairloom", invert=True)
    assert [r.text for r in back.orderBy("doc_id").collect()] == PII_TEXTS
    rows = hidden.orderBy("doc_id").collect()
    assert [[f.kind for f in r.pii] for r in rows] == [["card"], ["phone", "card"], ["card", "ip"], ["email"], ["date"] * 4, ["ssn"], ["iban", "iban"], ["card"], ["phone", "phone"], [], [], [], []]
    for r, t in zip(rows, PII_TEXTS, strict=True):
        assert r.text == t if not r.pii else r.text != t
        for f in r.pii:
            digits = re.sub(r"\D", "", f.pseudonym)
            if f.kind == "card":
                assert _luhn(digits) and digits[0] == "4"
            if f.kind == "iban":
                moved = f.pseudonym[4:] + f.pseudonym[:4]
                assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
            if f.kind == "ip":
                assert all(0 <= int(x) < 256 for x in f.pseudonym.split("."))
    assert re.sub(r"\d", "9", rows[1].text) == re.sub(r"\d", "9", PII_TEXTS[1])


def test_pii_grouped_ibans(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 now", "ES91 2100 0418 4502 0005 1332 2024 BE12 4111 1111 1111 1111 x", "XX11 GB82 WEST 1234 5698 7654 32, 16.120.181.235", "DE89 3704 0044 0532 0130 01", "DE89370400440532013000"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    hidden = P.pseudonymise(docs, key="pairloom")
    rows = hidden.orderBy("doc_id").collect()
    assert [[f.kind for f in r.pii] for r in rows] == [["iban"], ["iban", "card"], ["iban", "ip"], [], ["iban"]]
    for r, t in zip(rows[:3], texts, strict=False):
        assert re.sub(r"\d", "9", r.pii[0].pseudonym) in re.sub(r"\d", "9", t) and r.pii[0].pseudonym not in t
    assert rows[0].pii[0].pseudonym.replace(" ", "") == rows[4].pii[0].pseudonym
    assert [r.text for r in P.pseudonymise(hidden.select("doc_id", "text"), key="pairloom", invert=True).orderBy("doc_id").collect()] == texts


def test_pii_links_equal_values_and_keys_differ(spark):
    docs = spark.createDataFrame([(1, "a 10.0.0.1 b"), (2, "10.0.0.1"), (3, "10.0.0.2")], "doc_id int, text string")
    one = {r.doc_id: r.pii[0].pseudonym for r in P.pseudonymise(docs).collect()}
    other = {r.doc_id: r.pii[0].pseudonym for r in P.pseudonymise(docs, key="k2").collect()}
    assert one[1] == one[2] != one[3] and one[1] != other[1]


def _plain_feistel(key, kind, left, right, sizes, tweak):
    state = [left, right]
    for i in range(P.ROUNDS):
        own, other = i % 2, state[1 - i % 2]
        digest = hashlib.sha256(f"{key}|{kind}|{tweak}|{sizes[0]}|{sizes[1]}|{i}|{other}".encode()).hexdigest()
        state[own] = (state[own] + int(digest[:15], 16)) % sizes[own]
    return state


def _plain_digits(key, kind, digits, tweak):
    if len(digits) < 2:
        return digits
    u = len(digits) // 2
    x, y = _plain_feistel(key, kind, int(digits[:u]), int(digits[u:]), (10**u, 10 ** (len(digits) - u)), tweak)
    return f"{x:0{u}d}{y:0{len(digits) - u}d}"


def _fill(shape, symbols, slot):
    left = iter(symbols)
    return "".join(next(left) if re.fullmatch(slot, c) else c for c in shape)


def _base36(text):
    return int(text, 36) if text else 0


def _to36(n, width):
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out.rjust(width, "0") if width else ""


def _plain_day(key, d):
    """By a list of all days of the block."""
    first = (d.year - 1900) // 200 * 200 + 1900
    days = [date(first, 1, 1) + timedelta(k) for k in range((date(first + 200, 1, 1) - date(first, 1, 1)).days)]
    own = [x for x in days if (x.day <= 12) == (d.day <= 12)]
    kind, (a, b) = ("date", (160, 180)) if d.day <= 12 else ("late date", (250, 177))
    n = own.index(d)
    while True:
        x, y = _plain_feistel(key, kind, n // b, n % b, (a, b), str(first))
        n = x * b + y
        if n < len(own):
            return own[n]


def _mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _plain_pseudonym(key, m):
    """(kind, pseudonym) of a match, or None."""
    digits = re.sub(r"\D", "", m)
    if "@" in m:
        local, domain = m.split("@", 1)
        symbols, out, before = re.sub("[^A-Za-z0-9]", "", local).lower(), "", ""
        for cut in range(0, len(symbols), 24):
            part = symbols[cut : cut + 24]
            u, v = len(part) // 2, len(part) - len(part) // 2
            x, y = _plain_feistel(key, "email", _base36(part[:u]), _base36(part[u:]), (max(36**u, 1), 36**v), f"{before}|@{domain.lower()}")
            before = _to36(x, u) + _to36(y, v)
            out += before
        return "email", f"{_fill(local, out, '[A-Za-z0-9]')}@{domain}"
    if m[0].isalpha():
        if _mod97(m[4:] + m[:4]) != 1:
            return None
        body = m[4:]
        moved = _fill(body, _plain_digits(key, "iban", re.sub(r"\D", "", body), m[:2] + re.sub(r"\d", "0", body)), r"\d")
        return "iban", f"{m[:2]}{98 - _mod97(moved + m[:2] + '00'):02d}{moved}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        x, y = _plain_feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "")
        return "ip", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        a, g, n = int(m[:3]), int(m[4:6]), int(m[7:])
        if a in (0, 666) or a >= 900 or not g or not n:
            return None
        areas = [k for k in range(1, 900) if k != 666]
        x, y = _plain_feistel(key, "ssn", areas.index(a) * 99 + g - 1, n - 1, (898 * 99, 9999), "")
        return "ssn", f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", m):
        for shape in {"-": ["%Y-%m-%d"], ".": ["%d.%m.%Y"], "/": ["%m/%d/%Y", "%d/%m/%Y"]}[re.search(r"\D", m)[0]]:
            try:
                return "date", _plain_day(key, datetime.strptime(m, shape).date()).strftime(shape)
            except ValueError:
                continue
        return None
    if re.fullmatch(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}", m):
        if not _luhn(digits):
            return None
        moved = digits[0] + _plain_digits(key, "card", digits[1:-1], digits[0])
        return "card", _fill(m, moved + next(c for c in "0123456789" if _luhn(moved + c)), r"\d")
    if (m[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m)) and 7 <= len(digits) <= 18:
        code = re.match(P._CODE, m)
        code = code[0] if code else ""
        rest = m[len(code) :]
        return "phone", code + _fill(rest, _plain_digits(key, "phone", re.sub(r"\D", "", rest), code or "+1"), r"\d")
    return None


def test_pii_against_brute_force(spark):
    rng = random.Random(4)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        n = "4" + number(rng.randint(11, 17))
        return n + next(c for c in "0123456789" if _luhn(n + c))

    make = [
        card, lambda: number(16), lambda: f"{rng.randint(1600, 2299)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}", lambda: f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.19{number(2)}", lambda: f"{rng.randint(1, 31):02d}/{rng.randint(1, 31):02d}/20{number(2)}",
        lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: ".".join(str(rng.randint(0, 280)) for _ in range(4)), lambda: f"+{rng.choice(['49', '1', '351'])} {number(3)} {number(4)}", lambda: f"+44{number(8)}", lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: "".join(rng.choice("abcXYZ019._-") for _ in range(rng.randint(1, 64))) + "@Mail.example.org", lambda: rng.choice(["DE89370400440532013000", "GB82WEST12345698765432", "DE89370400440532013001"]), lambda: "word,", lambda: "7", lambda: "é",
    ]
    texts = [" ".join(rng.choice(make)() for _ in range(rng.randint(0, 12))) for _ in range(300)]
    want = []
    for t in texts:
        kinds, out, at = [], "", 0
        for m in re.finditer(P.FOUND, t, re.ASCII):
            found = _plain_pseudonym("k", m[0])
            kinds += [found[0]] if found else []
            out, at = out + t[at : m.start()] + (found[1] if found else m[0]), m.end()
        want.append((out + t[at:], kinds))
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:3])], "doc_id int, text string")
    got = [(r.doc_id, r.text, [f.kind for f in r.pii]) for r in P.pseudonymise(docs, key="k").collect()]
    assert [(g, texts[g[0]]) for g in got if g[1:] != want[g[0]]] == [] and [g[0] for g in got] == [*range(300), 0, 1, 2]
    assert len({k for _, kinds in want for k in kinds}) == 7
    assert P.pseudonymise(docs.limit(0)).count() == 0


def test_pii_links_values_in_different_formats(spark):
    rows = [(1, "2024-01-31 31.01.2024 31/01/2024 01/31/2024"), (2, "+49 30 123456, +4930123456, +49-30-123456"), (3, "(847) 555-7819 +1 847-555-7819 847.555.7819"), (4, "03/04/2021 2021-03-04"), (5, f"{'ab-9' * 16}@x.org and {'ab-9' * 15}ab-8@x.org")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    hidden = P.pseudonymise(docs, key="pairloom")
    got = [[f.pseudonym for f in r.pii] for r in hidden.orderBy("doc_id").collect()]
    day = date.fromisoformat(got[0][0])
    assert got[0][1:] == [day.strftime(f) for f in ("%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")] and day.day > 12
    assert len({re.sub(r"\D", "", x) for x in got[1]}) == 1 and all(x.startswith("+49") for x in got[1])
    assert len({re.sub(r"\D", "", x)[-10:] for x in got[2]}) == 1
    assert date.fromisoformat(got[3][1]).strftime("%m/%d/%Y") == got[3][0]
    assert "ab-9" not in got[4][0][40:] and "ab-9" not in got[4][1]
    assert [r.text for r in P.pseudonymise(hidden.select("doc_id", "text"), key="pairloom", invert=True).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_pii_in_long_texts(spark):
    big = 500_000
    texts = ["x@" + "a." * big, "x@" + "a-" * big, "a." * big + "@", "1 " * big + "+1" * 1000, "0.0.0." * big, "DE89 3704 " * big, "1111-" * big, "(" * big + "+" * big, "word " * big + "10.0.0.1"]
    got = P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)).selectExpr("doc_id", "length(text) as n", "size(pii) as found").collect()
    assert {(r.doc_id, r.found) for r in got} == {*((k, 0) for k in range(8)), (8, 1)} and all(r.n == len(texts[r.doc_id]) for r in got if r.doc_id < 8)


def test_pii_key_comes_from_the_session(spark):
    docs = spark.createDataFrame([(1, "10.0.0.1")], "doc_id int, text string")
    own = P.pseudonymise(docs).first().text
    assert own == P.pseudonymise(docs).first().text
    spark.conf.set("spark.pairloom.pii.secret", "mine")
    try:
        assert P.pseudonymise(docs).first().text == P.pseudonymise(docs, key="mine").first().text != own
    finally:
        spark.conf.unset("spark.pairloom.pii.secret")


def test_feistel_is_a_permutation(spark):
    out = spark.range(250 * 40).select(P.feistel("k", "t", F.floor(F.col("id") / 40), F.col("id") % 40, F.lit(250), F.lit(40), F.lit("")).alias("x")).distinct()
    assert out.count() == 10_000 and out.where("x.l < 0 or x.l >= 250 or x.r < 0 or x.r >= 40").count() == 0


def _brute_hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    patterns = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in patterns:
                    hit.update(range(k, k + n))
                    found |= patterns[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("part", [400_000, 30])
def test_decontamination_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(D, "PART_WINDOWS", part)
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "Cd", "é1", "x", "日本", "q-r"])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 25)))) for k in range(30)] + [(90, None), (91, ""), (92, "--"), (93, "Solo"), (None, "a b")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 80)))) for k in range(60)]
    docs += [(100 + k, f"start {t}, end" if t else None) for k, (_, t) in enumerate(items)] + [(5, "again"), (6, "ab " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("contamination", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = D.benchmark_hits(df, bench)
    assert whole._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1  # however many parts
    got = whole.select("doc_id", "contamination.n_words", D.hit_count(F.col("contamination")).alias("n_hit"), "contamination.items").collect()
    want = _brute_hits(docs, [i for i in items if i[0] is not None])
    key = lambda r: (r[0], r[1], r[2], str(r[3]))
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    clean = {r.doc_id for r in D.decontaminate(df, bench).collect()}
    assert clean == {w[0] for w in want if not w[2]} | ({5, 6} & clean)


def test_decontamination_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).count() == 1 and D.decontaminate(docs.limit(0), none).count() == 0
    assert hashlib.sha256(b"").hexdigest() == docs.select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]


def test_licences(spark):
    rows = [(1, "Prose.\nReleased under the  MIT license.\nMore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "word " * 5000), (7, "MIT"), (1, "again")]
    got = L.scan_licences(spark.createDataFrame(rows, "doc_id int, text string").withColumn("hits", F.lit(0))).collect()
    by = {(r.doc_id, r.licence): r for r in got}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.licence) for r in got} == {(1, "MIT"), (2, "GPL-3.0"), (3, "Apache-2.0"), (4, None), (5, None), (6, None), (7, None), (1, None)}
    assert [x.licence for x in by[3, "Apache-2.0"].licences] == ["Apache-2.0", "CC-BY-NC-4.0"] and by[2, "GPL-3.0"].score == 1.0


def test_licences_odd_input(spark):
    schema = "doc_id long, text string, licences string, hits int"
    assert L.scan_licences(spark.createDataFrame([], schema)).count() == 0
    notice = "Released under the MIT License."
    rows = [(1, None), (1, notice), (1, notice), (None, notice), (2, " \n\n "), (3, "x" * 1_000_000), (4, f"{'word ' * 200_000}\n{notice}\n{'line ' * 9}\n" * 2), (5, "* - *")]
    got = L.scan_licences(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], schema)).collect()
    assert [(r.doc_id, r.licence) for r in got] == [(1, None), (1, "MIT"), (1, "MIT"), (None, "MIT"), (2, None), (3, None), (4, "MIT"), (5, None)]


def _plain_licence(text):
    """By every passage and every template."""
    words = lambda t: re.findall(r"[^\W\d_]+|\d+(?:\.\d+)*", t.lower())
    grams = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w)
    known = {g for texts in L.TEMPLATES.values() for t in texts for g in grams(words(t))}
    runs, every = [], words(text)
    for k, w in enumerate(every):
        if k and f"{every[k - 1]} {w}" in known:
            runs[-1].append(w)
        else:
            runs.append([w])
    best = {}
    for passage in {*re.split(r"\n", text), *re.split(r"\n{2,}", text), text, *(" ".join(r) for r in runs if len(r) > 1)}:
        a = grams(words(passage))
        scored = [(-2 * len(a & b) / (len(a) + len(b)), name) for name, texts in L.TEMPLATES.items() for b in [grams(words(t)) for t in texts] if a and 2 * len(a & b) >= 0.8 * (len(a) + len(b)) - 1e-12]
        if scored:
            score, name = min(scored)
            best[name] = max(best.get(name, 0), -score)
    free = {n: x for n, x in best.items() if L.WITHIN.get(n) not in best}
    return (sorted(best), min(((-x, n) for n, x in free.items()), default=(None, None))[1])


def test_licences_against_brute_force(spark):
    rng = random.Random(12)
    notices = [t for texts in L.NOTICES.values() for t in texts if len(t.split()) < 60]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(notices).split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["thing", "the", "2.0", ""])
            parts.append(rng.choice(["", "Some prose.\n", "\n\n"]) + " ".join(w))
        texts.append(rng.choice(["\n", "\n\n", " "]).join(parts))
    got = L.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    want = [_plain_licence(t) for t in texts]
    assert [([x.licence for x in r.licences], r.licence) for r in got] == want and sum(bool(n) for n, _ in want) > 20


def test_licences_within_prose(spark):
    rows = [
        (1, "This tool is Released under the MIT License. Have fun with it, and tell us about it when you can."),
        (2, "Note that this work is licensed under a Creative Commons Attribution 4.0 International License, see below; all else is ours."),
        (3, "It was released under the terms that we licensed, and a version of the license is hereby kept."),
        (4, "word " * 50_000 + "licensed under the bsd 2-clause license " + "word " * 50_000),
    ]
    got = {r.doc_id: (r.licence, r.score) for r in L.scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {k: name for k, (name, _) in got.items()} == {1: "MIT", 2: "CC-BY-4.0", 3: None, 4: "BSD-2-Clause"}
    assert got[1][1] == pytest.approx(8 / 9)  # "is released" stands in templates too


def test_licences_of_long_passages(spark):
    notice = "Released under the MIT License."
    rows = [(1, " ".join([notice] * 30)), (2, "* " * 200 + notice + " - - -" * 200), (3, " ".join(f"w{k}" for k in range(20_000)))]
    got = {r.doc_id: (r.licence, r.score) for r in L.scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    # the line as a whole has 8 / 9, each notice in it 1
    assert got == {1: ("MIT", 1.0), 2: ("MIT", 1.0), 3: (None, None)}
    # sizes 2 and 3 stand exactly on the bound of 0.8
    edge = L.scan_licences(spark.createDataFrame([(1, "a b c")], "doc_id int, text string"), templates={"X": ["a b c d"]}).first()
    assert edge.score == 0.8


REAL = {
    "MIT": """Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.""",
    "BSD-2-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,""",
}


def test_real_licence_texts(spark):
    files = sorted(Path(L.__file__).parent.joinpath("licence_texts").glob("*.txt"))
    assert len(files) == 11
    rows = [(name, f"Some words of prose before it.\n\n{text}\n\nand some after it, with no notice at all.") for name, text in REAL.items()]
    rows += [(f.stem, f"Copyright (c) 2020 Somebody\n\n{f.read_text(encoding='utf-8')}") for f in files]
    got = L.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.licence) for r in got if r.licence != r.doc_id] == []


def test_licence_scores_against_brute_force(spark):
    text = "licensed under the apache license version two zero"
    grams = lambda t: set(zip(t, t[1:], strict=False))
    a, b = grams(text.split()), grams("licensed under the apache license version 2.0".split())
    r = L.scan_licences(spark.createDataFrame([(1, text)], "doc_id int, text string"), dice=0.5).first()
    assert r.licence == "Apache-2.0" and r.score == pytest.approx(2 * len(a & b) / (len(a) + len(b)))
    assert L.scan_licences(spark.createDataFrame([(1, text)], "doc_id int, text string"), templates={}).first().licence is None


def _brute_spans(rows, least):
    docs = {}
    for i, t in rows:
        if i is not None and t is not None:
            docs.setdefault(i, t.encode().lower().split())
    seen = {}
    for i, w in docs.items():
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(i, x) for i, w in docs.items() for k in range(len(w) - least + 1) if len(seen[tuple(w[k : k + least])]) > 1 for x in range(k, k + least)}


@pytest.mark.parametrize(("hot", "vocabulary"), [(20_000, 5000), (2, 5000), (20_000, 2), (3, 2)])
def test_repeated_passages_against_brute_force(spark, hot, vocabulary):
    rows = [r for r in _corpus(11, 50, 200, vocabulary) if r[0] != 1] + [(700, "und " * 300), (701, "und " * 120 + "x"), (702, "same " * 90)]
    got = S.repeated_passages(_frame(spark, rows), hot=hot).collect()
    assert {(r.doc_id, x) for r in got for x in range(r.start_word, r.end_word)} == _brute_spans(rows, 50)
    assert all(r.n_words >= 50 for r in got)


def test_repeated_passages_empty(spark):
    assert S.repeated_passages(_frame(spark, [])).count() == 0
    assert S.repeated_passages(_frame(spark, [(1, "short"), (2, None), (2, None)])).count() == 0


@pytest.mark.parametrize("hot", [4000, 15])
def test_repeated_line_within_few_documents(spark, hot):
    """Twenty texts with one line four hundred times: a row for each text, not for each place."""
    rng = random.Random(2)
    line = " ".join(f"l{k}" for k in range(30))
    rows = [(i, " ".join([f"own{i}", *[line] * 400, f"end{rng.random()}"])) for i in range(20)]
    got = S.repeated_passages(_frame(spark, rows), hot=hot).collect()
    assert {(r.doc_id, x) for r in got for x in range(r.start_word, r.end_word)} == _brute_spans(rows, 50)
    import pyarrow as pa

    text = rows[0][1].encode()
    keys = S.anchors(S.word_hashes(text, S.SPACE_WORDS), 50, 12)[0].view("int64").tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text]), pa.array([keys])], ["doc_id", "text", "keys"])
    made = next(S._suffix_rows(50, 12)([batch]))
    assert made.num_rows < 30 and sum(map(len, made.column("places").to_pylist())) > 390


def test_anchors_of_texts_longer_than_a_cut(monkeypatch):
    import numpy as np

    words = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = S.anchors(words, 50, 12)
    for cut in (64, 1000, 4999):
        monkeypatch.setattr(S, "WINDOWS", cut)
        assert all((a == b).all() for a, b in zip(whole, S.anchors(words, 50, 12), strict=True))
