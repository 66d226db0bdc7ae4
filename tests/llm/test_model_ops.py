"""HTML text, URL filter, packing, nearest neighbours, toxicity."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from pairloom.llm import additive_ann as A
from pairloom.llm import html_text as H
from pairloom.llm import packing as K
from pairloom.llm import toxicity as T
from pairloom.llm import url_filter as U
from pairloom.llm.queries import URL_RULES, tokenizer_path

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, please agree.</p></div><article><h1>T &amp; U</h1><p><b>First, a paragraph  of text.<br><p>Second &eacute; one,
with a line.</p><div class="advert">Buy now, really, do it!</div><ul><li>one<li>two</ul><form><p>Your name?</p></form></article><aside class="sidebar"><p>Aside, a long long text. With much. Punctuation, too.</p></aside>
<section id="comments"><p>I like it, very much, thank you. Really good.</p></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "T & U\nFirst, a paragraph of text.\nSecond é one, with a line.\none\ntwo"),
        (None, ""), ("", ""), ("plain  text &amp; more", "plain text & more"), ("<p>open <b>bold", "open bold"), ("<div><!-- cut", ""), ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<html><body><div id=main><h2>H</h2><p>One, two. Three.</p><p>Four, five. Six.</p></div><div class=footer>f</div></body></html>", "H\nOne, two. Three.\nFour, five. Six."),
        ("<script>x</script>", ""), ("<article></article>", ""),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


LONG = "A long sentence of the body, with some commas, and a stop. " * 8


def test_main_text_outside_the_heaviest_element():
    page = f"<body><div><h1>The title, here.</h1><p>{LONG[:240]}</p><section><p>{LONG * 2}</p><p>{LONG * 2}</p><p>{LONG * 2}</p></section><p>{LONG[:300]}</p></div></body>"
    found = H.main_text(page).split("\n")
    assert len(found) == 6 and found[0] == "The title, here." and found[1] == LONG[:240].strip() and found[5] == LONG[:300].strip()


def test_main_text_takes_article_for_a_tag_like_others():
    body = "".join(f"<p>{LONG}</p>" for _ in range(3))
    card = "<article><h3>More</h3></article><hr><div><a href=/x>all</a></div>"
    found = H.main_text(f"<body>{card}<div>{body}</div></body>").split("\n")
    assert found.count(LONG.strip()) == 3 and "More" not in found
    assert H.main_text(f"<body><main>{body}<article><p>Card</p></article></main></body>").count(LONG.strip()) == 3
    parts = f"<article><h2>One.</h2><p>{LONG}</p></article><article><p>{LONG[:120]}</p></article><article><p>{LONG}</p><p>{LONG}</p></article>"
    assert len(H.main_text(f"<body><main>{parts}</main></body>").split("\n")) == 5


def test_main_text_in_forms():
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    whole = ["Title", LONG.strip(), LONG.strip()]
    assert H.main_text(f'<body><form id="aspnetForm"><div>{body}</div></form></body>').split("\n") == whole
    assert H.main_text(f"<body><p>Top.</p><form><fieldset>{body}</fieldset></form></body>").split("\n")[-3:] == whole
    assert H.main_text(f'<body><div role="form">{body}</div></body>').split("\n") == whole
    assert H.main_text(f"<body><div>{body}<form><p>Your name?</p></form></div></body>").split("\n") == whole
    assert H.main_text("<body><form><a href=/x>all in links</a></form></body>") == "all in links"


def test_path_ratios_choose_without_names():
    """No tag, role or class name tells the parts: link lists, a short line and a notice are left out by their ratios alone."""
    links = "".join(f'<li><a href="/{k}">place {k}</a></li>' for k in range(9))
    page = f"<body><div><ul>{links}</ul></div><div><em>Short line</em></div><div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div></div><div><div><b>c 2020</b></div></div></body>"
    assert H.main_text(page).split("\n") == ["Title", LONG.strip(), LONG.strip()]
    page = f"<body><article><ul>{links}</ul></article><article><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div></article></body>"
    assert H.main_text(page).split("\n") == ["Title", LONG.strip(), LONG.strip()]


def _neutral(page):
    """The page without what tags, roles and class names say."""
    page = re.sub(r"<(/?)(?:nav|header|footer|aside|menu|form|fieldset|article|main|section)\b", r"<\1div", page)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', ' class="x"', page)


def test_ratios_decide_without_names(spark, monkeypatch):
    """Of the given pages nine in ten keep their texts with ratios alone, and with all marks taken out of the page."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    texts = [H.main_text(p) for p in pages]
    assert sum(H.main_text(_neutral(p)) == t for p, t in zip(pages, texts, strict=True)) >= 0.9 * len(pages)
    monkeypatch.setattr(H, "PRIOR", 1)
    assert sum(H.main_text(p) == t for p, t in zip(pages, texts, strict=True)) >= 0.9 * len(pages)
    # the marks kept, but all ratios equal: advertisements, menus and footers without names come through
    monkeypatch.setattr(H, "path_ratios", lambda page: ({p: 1.0 for *_, p in page.blocks}, {p: 1.0 for *_, p in page.blocks}))
    assert sum(H.main_text(_neutral(p)) == t for p, t in zip(pages, texts, strict=True)) < 0.1 * len(pages)


def test_link_lists_and_headlines_without_names():
    text = "".join(f"<p>{LONG}</p>" for _ in range(3))
    links = "<ul><li><a>Home</a></li><li><a>News</a></li></ul>"
    assert H.main_text(f"<body>{text}{links}</body>").split("\n") == [LONG.strip()] * 3
    assert H.main_text(f"<body>{links}<div>{text}{links}</div></body>").split("\n") == [LONG.strip()] * 3
    assert H.main_text(f"<article><header><h1>The title</h1></header>{text}</article>").split("\n") == ["The title", *[LONG.strip()] * 3]
    assert H.main_text(f"<body><header><h1>Site</h1></header><div><h2><a href=/x>Linked title</a></h2>{text}</div></body>").split("\n") == ["Linked title", *[LONG.strip()] * 3]
    assert H.main_text(f"<body><div>{text}<ul><li>one</li><li>two</li></ul></div></body>").split("\n")[3:] == ["one", "two"]


def _random_page(rng):
    """(html, blocks) of a random tree: a block's path holds (tag, marked, number) from the root; leaves hold text alone."""
    parts, found, opened = [], [], [0]

    def grow(tag, marked, above):
        opened[0] += 1
        path = (*above, (tag, marked, opened[0]))
        parts.append(f'<{tag} class="{"sidebar" if marked else "x"}">')
        if tag == "p":
            text = " ".join(rng.choice(["ab", "cd.", "efg,", "h"]) for _ in range(rng.randint(1, 40)))
            linked = rng.random() < 0.2
            parts.append(f"<a>{text}</a>" if linked else text)
            found.append((path, text, len(text) if linked else 0))
        else:
            for _ in range(rng.randint(0, 3)):
                grow(rng.choice(["p", "p", "div", "section", "article"]) if len(path) < 5 else "p", rng.random() < 0.15, path)
        parts.append(f"</{tag}>")

    for _ in range(3):
        grow("div", False, ())
    return "".join(parts), found


def _plain_content(found):
    """The definition, on whole paths and without any numbering."""
    kind = lambda path: tuple(x[:2] for x in path)
    groups = defaultdict(list)
    for path, text, linked in found:
        groups[kind(path)].append((len(text) - linked, sum(text.count(c) for c in ".,")))
    whole = sum(x[0] for g in groups.values() for x in g) or 1
    density = {p: (H.PRIOR if any(m for _, m in p) else 1) * sum(x[0] for x in g) / len(g) * (1 + sum(x[1] for x in g) / len(g)) ** 0.5 for p, g in groups.items()}
    fused = {p: density[p] * sum(x[0] for x in g) / whole for p, g in groups.items()}

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return 0.1 ** (max(len(a), len(b)) - n)

    kinds, smooth = [kind(p) for p, *_ in found], defaultdict(list)
    for k, own in enumerate(kinds):
        near = [kinds[max(k - 1, 0)], kinds[min(k + 1, len(kinds) - 1)]]
        smooth[own].append((4 * fused[own] + sum(common(own, o) * fused[o] for o in near)) / (4 + sum(common(own, o) for o in near)))
    scores = {p: sum(x) / len(x) for p, x in smooth.items()}
    best = max(scores.values(), default=0)
    chosen = {p for p, x in scores.items() if x >= H.PATH_SHARE * best}
    fullest = max((density[p] for p in chosen), default=0)  # all paths end in p
    chosen |= {p for p in density if density[p] >= H.DENSE_SHARE * fullest}
    around = {path[-2][2] for path, *_ in found if kind(path) in chosen}

    def back(number, marked):
        own = [(path, text, linked) for path, text, linked in found if any(x[2] == number for x in path)]
        reached = any(scores[kind(path)] >= H.RETURN_SHARE * best for path, *_ in own)
        plain = sum(len(t) - n for _, t, n in own) * (H.PRIOR if marked else 1)
        return reached and not marked or plain >= 0.5 * sum(len(t) for _, t, _ in own)

    def kept(path):
        inside = False
        for _, marked, number in path:
            inside = number in around or inside and back(number, marked)
        return inside

    return [text for path, text, _ in found if kind(path) in chosen or kept(path)]


def test_content_against_the_definition():
    rng = random.Random(6)
    for _ in range(300):
        page, found = _random_page(rng)
        assert H.main_text(page) == "\n".join(_plain_content(found)), page


def test_deep_pages_take_linear_time():
    began = time.time()
    deep = 100_000
    assert H.main_text("<div>" * deep + "text") == "text"
    assert H.main_text("<x-y>" * deep + "a" + "</q>" * deep + "</i>" * deep) == "a"
    assert H.main_text("<b>" * deep + "a" + "</b>" * deep + "<li>b" * 1000).startswith("a")
    H.main_text("".join(f"<x-{k}>t, t." for k in range(deep)))
    assert time.time() - began < 30


def test_extract_text_frame(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "y"), (3, "<p>" + "long text, yes. " * 50_000 + "</p>", "z")], "page_id int, html string, text string")
    got = H.extract_text(df).collect()
    assert len(got) == 4 and got[2].text == "" and len(got[3].text) == 16 * 50_000 - 1
    assert H.extract_text(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x=/fr/", "http://b.example.net/de/1", "http://example.com/de/", "http://x.example.com/de/1#y", "http://q.org/fr/2", "http://q.org/en/2", "http://spam-farm.example.org/en/1", "http://m.casino-win.example.com/fr/9", "no scheme", None, "http://net", "http://net/", "http://internet/x", "http://a.org/frx"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, hit int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(14)], "doc_id long, quality int, toxic int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, labels, URL_RULES).orderBy("page_id").collect()]
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[14] == got[0]
    assert [g[2] for g in got[1:6]] == ["net/", "example.com/de/", "example.com/de/", "org/fr/", None]
    assert [g[3] for g in got[1:8]] == ["block", "block", "block", "allow", "allow", "block", "block"]
    assert got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2] is None and got[11][2] == "net/" and got[12][2] is None and got[13][2] is None


def _plain_url_filter(pages, labels, rules, min_support, min_confidence, min_count):
    """Verdicts by trying every combination of tokens that occurs."""
    from itertools import combinations

    def parse(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].translate(LOWER), m[2]) if m else ("", "")

    def token_set(host, path):
        words = host.split(".")[:-1] + path.lower().split("/")
        return frozenset(t for w in words for t in re.findall(r"[^\W\d_]+", w) if len(t) >= U.MIN_LETTERS and t not in U.PLAIN_TOKENS)

    judged = {}
    for i, quality, toxic in labels:
        judged[i] = judged.get(i, False) or quality == 0 or toxic == 1
    parsed = [(i, *parse(u)) for i, u in pages]
    baskets = []
    for i, h, p in parsed:
        own = token_set(h, p)
        seed = bool(own & set(U.SEED_WORDS))
        if seed or i in judged:
            baskets.append((own, seed or judged.get(i, False), seed))
    counts, bad, seeds = Counter(), Counter(), Counter()
    for own, is_bad, is_seed in baskets:
        for n in range(1, len(own) + 1):
            for c in map(frozenset, combinations(own, n)):
                counts[c] += 1
                bad[c] += is_bad
                seeds[c] += is_seed
    enough = lambda n: n >= max(1, min_support * len(baskets)) - 1e-9
    mined = {c for c in counts if enough(bad[c]) and bad[c] >= min_count and bad[c] >= min_confidence * counts[c] or enough(seeds[c]) and seeds[c] >= min_confidence * counts[c]}
    out = []
    for i, h, p in parsed:
        fits = [(r, v) for r, v in rules if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
        rule, verdict = min(fits, key=lambda f: -len(f[0]), default=(None, "block" if any(c <= token_set(h, p) for c in mined) else "allow"))
        out.append((i, h, p, rule, verdict))
    return out, mined


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_urls_against_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "trap", "casino", "news", "blog"]
    make = lambda: f"http://{rng.choice(['www.', '', 'A.'])}{rng.choice(words)}-{rng.choice(words)}.{rng.choice(['example.org', 'example.net', 'Example.com'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.choice(words)}.html?x={rng.choice(words)}"
    pages = [(k, make()) for k in range(400)] + [(400, None), (401, "no scheme"), (402, "http://x.org/" + "trap/" * 50_000), (0, "http://trap.example.org/")]
    # "trap" with "beta" is what labels call bad; else some are bad by chance
    labels = [(k, int(rng.random() > 0.1), int("trap" in u and "beta" in u)) for k, u in pages if u and k % 3 and k < 402] + [(None, 0, 1), (1, None, None), (4, 0, 0), (4, 1, 0)]
    args = {"min_support": 0.01, "min_confidence": 0.8, "min_count": 5}
    want, mined = _plain_url_filter(pages, [x for x in labels if x[0] is not None and x[1] is not None], URL_RULES, **args)
    got = U.filter_urls(spark.createDataFrame(pages, "page_id long, url string").withColumn("tokens", F.lit(0)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), URL_RULES, **args).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert frozenset(["trap", "beta"]) in mined and any(r.verdict == "block" and r.rule is None and "casino" not in r.host + r.path for r in got)


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://fine.example.org/a")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert U.filter_urls(pages, labels).first().verdict == "allow" and U.filter_urls(pages.limit(0), labels).count() == 0


ODD = ["", None, "  \n\t x", "<|endoftext|> a", "a <|endoftext|> b", "x  <|endoftext|><|endoftext|>  \n<|endoftext", "<|endoftext|>", "日本語 テスト 123", "a b c", "é́ ñ ½ Ⅷ ²", "😀👍🏽 it's I'LL we've", "\x1c\x1d x", "a" * 3000, " " * 500 + "x", "don’t ''s 's", "word " * 5000]


def test_token_bytes_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    fast = K.TokenBytes(tokenizer_path())
    assert fast.fast is not None
    rng = random.Random(3)
    planes = ["".join(chr(c) + rng.choice(["", " ", "a", "1"]) for c in range(p, p + 256) if not 0xD800 <= c < 0xE000) for p in range(0, 0x20000, 256)]
    for text in [*ODD, *planes]:
        assert np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() == fast(text or "")


def test_fullest_against_brute_force():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(rng.randint(1, 15) for _ in range(rng.randint(0, 8)))
        room = rng.randint(0, 40)
        items = list(counts.elements())
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room)
        found = K.fullest(dict(counts), room)
        assert sum(found) == best and not Counter(found) - counts


@pytest.mark.parametrize("per_salt", [50_000, 7])
def test_packing(spark, per_salt):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "be", "gam"]) for _ in range(rng.randint(1, 900))) for _ in range(200)), *["same text"] * 100]
    docs = spark.createDataFrame([(k % 290, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("length", F.lit(0))
    rows = K.pack(K.token_pieces(docs, tokenizer_path()), per_salt=per_salt).collect()
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        n = len(ids) // 4
        at = [0, *range(n % 2048 or 2048, n + 1, 2048)]
        want.update((k % 290, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert K.pack(K.token_pieces(docs.limit(0), tokenizer_path())).count() == 0


def test_plan_uses_every_rank_once():
    counts = {5: 7, 9: 3, 2048: 2, 1000: 5}
    used = Counter()
    for pattern, times in K.minimum_bin_slack(counts, 2048):
        assert sum(pattern) <= 2048
        for x in pattern:
            used[x] += times
    assert used == Counter(counts)


def _brute(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            scored = sorted(((-float(np.dot(x, y)), i) for i, y in rows if i != q))[:k]
            out[q] = [i for _, i in scored]
    return out


def test_neighbours_exact_on_small_tables_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = [(i, rng.standard_normal(8).astype(np.float32).astype(float)) for i in range(130)]
    base[7] = (7, base[3][1])
    rows = [(i, [float(v) for v in x]) for i, x in base]
    odd = [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0] * 7 + [None]), (280, [1.0] * 7 + [float("inf")]), (300, []), (None, [1.0] * 8), (320, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("exact", F.lit(0))
    got = defaultdict(list)
    for r in A.nearest_neighbours(df, lambda v: v % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = _brute(base, 20)
    assert {q: [v for v, _ in x] for q, x in got.items()} == want
    vectors = dict(base)
    assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[v])), abs=1e-12) for q, x in got.items() for v, s in x)


def _recall(spark, rows, k=20, **options):
    """Share of the true neighbours found, with the production candidates; what is found has its exact score."""
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in A.nearest_neighbours(df, lambda v: v % 20 == 0, k=k, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    shares = []
    for at in np.flatnonzero(ids % 20 == 0):
        near = x @ x[at]
        near[at] = -np.inf
        best = ids[np.lexsort((ids, -near))[:k]]
        found = got[ids[at]]
        assert len(found) == k and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == pytest.approx(float(x[np.flatnonzero(ids == v)[0]] @ x[at]), rel=1e-13) for v, s in found)
        shares.append(len({v for v, _ in found} & set(best.tolist())) / k)
    assert len(got) == len(shares)
    return np.mean(shares)


def test_neighbours_recall_and_blocks(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    assert _recall(spark, rows, rerank=60, code_block=100) >= 0.99
    assert _recall(spark, rows, rerank=25, code_block=100_000) >= 0.6  # candidates decide


def test_neighbours_recall_at_size(spark):
    """More vectors than the sample that fits the codebooks."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v) for k, v in enumerate(x) if k % 20 or k % 400 == 0]
    assert _recall(spark, rows, code_block=16 * 65_536) >= 0.9


def _same_as_brute(spark, x, metric="inner"):
    """All neighbours of all queries in double precision, products of no value last."""
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in A.nearest_neighbours(df, lambda v: v % 20 == 0, metric=metric).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    lost = 0
    with np.errstate(all="ignore"):
        for q in range(0, len(x), 20):
            near = (x * x[q]).sum(axis=1) if metric == "inner" else -((x - x[q]) ** 2).sum(axis=1)
            near = np.where(np.isnan(near), -np.inf, near)
            order = [k for k in np.lexsort((np.arange(len(x)), -near)).tolist() if k != q][:20]
            lost += len(set(order) - set(got[q]))
    return lost


@pytest.mark.parametrize(("rows", "large"), [((3, 50, 120), 1e200), ((5,), 1e20), ((5,), 1e25), ((0, 20, 33), 1e100), ((7, 9), 1e-200), (range(400), 1e-150), (range(400), 1e140)])
def test_neighbours_of_any_magnitude(spark, rows, large):
    x = np.random.default_rng(4).standard_normal((400, 16))
    x[list(rows)] *= large
    assert _same_as_brute(spark, x) == 0


def test_neighbours_by_distance_of_any_magnitude(spark):
    x = np.random.default_rng(5).standard_normal((300, 8))
    x[[3, 40, 41]] *= 1e30
    assert _same_as_brute(spark, x, "l2") == 0


def test_neighbours_do_not_depend_on_cores_or_partitions(spark):
    import inspect

    assert "defaultParallelism" not in inspect.getsource(A)
    x = np.random.default_rng(6).standard_normal((3_000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, A.nearest_neighbours(df.repartition(n), lambda v: v % 20 == 0, rerank=20).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_neighbours_few_or_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in A.nearest_neighbours(two, lambda v: v % 20 == 0).collect()] == [(0, 1, 1)]
    assert A.nearest_neighbours(two.limit(0), lambda v: v % 20 == 0).count() == 0


def test_quantiser_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(0).standard_normal((600, 16)).astype(np.float32)
    errors = []
    for beam in (1, 8):
        model = A.AdditiveQuantiser(x, books=4, words=16, beam=beam)
        codes = model.encode(x)
        errors.append(((x - model.decode(codes)) ** 2).sum())
        assert np.allclose(model.norms(codes), (model.decode(codes) ** 2).sum(axis=1))
        assert np.allclose(model.scores(x[:3], np.zeros(3, int), codes, model.norms(codes), np.zeros(len(x), int), "inner"), x[:3] @ model.decode(codes).T, atol=1e-3)
    assert errors[1] <= errors[0]


def _labelled(n, seed):
    rng = random.Random(seed)
    stop = {"en": "the and of to", "de": "der und die ist"}
    docs, labels = [], []
    for i in range(n):
        lang, toxic = ("en", "de")[i % 2], i % 4 == 0
        words = [rng.choice(stop[lang].split()) if rng.random() < 0.4 else f"w{rng.randint(0, 800)}" for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randint(0, len(words) - 1)] = f"{'scum' if lang == 'en' else 'vequ'}{rng.choice(['', 'en', 'a', f'x{i}'])}"
        docs.append((i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(1600, 1)
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "the " * 60_000, "en"), (5, docs[5][1], "fr")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").withColumn("toxicity", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.train(d, lab)
    rows = T.score_toxicity(d, model).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.toxicity <= 1 for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [(r.toxicity >= 0.5, truth[r.doc_id]) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) >= 0.95
    again = T.score_toxicity(d.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1), model).collect()
    assert [r.toxicity for r in again] == [r.toxicity for r in rows]


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.score_toxicity(d, T.train(d, none)).first().toxicity == 0.0
    assert T.score_toxicity(d.limit(0), T.train(d, none)).count() == 0


def test_calibration_texts_are_never_fitted(spark, monkeypatch):
    docs, labels = _labelled(800, 2)
    seen = {}
    monkeypatch.setattr(T.Cnn, "fit", lambda self, texts, y: seen.update(fit=[t.tobytes() for t in texts]))
    monkeypatch.setattr(T.Cnn, "calibrate", lambda self, texts, y: seen.update(check=[t.tobytes() for t, _ in texts]))
    T.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = {T.features(t.encode())[0].tobytes() for i, t, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    fit, check = set(seen["fit"]), set(seen["check"])
    assert not fit & check and not (fit | check) & held and len(fit) + len(check) + len(held) == 800 and 100 < len(check) < 250


def test_pooling_against_plain_convolution():
    model = T.Cnn()
    ids = np.random.default_rng(5).integers(0, T.BUCKETS, (40, 3)).astype(np.int32)
    for n in (40, 2, 1, 0):
        words = [sum(model.table[b].astype(float) for b in row) for row in ids[:n]] + [np.zeros(T.DIMS)] * max(0, 3 - n)
        total = float(model.bias)
        for k, kernel in enumerate(model.kernels):
            for f in range(T.FILTERS):
                responses = [sum(float(words[at + w] @ kernel[w, :, f]) for w in range(len(kernel))) for at in range(len(words) - len(kernel) + 1)]
                total += max(responses) * float(model.out[k * T.FILTERS + f])
        assert model.logit(ids[:n]) == pytest.approx(total, abs=1e-4)


def test_long_texts_are_pooled_whole():
    model = T.Cnn()
    ids = np.random.default_rng(0).integers(0, T.BUCKETS, (500, 3)).astype(np.int32)
    whole = model.logit(ids)
    old = T.PIECE
    T.PIECE = 40
    try:
        assert model.logit(ids) == pytest.approx(whole, rel=1e-5)
    finally:
        T.PIECE = old
