"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive_ann import nearest_neighbours
from .chat_format import digests, format_conversations
from .collocations import mine_collocations
from .decontamination import benchmark_hits, hit_count
from .html_text import extract_text
from .licences import scan_licences
from .ngram_jaccard import ngram_jaccard_join
from .packing import pack, token_pieces
from .pii import pseudonymise
from .sparse_suffix import repeated_passages
from .toxicity import score_toxicity, train
from .url_filter import filter_urls
from .vector_codes import encode_vectors, with_label_errors

#: The listed rules of op6.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join(F.transform("pii", lambda f: f["kind"]), ",").alias("kinds"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, _table(spark, sf_dir, "benchmark"), into="found").select("doc_id", "found")
    hits, names = hit_count(F.col("found")), F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.transform("licences", lambda h: h["licence"]), ",").alias("licences"), "licence", F.round("score", 6).alias("score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_RULES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")), into="score")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_errors(*encode_vectors(_table(spark, sf_dir, "embeddings")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings, formatted with the others.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.createDataFrame([(-7, k, role, ODD_TEXT) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(odd)))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_pii": op2_pii,
    "op3_html_text": op3_html_text,
    "op4_decontamination": op4_decontamination,
    "op5_licences": op5_licences,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_ann": op8_ann,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_chat_format": op13_chat_format,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_PIECES = r"""(SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents))"""


def _sql_codes(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Components as rows (vec_id, part, place, x); each round assigns parts to entries and takes their floored means."""
    near = "SELECT vec_id, p, e, d FROM (SELECT v.vec_id, v.p, b.e, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS d FROM v JOIN b{0} b ON b.p = v.p AND b.i = v.i GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1"
    steps = [f"b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, i, x FROM v WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE {_FINE} ORDER BY vec_id LIMIT {entries}))"]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k)})")
        steps.append(f"m{k} AS (SELECT p, e, i, sum(x) AS s, count(*) AS c FROM v JOIN a{k} USING (vec_id, p) GROUP BY ALL)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, i, CASE WHEN c IS NULL THEN x ELSE CAST((s - ((s % c) + c) % c) // c AS BIGINT) END AS x FROM b{k} LEFT JOIN m{k} USING (p, e, i))")
    last = f"z AS MATERIALIZED ({near.format(rounds)})"
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, k // n AS p, k % n AS i, CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS k, len(embedding) // {parts} AS n FROM embeddings WHERE {_FINE})),
{", ".join(steps)}, {last},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN embeddings USING (vec_id)"""


_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: Backslashes, places where `###` begins, places where `</turn>` begins (which cannot overlap), and colons in roles.
_COUNT = "(length({0}) - length(replace({0}, '{1}', '')))"
_ESCAPES = _COUNT.format("{0}", "\\") + " + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda h: length(h) - 2)), 0) + " + _COUNT.format("{0}", "</turn>") + " // 7"

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
ks AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT g.doc_id, g.k, g.s, p.item_id FROM g JOIN p USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT doc_id, k, s FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_vector_codes": _sql_codes(),
    "op12_collocations": f"""
WITH w AS MATERIALIZED {_PIECES},
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.k, c.a, j, l.f AS l, r.f AS r, CAST((CAST(c.a AS HUGEINT) * c.a * 1000000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3),
x AS (SELECT lang, phrase, max(a) AS above FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM m LEFT JOIN x USING (lang, phrase) JOIN n USING (lang) WHERE above IS NULL OR 100 * above < 50 * a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op13_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, k, r, '{ODD_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + length(text) + {_ESCAPES.format("role")} + {_COUNT.format("role", ":")} + {_ESCAPES.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}
