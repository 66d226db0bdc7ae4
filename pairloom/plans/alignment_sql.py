"""Alignment in DuckDB's SQL, for oracles: longest matching blocks by a recursive CTE, opcodes and slots from them."""

from __future__ import annotations

from . import base as B

TURNS = ("conv_id, turn", B.SQL_TURNS)
#: The same pairs with their words as they are written.
WORDS = ("conv_id, turn", f"(SELECT conv_id, turn, {B.SQL_WORDS.format('source_text')} AS src, {B.SQL_WORDS.format('target_text')} AS tgt FROM {B.SQL_TURNS})")

#: Near copies of sentences, as `operators.pairing.near_pairs` pairs them.
_W = B.SQL_WORDS.format("sentence")
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 1) + 1), lambda s: array_to_string({0}[s:s + 1], ' ')))"
_NEAR = f"""(SELECT * FROM (SELECT a.doc_id, a.pos, b.doc_id AS other_doc_id, b.pos AS other_pos, a.sentence AS source_text, b.sentence AS target_text, a.w AS src, b.w AS tgt, a.s AS x, b.s AS y
FROM (SELECT DISTINCT prev, sentence FROM (SELECT sentence, lag(sentence) OVER (PARTITION BY k, h ORDER BY sentence) AS prev FROM (
SELECT sentence, k, list_min(list_transform(s, lambda g: md5(CAST(k AS VARCHAR) || g))) AS h FROM near_texts, (VALUES (0), (1), (2), (3)) t(k))) WHERE prev IS NOT NULL) l
JOIN near_texts a ON a.sentence = l.prev JOIN near_texts b ON b.sentence = l.sentence) WHERE len(list_intersect(x, y)) >= 0.2 * len(list_distinct(list_concat(x, y))))"""
_TEXTS = f"""near_texts AS MATERIALIZED (SELECT *, {_SHINGLES.format('w')} AS s FROM (SELECT sentence, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos, {_W} AS w FROM {B.SQL_SENTENCES} GROUP BY sentence) WHERE len(w) BETWEEN 4 AND 60)"""
NEAR = ("doc_id, pos, other_doc_id, other_pos", _NEAR)


def opcodes(source: tuple[str, str], columns: str = "src, tgt") -> str:
    """CTEs p (pairs), ops (tag, i1, i2, j1, j2) and slots (slot, a0, a1, i, op) over a source of pairs."""
    keys, pairs = source
    return f"""{_TEXTS + ', ' if source is NEAR else ''}p AS MATERIALIZED (SELECT {keys}, {columns} FROM {pairs}),
cells AS MATERIALIZED (SELECT {keys}, i, j, max(i) OVER (PARTITION BY {keys}, i - j, island) - i + 1 AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys}, i - j ORDER BY i) AS island
FROM (SELECT {keys}, unnest(src) AS w, generate_subscripts(src, 1) - 1 AS i FROM p) x JOIN (SELECT {keys}, unnest(tgt) AS w, generate_subscripts(tgt, 1) - 1 AS j FROM p) y USING ({keys}, w))),
q AS (SELECT {keys}, {{'a': CAST(0 AS BIGINT), 'b': CAST(len(src) AS BIGINT), 'c': CAST(0 AS BIGINT), 'e': CAST(len(tgt) AS BIGINT), 'n': CAST(0 AS BIGINT)}} AS r FROM p
UNION ALL SELECT {keys}, unnest([{{'a': i, 'b': i + n, 'c': j, 'e': j + n, 'n': n}}, {{'a': r.a, 'b': i, 'c': r.c, 'e': j, 'n': 0}}, {{'a': i + n, 'b': r.b, 'c': j + n, 'e': r.e, 'n': 0}}])
FROM (SELECT {keys}, r, i, j, least(run, r.b - i, r.e - j) AS n FROM q JOIN cells USING ({keys}) WHERE r.n = 0 AND i >= r.a AND i < r.b AND j >= r.c AND j < r.e QUALIFY row_number() OVER (PARTITION BY {keys}, r ORDER BY n DESC, i, j) = 1)),
blocks AS (SELECT {keys}, r.a AS i, r.c AS j, r.n AS n FROM q WHERE r.n > 0 UNION ALL SELECT {keys}, len(src), len(tgt), 0 FROM p),
gaps AS (SELECT {keys}, coalesce(lag(i + n) OVER w, 0) AS i1, i AS i2, coalesce(lag(j + n) OVER w, 0) AS j1, j AS j2 FROM blocks WINDOW w AS (PARTITION BY {keys} ORDER BY i, j, n DESC)),
ops AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i1, j1, i2, j2) - 1 AS op FROM (SELECT {keys}, 'equal' AS tag, i AS i1, i + n AS i2, j AS j1, j + n AS j2 FROM blocks WHERE n > 0
UNION ALL SELECT {keys}, CASE WHEN i1 < i2 AND j1 < j2 THEN 'replace' WHEN i1 < i2 THEN 'delete' ELSE 'insert' END, i1, i2, j1, j2 FROM gaps WHERE i1 < i2 OR j1 < j2)),
slots AS (SELECT *, CASE WHEN a0 IS NULL THEN 0 WHEN a1 IS NULL THEN 1 WHEN a0 <> a1 THEN 2 END AS kind, row_number() OVER (PARTITION BY {keys} ORDER BY op, k) - 1 AS slot
FROM (SELECT {keys}, op, k, CASE WHEN k < i2 - i1 THEN src[i1 + k + 1] END AS a0, CASE WHEN k < j2 - j1 THEN tgt[j1 + k + 1] END AS a1 FROM (SELECT *, unnest(range(greatest(i2 - i1, j2 - j1))) AS k FROM ops) JOIN p USING ({keys})))"""


def over(source: tuple[str, str], select: str, columns: str = "src, tgt") -> str:
    """A statement over the CTEs; {k} in it stands for the key columns."""
    return f"WITH RECURSIVE {opcodes(source, columns)} {select.replace('{k}', source[0])}"


#: Values of each pair from its opcodes, the pair without any included.
def per_pair(source: tuple[str, str], values: str, columns: str = "src, tgt") -> str:
    return over(source, f"SELECT {{k}}, {values} FROM p LEFT JOIN ops USING ({{k}}) GROUP BY {{k}}", columns)


EDITOR_OPS = "CAST(coalesce(sum(CASE WHEN tag = 'insert' THEN 1 WHEN tag <> 'equal' THEN i2 - i1 END), 0) AS INTEGER)"
HUNKS = "CAST(count(*) FILTER (WHERE tag <> 'equal') AS INTEGER)"
EDITED = "CAST(coalesce(len(list_distinct(flatten(list(CASE WHEN tag = 'insert' THEN [i1] ELSE range(i1, i2) END) FILTER (WHERE tag <> 'equal')))), 0) AS INTEGER)"
SIMILARITY = "round(CASE WHEN any_value(len(src) + len(tgt)) = 0 THEN 1.0 ELSE 2.0 * coalesce(sum(i2 - i1) FILTER (WHERE tag = 'equal'), 0) / any_value(len(src) + len(tgt)) END, 6)"
MARKUP = "coalesce(string_agg(CASE tag WHEN 'equal' THEN array_to_string(src[i1 + 1:i2], ' ') WHEN 'delete' THEN '~~' || array_to_string(src[i1 + 1:i2], ' ') || '~~' WHEN 'insert' THEN '**' || array_to_string(tgt[j1 + 1:j2], ' ') || '**' ELSE '~~' || array_to_string(src[i1 + 1:i2], ' ') || '~~ **' || array_to_string(tgt[j1 + 1:j2], ' ') || '**' END, ' ' ORDER BY op), '')"
TEMPLATE = "coalesce(string_agg(CASE tag WHEN 'equal' THEN repeat('K', j2 - j1) ELSE repeat('R', least(i2 - i1, j2 - j1)) || repeat('I', j2 - j1 - least(i2 - i1, j2 - j1)) END, '' ORDER BY op), '')"


def pair_gold(source: tuple[str, str], select: str) -> str:
    """CTE g: valid, input (-1 for a replaced, -2 for an inserted token, else its word), op_types of each pair."""
    found = """, b AS (SELECT {k}, bool_or(tag = 'insert' AND (i1 >= len(src) OR EXISTS (SELECT 1 FROM ops o WHERE o.tag IN ('replace', 'delete') AND o.i1 = ops.i1 AND KEYS))) OR bool_or(tag = 'replace' AND i2 - i1 <> j2 - j1) AS bad,
string_agg(CASE tag WHEN 'replace' THEN 'REPL' WHEN 'insert' THEN 'INS' ELSE 'DEL' END, ',' ORDER BY op) FILTER (WHERE tag <> 'equal') AS op_types,
CAST(coalesce(sum(CASE tag WHEN 'equal' THEN i2 - i1 WHEN 'replace' THEN i2 - i1 WHEN 'insert' THEN j2 - j1 ELSE 0 END), 0) AS INTEGER) AS n_input FROM p JOIN ops USING ({k}) GROUP BY {k}) """
    keys = " AND ".join(f"o.{k} = ops.{k}" for k in source[0].split(", "))
    return over(source, found.replace("KEYS", keys) + select)
