"""Queries: documents, sentences, sampling, text functions and verdict parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions.hashing import crc_of, lcg, sql_lcg, sql_uniform, uniform
from pairloom.operators import sampling as S
from pairloom.sources import readers as R

from . import base as B
from .registry import query

_QUALITY = r"""length(trim(sentence)) > 0 AND len(list_filter(regexp_split_to_array(trim(sentence), '\s+'), lambda x: x <> '')) >= 3
 AND length(regexp_replace(trim(sentence), '\P{L}', '', 'g')) / length(trim(sentence)) >= 0.5
 AND regexp_matches(trim(sentence), '[.!?。！？…‼⁇⁈⁉]["''”’)\]》]*$') AND NOT regexp_matches(trim(sentence), 'https?://|www\.[A-Za-z0-9]')
 AND NOT regexp_matches(trim(sentence), '^\s*(?:[*\-•]|\d{1,3}[.)]|[a-zA-Z][.)])\s+') AND NOT regexp_matches(trim(sentence), '[^\p{L}\p{N}_\s\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}]{5,}')"""


@query("f3_quality_sentences", f"SELECT lang, count(*) AS n, round(avg(length(sentence)), 6) AS mean_chars FROM {B.SQL_SENTENCES} WHERE {_QUALITY} GROUP BY lang")
def f3_quality_sentences(spark, d):
    kept = B.sentences(spark, d).where(T.ProseQuality()(F.col("sentence")))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("sentence")), 6).alias("mean_chars"))


@query("f1_sentences", f"SELECT doc_id, pos, sentence FROM {B.SQL_SENTENCES}")
def f1_sentences(spark, d):
    return B.sentences(spark, d).select("doc_id", "pos", "sentence")


_SQL_SPLIT = "list_filter(list_transform(regexp_extract_all(text, '" + T.SQL_SPLITTER.replace("'", "''") + "'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query("f1_split_sentences", f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {_SQL_SPLIT} AS s FROM documents)")
def f1_split_sentences(spark, d):
    return B.documents(spark, d).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("f2_sentence_length_filter", f"SELECT doc_id, count(*) AS n, min(length(sentence)) AS shortest, max(length(sentence)) AS longest FROM {B.SQL_SENTENCES} WHERE length(sentence) BETWEEN 16 AND 2000 GROUP BY doc_id")
def f2_sentence_length_filter(spark, d):
    kept = S.eligible(B.sentences(spark, d), F.length("sentence"), 16, 2000)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.length("sentence")).alias("shortest"), F.max(F.length("sentence")).alias("longest"))


@query("f4_head_cap", f"SELECT doc_id, pos, sentence FROM {B.SQL_SENTENCES} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3")
def f4_head_cap(spark, d):
    return S.head(B.sentences(spark, d), 3, by=["doc_id"], order="pos").select("doc_id", "pos", "sentence")


@query("f5_random_cap", f"SELECT doc_id, pos FROM {B.SQL_SENTENCES} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {sql_lcg('doc_id * 1000003 + pos', 7)}, doc_id * 1000003 + pos) <= 3")
def f5_random_cap(spark, d):
    return S.random_rows(B.sentences(spark, d), 3, by=["doc_id"], key=F.col("doc_id") * 1000003 + F.col("pos"), seed=7).select("doc_id", "pos")


@query("f6_stride_cap", f"SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM {B.SQL_SENTENCES}) WHERE list_contains([CAST(floor(k * c / 4) AS BIGINT) FOR k IN range(4)], i)")
def f6_stride_cap(spark, d):
    return S.stride_rows(B.sentences(spark, d), 4, by=["doc_id"], order="pos").select("doc_id", "pos")


@query("f7_eligible_ids", f"SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx FROM {B.SQL_SENTENCES} WHERE len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')) BETWEEN 5 AND 256")
def f7_eligible_ids(spark, d):
    kept = S.eligible(B.sentences(spark, d), F.size(T.words(F.col("sentence"))), 5, 256)
    return S.number_rows(kept, "doc_id", "pos").select("doc_id", "pos", "idx")


@query("f8_regex_prefilter", rf"SELECT lang, count(*) AS n FROM {B.SQL_SENTENCES} WHERE regexp_matches(sentence, '(^| )(the|der|le|el) ') GROUP BY lang")
def f8_regex_prefilter(spark, d):
    return B.sentences(spark, d).where(F.col("sentence").rlike(r"(^| )(the|der|le|el) ")).groupBy("lang").agg(F.count("*").alias("n"))


@query("f9_stride_partition", "SELECT doc_id % 4 AS worker, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def f9_stride_partition(spark, d):
    docs = B.documents(spark, d)
    parts = [S.partition_rows(docs, F.col("doc_id"), 4, k).select(F.lit(k).cast("long").alias("worker"), "n_chars") for k in range(4)]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return whole.groupBy("worker").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("f10_skip_first", "SELECT count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS idx FROM documents) WHERE idx > 25")
def f10_skip_first(spark, d):
    return S.skip_rows(S.number_rows(B.documents(spark, d), "doc_id", start=1), F.col("idx"), 25).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("f11_first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def f11_first_rows(spark, d):
    return S.limit_rows(B.documents(spark, d).select("doc_id", "n_chars"), 50, "doc_id")


@query("f12_shard_holdout", "SELECT source, count(*) AS n FROM documents WHERE CAST(substr(source, 4) AS INTEGER) BETWEEN 15 AND 17 GROUP BY source")
def f12_shard_holdout(spark, d):
    shard = F.substr(F.col("source"), F.lit(4)).cast("int")
    return S.hold_out_shards(B.documents(spark, d), shard, 15, 3).groupBy("source").agg(F.count("*").alias("n"))


def _parts(spark, d):
    return B.table(spark, d, "part").withColumn("families", F.split("p_type", " "))


@query("f13_family_filter", "SELECT p_type, count(*) AS n FROM part WHERE NOT list_has_any(string_split(p_type, ' '), ['STEEL']) AND list_has_any(string_split(p_type, ' '), ['ECONOMY', 'STANDARD', 'SMALL', 'PROMO', 'LARGE', 'MEDIUM']) GROUP BY p_type")
def f13_family_filter(spark, d):
    kept = S.keep_families(_parts(spark, d), "families", ["STEEL"], ["ECONOMY", "STANDARD", "SMALL", "PROMO", "LARGE", "MEDIUM"])
    return kept.groupBy("p_type").agg(F.count("*").alias("n"))


@query("f14_family_derivation", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'TENSE|PROMO:x' ELSE 'Q' END AS kind, CASE WHEN p_size % 2 = 0 THEN ['TENSE', 'MODALITY'] ELSE ['INTERROG'] END AS families FROM part")
def f14_family_derivation(spark, d):
    known = {"TENSE": "TENSE", "MOD": "MODALITY", "Q": "INTERROG"}
    p = B.table(spark, d, "part").withColumn("even", F.col("p_size") % 2 == 0)
    t_type = F.when(F.col("even"), "TENSE:a->b+MOD/x:c").otherwise("Q:wh")
    found = S.families(F.lit(None).cast("string"), t_type, known, F.lit(True))
    return p.select("p_partkey", F.when(F.col("even"), "TENSE|PROMO:x").otherwise("Q").alias("kind"), found.alias("families"))


@query("f15_shuffled_sample", f"SELECT doc_id FROM documents ORDER BY {sql_lcg('doc_id', 42)}, doc_id LIMIT 100")
def f15_shuffled_sample(spark, d):
    return S.shuffled_sample(B.documents(spark, d), 100, F.col("doc_id"), 42).select("doc_id")


@query("f16_shuffled_split", f"SELECT doc_id, CASE WHEN r < 50 THEN 'eval' WHEN r < 100 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql_lcg('doc_id', 42)}, doc_id) - 1 AS r FROM documents)")
def f16_shuffled_split(spark, d):
    return S.split_by_shuffle(B.documents(spark, d), F.col("doc_id"), {"eval": 50, "dev": 50}, "train", 42).select("doc_id", "split")


@query("f17_length_guard", f"SELECT conv_id, turn FROM {B.SQL_TURNS} WHERE greatest(len(src), len(tgt)) <= 40")
def f17_length_guard(spark, d):
    return S.within_length(B.turn_pairs(spark, d), F.col("src"), F.col("tgt"), 40).select("conv_id", "turn")


@query("f18_skip_siblings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f18_skip_siblings(spark, d):
    return S.without_siblings(B.documents(spark, d), B.table(spark, d, "labels"), "doc_id").select("doc_id")


@query("f19_word_like", r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS token FROM conversations) WHERE regexp_matches(token, '\p{L}') AND NOT starts_with(token, '##') AND NOT starts_with(token, '▁') GROUP BY token")
def f19_word_like(spark, d):
    each = B.table(spark, d, "conversations").select(F.explode(T.words(F.col("text"))).alias("token"))
    return each.where(T.looks_like_word(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query("f20_stratified_sample", f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {sql_lcg('doc_id', 3)}, doc_id) <= 5")
def f20_stratified_sample(spark, d):
    return S.random_rows(B.documents(spark, d), 5, by=["source"], key=F.col("doc_id"), seed=3).select("source", "doc_id")


# Sources on JSON lines made from the tables


def _lines(spark, d):
    docs = B.documents(spark, d)
    line = F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).when(F.col("doc_id") % 7 == 1, F.lit('{"text": "cut')).when(F.col("doc_id") % 7 == 2, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct("text")))
    return docs.select(line.alias("value"), F.col("source").alias("shard"))


@query("s2_json_documents", "SELECT source AS shard, count(*) AS n, sum(least(length(text), 500)) AS chars FROM documents WHERE doc_id % 7 > 2 AND length(text) >= 200 GROUP BY source")
def s2_json_documents(spark, d):
    return R.parse_documents(_lines(spark, d), 200, 500).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s3_shard_assignment", "SELECT source, (row_number() OVER (ORDER BY source) - 1) % 3 AS worker FROM (SELECT DISTINCT source FROM documents)")
def s3_shard_assignment(spark, d):
    docs = B.documents(spark, d)
    each = [R.shuffled_shards(docs, "source", k, 3, epoch=1).select("source", F.lit(k).cast("long").alias("worker")) for k in range(3)]
    return each[0].union(each[1]).union(each[2])


WORKERS, EPOCHS, RESUMED = 3, 2, 100
_SQL_KEY = "CAST('0x' || md5('7|' || epoch || '|{0}')[1:8] AS BIGINT) % n"


@query("s3_epoch_order", f"""WITH k AS (SELECT epoch, n, list_filter(range({_SQL_KEY.format('a')}, {_SQL_KEY.format('a')} + n + 1), lambda x: gcd(x, n) = 1)[1] AS a, {_SQL_KEY.format('b')} AS b FROM (SELECT count(*) AS n FROM part), (SELECT unnest(range({EPOCHS})) AS epoch)),
p AS (SELECT epoch, (i * a + b) % n AS position, p_partkey FROM k, (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part))
SELECT CAST(epoch AS INTEGER) AS epoch, CAST(position % {WORKERS} AS INTEGER) AS worker, position // {WORKERS} AS step, p_partkey, resumed FROM p, (VALUES (false), (true)) r(resumed) WHERE NOT resumed OR (epoch = 1 AND position % {WORKERS} = 1 AND position // {WORKERS} >= {RESUMED})""")
def s3_epoch_order(spark, d):
    """What three workers read in two epochs, parts standing for shards, and what one of them reads after it was resumed."""
    parts = S.number_rows(B.table(spark, d, "part").select("p_partkey"), "p_partkey", into="index")
    order = R.ShardOrder(parts.count(), seed=7)
    steps = [order.steps(spark, e, w, WORKERS).withColumn("resumed", F.lit(False)) for e in range(EPOCHS) for w in range(WORKERS)]
    steps.append(order.steps(spark, 1, 1, WORKERS, first=RESUMED).withColumn("resumed", F.lit(True)))
    return reduce(lambda x, y: x.unionByName(y), steps).join(parts, "index").select("epoch", "worker", "step", "p_partkey", "resumed")


@query("s5_last_row_per_key", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def s5_last_row_per_key(spark, d):
    from pairloom.operators.relational import last_per_key

    return last_per_key(B.table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("s6_language_rows", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang = 'en'")
def s6_language_rows(spark, d):
    return R.language_rows(B.documents(spark, d), "en", "doc_id", column="lang").select("doc_id", "idx")


@query("s7_instruction_pairs", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'fluency' ELSE 'paraphrase' END AS t_type, doc_id % 2 = 1 AS reversible, text AS src FROM documents WHERE doc_id % 5 <> 0")
def s7_instruction_pairs(spark, d):
    docs = B.documents(spark, d)
    made = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("no instruction")).otherwise(F.concat(F.lit("Fix this: "), "text")).alias("src"), F.when(F.col("doc_id") % 2 == 0, "fluency").otherwise("paraphrase").alias("task"), F.col("doc_id").cast("string").alias("tgt"))
    return R.instruction_pairs(made, ["fluency", "paraphrase"]).select(F.col("tgt").cast("long").alias("doc_id"), "t_type", "reversible", "src")


@query("s11_first_description", "SELECT user_id AS f, min_by(event_type, event_id) AS description FROM events WHERE event_type <> 'view' GROUP BY user_id")
def s11_first_description(spark, d):
    e = B.table(spark, d, "events")
    made = e.select(F.col("user_id").alias("f"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("description"), F.lit(0).alias("batch"), F.col("event_id").alias("line"))
    return R.descriptions(made)


@query("s13_ragged_arrays", f"SELECT doc_id, list(token ORDER BY pos) AS token FROM {B.SQL_TOKENS} GROUP BY doc_id")
def s13_ragged_arrays(spark, d):
    from pairloom.sources.sinks import ragged

    return ragged(B.tokens(spark, d), "doc_id", "pos", ["token"])


@query("s9_json_object_table", "SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS INTEGER) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def s9_json_object_table(spark, d):
    return B.table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))


# Text functions


@query("x1_x4_exact_variants", f"""SELECT conv_id, turn, lower(trim(regexp_replace(source_text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(upper(source_text) || ' ', '\\s+', ' ', 'g'))) AS folded,
 trim(regexp_replace(source_text, '\\s+', ' ', 'g')) = trim(regexp_replace(target_text, '\\s+', ' ', 'g')) AS spaces, trim(source_text) = trim(source_text || '  ') AS stripped FROM {B.SQL_TURNS}""")
def x1_x4_exact_variants(spark, d):
    t = B.turn_pairs(spark, d)
    s = F.col("source_text")
    return t.select("conv_id", "turn", T.exact_casefold(s, F.concat(F.upper(s), F.lit(" "))).alias("folded"), T.exact_spaces(s, F.col("target_text")).alias("spaces"), T.exact_strip(s, F.concat(s, F.lit("  "))).alias("stripped"))


def _sql_ngrams(words: str, n: int) -> str:
    return f"list_distinct([array_to_string({words}[i:i + {n - 1}], ' ') FOR i IN range(1, len({words}) - {n - 2})])"


@query("x7_ngram_sets", f"SELECT conv_id, turn, len({_sql_ngrams('src', 2)}) AS bigrams, len({_sql_ngrams('src', 4)}) AS fourgrams FROM {B.SQL_TURNS}")
def x7_ngram_sets(spark, d):
    return B.turn_pairs(spark, d).select("conv_id", "turn", F.size(T.ngrams(F.col("src"), 2)).cast("long").alias("bigrams"), F.size(T.ngrams(F.col("src"), 4)).cast("long").alias("fourgrams"))


def _sari_sql() -> str:
    # system: source and target words interleaved by halves; reference: the target
    out = "list_concat(src[1:len(src) // 2], tgt[len(tgt) // 2 + 1:])"
    parts = []
    for n in range(1, 5):
        s, o, r = _sql_ngrams("src", n), _sql_ngrams("sysw", n), _sql_ngrams("tgt", n)
        parts.append(f"{s} AS s{n}, {o} AS o{n}, {r} AS r{n}")
    inter = lambda a, b: f"list_intersect({a}, {b})"
    minus = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
    share = lambda h, a, b: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0 WHEN {a} = 0 THEN 0.0 ELSE {h} / greatest({a}, 1) END)"
    f1 = lambda h, a, b: f"(CASE WHEN {share(h, a, b)} + {share(h, b, a)} > 0 THEN 2 * {share(h, a, b)} * {share(h, b, a)} / ({share(h, a, b)} + {share(h, b, a)}) ELSE 0.0 END)"
    columns, total = [], []
    for n in range(1, 5):
        s, o, r = f"s{n}", f"o{n}", f"r{n}"
        for name, a, b in (("k", inter(s, o), inter(s, r)), ("a", minus(o, s), minus(r, s)), ("d", minus(s, o), minus(s, r))):
            columns.append(f"CAST(len({a}) AS DOUBLE) AS {name}s{n}, CAST(len({b}) AS DOUBLE) AS {name}r{n}, CAST(len({inter(a, b)}) AS DOUBLE) AS {name}b{n}")
        total.append(f"({f1(f'kb{n}', f'ks{n}', f'kr{n}')} + {f1(f'ab{n}', f'as{n}', f'ar{n}')} + {share(f'db{n}', f'ds{n}', f'dr{n}')}) / 3")
    return f"SELECT conv_id, turn, round(({' + '.join(total)}) / 4 * 100, 6) AS sari FROM (SELECT conv_id, turn, {', '.join(columns)} FROM (SELECT conv_id, turn, {', '.join(parts)} FROM (SELECT *, {out} AS sysw FROM {B.SQL_TURNS})))"


@query("x8_sari", _sari_sql())
def x8_sari(spark, d):
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    t = B.turn_pairs(spark, d)
    mixed = F.concat(F.slice("src", 1, half("src")), F.slice("tgt", half("tgt") + 1, F.size("tgt")))
    text = lambda c: F.array_join(c, " ")
    return t.select("conv_id", "turn", F.round(T.sari(text("src"), text(mixed), text("tgt")), 6).alias("sari"))


@query("x10_alpha_ratio", r"SELECT doc_id, round(length(regexp_replace(text, '\P{L}', '', 'g')) / length(text), 9) AS ratio, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents WHERE length(text) > 0")
def x10_alpha_ratio(spark, d):
    docs = B.documents(spark, d).where(F.length("text") > 0)
    return docs.select("doc_id", F.round(T.alpha_ratio(F.col("text")), 9).alias("ratio"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query("x11_x12_display", "SELECT p_partkey, replace(p_brand, '_', ' ') AS brand, substr(p_name, 1, 10) AS short FROM part")
def x11_x12_display(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.humanise(F.col("p_brand")).alias("brand"), T.truncate(F.col("p_name"), 10).alias("short"))


@query("x13_ranked_text", f"""SELECT row, coalesce(string_agg('f' || f || '=' || printf('%.4f', v), '; ' ORDER BY v DESC, f), 'nothing') AS shown FROM (SELECT row, f, v FROM {B.SQL_ACTIVATIONS} QUALIFY row_number() OVER (PARTITION BY row ORDER BY v DESC, f) <= 3) GROUP BY row""")
def x13_ranked_text(spark, d):
    from pairloom.operators.features import pooled

    top = pooled(B.activations(spark, d), "row", 3)
    item = F.struct((-F.col("v")).alias("o"), "f", F.concat(F.lit("f"), F.col("f").cast("string"), F.lit("="), F.format_string("%.4f", "v")).alias("t"))
    packed = top.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return packed.select("row", F.coalesce(F.array_join(F.transform("s", lambda x: x["t"]), "; "), F.lit("nothing")).alias("shown"))


# Verdict parsing on generated answers


@query("p1_relation", "SELECT event_id, CASE WHEN contains(t, 'MORE') THEN 'MORE' WHEN contains(t, 'LESS') THEN 'LESS' WHEN contains(t, 'SAME') THEN 'SAME' END AS rel FROM (SELECT event_id, upper(CASE event_id % 4 WHEN 0 THEN 'It is less, not more' WHEN 1 THEN 'less' WHEN 2 THEN 'about the same' ELSE event_type END) AS t FROM events)")
def p1_relation(spark, d):
    answer = F.when(F.col("event_id") % 4 == 0, "It is less, not more").when(F.col("event_id") % 4 == 1, "less").when(F.col("event_id") % 4 == 2, "about the same").otherwise(F.col("event_type"))
    return B.table(spark, d, "events").select("event_id", T.parse_relation(answer).alias("rel"))


_ANSWERS = (" b) because", "The answer is: C", "A long tale, but B", "none here", "**C**")


def _answer(answers):
    out = None
    for k, a in enumerate(answers):
        out = F.when(F.col("event_id") % len(answers) == k, a) if out is None else out.when(F.col("event_id") % len(answers) == k, a)
    return out


@query("p2_choice", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN NULL ELSE 'C' END AS choice FROM events")
def p2_choice(spark, d):
    return B.table(spark, d, "events").select("event_id", T.parse_choice(_answer(_ANSWERS)).alias("choice"))


@query("p3_yes_no", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE NULL END AS verdict FROM events")
def p3_yes_no(spark, d):
    return B.table(spark, d, "events").select("event_id", T.parse_yes_no(_answer(("yes, it does", "No.", "I say no, not yes", "yesterday"))).alias("verdict"))


@query("p4_rubric", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS concept, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS instruct, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS fluency FROM events")
def p4_rubric(spark, d):
    got = T.parse_rubric(_answer(("Concept=2 instruct = 1, fluency=0", "concept=0\ninstruct=2\nfluency=1", "concept=9 instruct=1 fluency=1")))
    return B.table(spark, d, "events").select("event_id", got.alias("r")).select("event_id", "r.concept", "r.instruct", "r.fluency")


@query("p5_rating", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE 2 END AS rating FROM events")
def p5_rating(spark, d):
    return B.table(spark, d, "events").select("event_id", T.parse_rating(_answer(("Rating: [[1]]", "Rating: 0 then Rating: 2.", "so\nRating: 0\nend", "Rating: 7", "I give [[1]] or [[2]]"))).alias("rating"))


@query("p6_unflip", f"SELECT event_id, CASE WHEN {sql_uniform('event_id', 4)} < 0.5 AND r = 'MORE' THEN 'LESS' WHEN {sql_uniform('event_id', 4)} < 0.5 AND r = 'LESS' THEN 'MORE' ELSE r END AS rel FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'MORE' WHEN 1 THEN 'LESS' ELSE 'SAME' END AS r FROM events)")
def p6_unflip(spark, d):
    return B.table(spark, d, "events").select("event_id", T.unflip(_answer(("MORE", "LESS", "SAME")), uniform(F.col("event_id"), 4) < 0.5).alias("rel"))


@query("p7_realized", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN value > 100 ELSE value <= 100 AND event_id % 2 = 0 END AS realized FROM events")
def p7_realized(spark, d):
    system = F.when(F.col("value") > 100, "out").otherwise("src")
    return B.table(spark, d, "events").select("event_id", T.realized(_answer(("equal", "tgt", "src")), system, F.col("event_id") % 2 == 1).alias("realized"))


@query("p8_first_line", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'The cat sat.' WHEN 1 THEN 'A dog.' ELSE event_type END AS line FROM events")
def p8_first_line(spark, d):
    return B.table(spark, d, "events").select("event_id", T.first_line(_answer(('\n  "The cat sat."\nMore', 'Output: "A dog."', '"" \n\n')), F.col("event_type")).alias("line"))


@query("p9_default", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'MORE' ELSE 'SAME' END AS rel FROM events")
def p9_default(spark, d):
    return B.table(spark, d, "events").select("event_id", T.or_default(T.parse_relation(_answer(("more", "hm", ""))), "SAME").alias("rel"))


# Hashing and JSON


@query("h1_h3_draws", f"SELECT doc_id, {sql_lcg('doc_id', 9)} AS draw, round({sql_uniform('doc_id', 9)}, 9) AS u, {sql_uniform('doc_id', 9)} < 0.5 AS coin FROM documents")
def h1_h3_draws(spark, d):
    k = F.col("doc_id")
    return B.documents(spark, d).select("doc_id", lcg(k, 9).alias("draw"), F.round(uniform(k, 9), 9).alias("u"), (uniform(k, 9) < 0.5).alias("coin"))


# The checksum bit by bit: each byte enters the remainder, then eight shifts by the reflected polynomial 0xEDB88320.
CHECKSUM = """WITH RECURSIVE keys AS (SELECT DISTINCT lang, source, hex(encode(concat_ws('|', lang, source))) AS bytes FROM documents),
bits AS (
  SELECT lang, source, bytes, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM keys
  UNION ALL
  SELECT lang, source, bytes, i + 1, CASE WHEN mixed % 2 = 1 THEN xor(mixed >> 1, CAST(3988292384 AS BIGINT)) ELSE mixed >> 1 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, CAST('0x' || substr(bytes, i // 4 + 1, 2) AS BIGINT)) ELSE crc END AS mixed FROM bits WHERE i < 4 * length(bytes))
)
SELECT d.doc_id, xor(b.crc, CAST(4294967295 AS BIGINT)) AS crc FROM documents d JOIN bits b ON b.lang IS NOT DISTINCT FROM d.lang AND b.source IS NOT DISTINCT FROM d.source AND b.i = 4 * length(b.bytes)"""


@query("h1_crc", CHECKSUM)
def h1_crc(spark, d):
    return B.documents(spark, d).select("doc_id", crc_of(F.col("lang"), F.col("source")).alias("crc"))


@query("h5_h8_json_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), 'none') AS k FROM events")
def h5_h8_json_paths(spark, d):
    path = lambda p: F.get_json_object("props", p)
    return B.table(spark, d, "events").select("event_id", F.coalesce(path("$.missing"), path("$.k"), F.lit("none")).alias("k"))


@query("h7_composite_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def h7_composite_keys(spark, d):
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    parts = F.split(key, r"\|")
    return B.table(spark, d, "events").select(F.element_at(parts, 1).cast("long").alias("user_id"), F.element_at(parts, 2).alias("event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
