"""Views on the driver tables that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d):
    return table(spark, d, "documents")


def sentences(spark, d) -> DataFrame:
    """(doc_id, lang, source, pos, sentence)."""
    return documents(spark, d).select("doc_id", "lang", "source", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def tokens(spark, d) -> DataFrame:
    """(doc_id, pos, token): letter runs, lower case."""
    return documents(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("pos", "token"))


def activations(spark, d, threshold: float = 0.1) -> DataFrame:
    """(row, grp, f, v): entries of the embeddings above the threshold."""
    each = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("grp"), F.posexplode("embedding").alias("f", "v"))
    return each.select("row", "grp", "f", F.col("v").cast("double").alias("v")).where(F.col("v") > threshold)


def turn_pairs(spark, d) -> DataFrame:
    """(conv_id, turn, src, tgt, source_text, target_text): words of consecutive turns."""
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    both = c.select("conv_id", "turn", F.col("text").alias("source_text")).join(nxt, ["conv_id", "turn"])
    return both.withColumns({"src": T.words(F.lower("source_text")), "tgt": T.words(F.lower("target_text"))})


def verdicts(spark, d) -> DataFrame:
    """(idx, sys, event_id, realized): tri-state outcomes."""
    e = table(spark, d, "events")
    low = F.get_json_object("props", "$.k").cast("int") < 5
    return e.select(F.col("user_id").alias("idx"), F.col("event_type").alias("sys"), "event_id", F.when(low, None).otherwise(F.col("value") > 100).alias("realized"), "value")


def sizes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("grp")).agg(F.count("*").alias("n"))


SQL_SENTENCES = r"(SELECT doc_id, lang, source, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, lang, source, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents))"
SQL_TOKENS = r"(SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents))"
SQL_ACTIVATIONS = "(SELECT * FROM (SELECT vec_id AS row, label AS grp, generate_subscripts(embedding, 1) - 1 AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v > 0.1)"
SQL_VERDICTS = "(SELECT user_id AS idx, event_type AS sys, event_id, value, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 THEN NULL ELSE value > 100 END AS realized FROM events)"
SQL_SIZES = "(SELECT label AS grp, count(*) AS n FROM embeddings GROUP BY label)"
SQL_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
SQL_TURNS = f"(SELECT a.conv_id, a.turn, a.text AS source_text, b.text AS target_text, {SQL_WORDS.format('lower(a.text)')} AS src, {SQL_WORDS.format('lower(b.text)')} AS tgt FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
