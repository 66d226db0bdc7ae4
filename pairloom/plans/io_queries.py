"""Queries: tables written, broken off, written again and read back; their files lie beside the session's checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.sources import readers as R
from pairloom.sources import sinks as K
from pairloom.sources.lineage import work_path
from pairloom.streaming import streams as M

from . import base as B
from .registry import query


def _broken_off(write) -> bool:
    """Whether a write failed, as it is meant to."""
    try:
        write()
    except Exception as error:  # an error of a task comes wrapped in others
        if "lost on purpose" not in str(error):
            raise
        return True
    return False


def _failing(df, where):
    """The rows, of which those that hold end the job."""
    return df.withColumn("lang", F.when(where, F.raise_error(F.lit("lost on purpose"))).otherwise(F.col("lang")))


SHARD_ROWS = 100


@query("s12_s14_m2_shards", f"SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars, false AS whole_before, true AS whole_after, true AS small FROM documents")
def s12_s14_m2_shards(spark, d):
    """Gzipped JSON shards of at most 100 rows: a run that fails leaves no complete stage, the next one replaces it."""
    docs = B.documents(spark, d).select("doc_id", "lang", "text")
    path = work_path(spark, "shards")
    last = docs.agg(F.max("doc_id")).first()[0]
    _broken_off(lambda: K.write_shards(_failing(docs, F.col("doc_id") == last), path, SHARD_ROWS))
    before = K.is_complete(spark, path)
    K.write_shards(docs, path, SHARD_ROWS)
    read = R.read_jsonl(spark, path, "doc_id long, lang string, text string").withColumn("file", F.input_file_name())
    sizes = read.groupBy("file").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))
    whole = sizes.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.sum("chars").alias("chars"), (F.max("n") <= SHARD_ROWS).alias("small"))
    return whole.select("n", "ids", "chars", F.lit(before).alias("whole_before"), F.lit(K.is_complete(spark, path)).alias("whole_after"), "small")


@query("s15_appends", "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'later' END AS came, 1 AS times FROM events")
def s15_appends(spark, d):
    """A third of the rows, then a run that fails, then all rows twice: each key is there once, as it first came."""
    e = B.table(spark, d, "events").select("event_id", "user_id")
    path = work_path(spark, "appends")
    K.append_new(e.where("event_id % 3 = 0").withColumn("came", F.lit("first")), path, "event_id")
    lost = e.withColumn("came", F.when(F.col("event_id") % 3 == 1, F.raise_error(F.lit("lost on purpose"))).otherwise("lost"))
    _broken_off(lambda: K.append_new(lost, path, "event_id"))
    for _ in range(2):
        K.append_new(e.withColumn("came", F.lit("later")), path, "event_id")
    return spark.read.parquet(path).groupBy("event_id", "user_id", "came").agg(F.count("*").cast("int").alias("times"))


@query("s8_s16_reports", "SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 25 THEN p_size END AS size, p_retailprice AS price, f AS form FROM part, (VALUES ('csv'), ('json'), ('tsv')) v(f)")
def s8_s16_reports(spark, d):
    """A report with empty cells as CSV, TSV and JSON, read back."""
    p = B.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    schema = p.schema
    path = work_path(spark, "reports")
    K.write_csv_report(p, f"{path}/csv")
    K.write_tsv_report(p, f"{path}/tsv")
    K.write_json_report(p, f"{path}/json")
    csv = R.read_csv(spark, f"{path}/csv", schema).withColumn("form", F.lit("csv"))
    tsv = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(f"{path}/tsv").withColumn("form", F.lit("tsv"))
    json = spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json"))
    return csv.unionByName(tsv).unionByName(json)


@query("s4_broken_lines", "SELECT event_id, event_id % 4 = 1 AS corrupt, CASE WHEN event_id % 4 <> 1 THEN user_id END AS user_id FROM events WHERE event_id % 4 <> 3")
def s4_broken_lines(spark, d):
    """JSON lines of which every fourth breaks off and every fourth is blank: broken ones are kept apart, blank ones count for nothing."""
    e = B.table(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id"))
    kind = F.col("event_id") % 4
    path = work_path(spark, "lines")
    e.select(F.when(kind == 1, F.concat(F.lit('{"event_id": '), "event_id")).when(kind == 3, " ").otherwise(line).alias("value")).write.text(path)
    read = R.read_jsonl(spark, path, "event_id long, user_id long", keep_corrupt=True)
    broken = F.col("_corrupt_record").isNotNull()
    found = F.regexp_extract("_corrupt_record", r"(\d+)$", 1).try_cast("long")
    return read.select(F.when(broken, found).otherwise(F.col("event_id")).alias("event_id"), broken.alias("corrupt"), F.when(~broken, F.col("user_id")).alias("user_id"))


@query("m3_s17_resume", "SELECT count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS rows, max(o_orderkey) FILTER (WHERE o_orderkey % 5 <> 0) AS last, count(*) AS total, CAST(count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS VARCHAR) AS manifest FROM orders")
def m3_s17_resume(spark, d):
    """Where to go on after shards with broken lines, the run's manifest, and the table after the rest was added."""
    o = B.table(spark, d, "orders").select("o_orderkey")
    path = work_path(spark, "resumed")
    whole = F.to_json(F.struct("o_orderkey"))
    o.select(F.when(F.col("o_orderkey") % 5 == 0, '{"o_orderkey": ').otherwise(whole).alias("value")).write.text(f"{path}/shards")
    rows, last = K.resume_point(spark, f"{path}/shards", "o_orderkey")
    K.write_manifest(spark, f"{path}/manifest", rows=rows)
    o.where("o_orderkey % 5 = 0").select(whole.alias("value")).write.mode("append").text(f"{path}/shards")
    manifest = spark.read.schema("rows string").json(f"{path}/manifest").first()[0]
    total, _ = K.resume_point(spark, f"{path}/shards", "o_orderkey")
    return spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(last).cast("long").alias("last"), F.lit(total).cast("long").alias("total"), F.lit(manifest).alias("manifest"))


@query("m5_counters", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS high, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def m5_counters(spark, d):
    """Counters that the write of each type's rows fills on its way, without a pass of their own."""
    out = []
    types = [r[0] for r in B.table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(100).collect()]  # few by design
    for name in types:
        rows, seen = K.observed(B.table(spark, d, "events").where(F.col("event_type") == name), n=F.count(F.lit(1)), high=F.count_if(F.col("value") > 100), total=F.sum("value"))
        rows.write.parquet(work_path(spark, "counted"))
        found = seen.get
        out.append((name, found["n"], found["high"], found["total"]))
    return spark.createDataFrame(out, "event_type string, n long, high long, total double").withColumn("total", F.round("total", 3))


@query("m1_stream_appends", "SELECT o_orderkey, o_custkey, 1 AS times FROM orders")
def m1_stream_appends(spark, d):
    """A stream of files appended by key; a second stream without memory of the first adds nothing."""
    path = work_path(spark, "streamed")
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    o.write.option("maxRecordsPerFile", 5_000).parquet(f"{path}/in")
    o.where("o_orderkey % 2 = 0").write.mode("append").parquet(f"{path}/in")
    at_once = M.files_for(spark, f"{path}/in", batches=4, least=4)
    for run in range(2):
        stream = M.file_stream(spark, f"{path}/in", o.schema, files_per_trigger=at_once)
        M.append_once(stream, f"{path}/out", "o_orderkey", f"{path}/checkpoint-{run}").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("o_orderkey", "o_custkey").agg(F.count("*").cast("int").alias("times"))
