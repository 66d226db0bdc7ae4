import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.sources import readers as R
from pairloom.sources import sinks as K
from pairloom.streaming import streams as M

from conftest import DATA


def test_dirty_json_lines(spark, tmp_path):
    lines = ['{"text": "a long enough text"}', "", "{broken", '{"other": 1}', '{"text": "x"}', '{"text": null}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = R.read_documents(spark, str(tmp_path / "a.json"), least=5, longest=6).collect()
    assert [r.text for r in rows] == ["a long"]


def test_csv_nulls_and_maps(spark, tmp_path):
    (tmp_path / "a.csv").write_text('feature,n\nx,1\n"y, z",\n')
    assert [(r.feature, r.n) for r in R.read_csv(spark, str(tmp_path / "a.csv"), "feature string, n int").collect()] == [("x", 1), ("y, z", None)]
    (tmp_path / "m.json").write_text('{"3": 1.5, "7": 2.0}')
    assert {r.key: r.value for r in R.read_json_map(spark, str(tmp_path / "m.json"), "double").collect()} == {"3": 1.5, "7": 2.0}


def test_last_line_wins(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"idx": 1, "v": 1}\n{"idx": 1, "v": 2}\nbad\n{"idx": 2, "v": 3}\n')
    out = R.read_keyed(spark, str(tmp_path / "k.json"), "idx int, v int", "idx", F.monotonically_increasing_id())
    assert {r.idx: r.v for r in out.where("idx is not null").collect()} == {1: 2, 2: 3}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    assert K.append_new(spark.range(5), path, "id") == 5
    assert K.append_new(spark.range(8), path, "id") == 3
    assert K.append_new(spark.range(8), path, "id") == 0
    assert spark.read.parquet(path).count() == 8 and K.is_complete(spark, path)


def test_shards_and_report(spark, tmp_path):
    K.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("part-*"))) == 3
    assert K.markdown(spark.createDataFrame([("a", None)], "x string, y double")).splitlines()[-1] == "| a | — |"
    with pytest.raises(ValueError, match="rows"):
        K.markdown(spark.range(5), limit=4)


def _events(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    return events, M.file_stream(spark, str(tmp_path / "in"), events.schema)


def test_stream_appends_once(spark, tmp_path):
    events, stream = _events(spark, tmp_path)
    for _ in range(2):
        M.append_once(stream, str(tmp_path / "out"), "event_id", str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_windows_and_latest(spark, tmp_path):
    events, stream = _events(spark, tmp_path)
    query = M.windowed_counts(stream, "ts", "1 day", None, ["event_type"], "1 day", "value").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == events.count()
    query = M.last_write_wins(stream, "user_id", "event_id", "value").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    want = {r.user_id: r.v for r in events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("v")).collect()}
    assert {r.user_id: r.value for r in spark.sql("select * from latest").collect()} == want


class _State:
    def __init__(self):
        self.value = None

    @property
    def getOption(self):  # noqa: N802
        return self.value

    def update(self, value):
        self.value = value


def test_adaptive_weights():
    state = _State()
    first = next(M._update(("a",), iter([pd.DataFrame({"ok": [True, False, True]})]), state))
    second = next(M._update(("a",), iter([pd.DataFrame({"ok": [True]})]), state))
    assert first.weight[0] == 1 / 3 and second.accepted[0] == 3 and second.weight[0] == 0.25


def test_resume_point_skips_what_is_broken(spark, tmp_path):
    import gzip

    assert K.resume_point(spark, str(tmp_path / "none"), "idx") == (0, None)
    folder = tmp_path / "shards"
    folder.mkdir()
    (folder / "shard-0.json").write_text('{"idx": 3}\n\n{broken\n{"other": 1}\n{"idx": 7}\n')
    whole = gzip.compress(b"".join(b'{"idx": %d}\n' % k for k in range(100, 5000)))
    (folder / "shard-1.json.gz").write_bytes(whole)
    rows, last = K.resume_point(spark, str(folder), "idx")
    assert (rows, last) == (4902, 4999)
    (folder / "shard-2.json.gz").write_bytes(gzip.compress(b'{"idx": 9000}\n' * 100_000)[:90])
    rows, last = K.resume_point(spark, str(folder), "idx")
    assert rows >= 4902 and last in (4999, 9000)
    spark.range(5).write.parquet(str(tmp_path / "p"))
    assert K.resume_point(spark, str(tmp_path / "p"), "id", "parquet") == (5, 4)


def test_counters_without_a_pass_of_their_own(spark):
    df, counters = K.observed(spark.range(10), rows=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    assert df.where("id < 3").count() == 3 and counters.get == {"rows": 10, "odd": 5}


def test_arrays_from_files(spark, tmp_path):
    import numpy as np
    import pytest

    np.save(tmp_path / "a.npy", np.array([1.5, 2.5]))
    np.savez(tmp_path / "b.npz", x=np.array([3.0]), ids=np.array([7, 8, 9]))
    assert [(r.f, r.v) for r in R.read_array(spark, str(tmp_path / "a.npy")).collect()] == [(0, 1.5), (1, 2.5)]
    assert [r.v for r in R.read_array(spark, str(tmp_path / "b.npz"), "ids").collect()] == [7, 8, 9]
    with pytest.raises(KeyError):
        R.read_array(spark, str(tmp_path / "b.npz"), "none")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    K.write_tsv_report(df, str(tmp_path / "t"))
    K.write_json_report(df, str(tmp_path / "j"))
    assert "n\tt" in next((tmp_path / "t").glob("part*")).read_text() and '"t":"a"' in next((tmp_path / "j").glob("part*")).read_text()


def test_reports_of_more_rows_than_a_file_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "REPORT_ROWS", 4)
    df = spark.range(10).selectExpr("id", "string(id) as t")
    for write, name in ((K.write_csv_report, "c"), (K.write_tsv_report, "t"), (K.write_json_report, "j")):
        write(df, str(tmp_path / name))
    read = spark.read.schema("id long, t string").option("header", True)
    same = sorted(df.collect())
    assert sorted(read.csv(str(tmp_path / "c")).collect()) == same == sorted(read.option("sep", "\t").csv(str(tmp_path / "t")).collect())
    assert sorted(read.json(str(tmp_path / "j")).select("id", "t").collect()) == same


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path):
    spark.range(900).withColumn("x", F.col("id") % 7).repartition(9).write.option("maxRecordsPerFile", 10).parquet(str(tmp_path / "in"))
    schema = "id long, x long"
    stream = M.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=M.files_for(spark, str(tmp_path / "in"), batches=3))
    M.append_once(stream, str(tmp_path / "out"), "id", str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 900
    assert len([p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()]) == 3
    assert M.files_for(spark, str(tmp_path / "in"), batches=1000, least=4) == 4
