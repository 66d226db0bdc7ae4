import importlib.util
import os


import duckdb
import pytest

from conftest import DATA, ROOT


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_runs(spark, entry):
    assert entry.entry(spark).count() >= 0


def test_oracles_have_queries(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "pairloom")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "pairloom.llm" not in file.read(), name


@pytest.mark.parametrize("name", ["f3_quality_sentences", "x8_sari", "a21_frc", "st1_mcnemar", "c16_unigrams", "j12_set_pairs", "a40_threshold_choice", "w6_w8_neighbours"])
def test_against_oracle(spark, entry, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations", "events", "lineitem", "orders", "part", "customer", "nation", "region", "supplier", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    shown = lambda v: f"{v:.5g}" if isinstance(v, float) else str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)
    flat = lambda v: shown(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else shown(v)
    want = sorted(tuple(flat(v) for _, v in sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    got = sorted(tuple(flat(v) for _, v in sorted(row.asDict().items())) for row in entry.queries()[name](spark, DATA).collect())
    assert got == want


def test_interval_overlap_reads_all_tokens(spark, entry):
    assert "< 60" not in entry.queries()["j10_interval_overlap"](spark, DATA)._jdf.queryExecution().toString()
    test_against_oracle(spark, entry, "j10_interval_overlap")
