"""The stages over the smallest tables, against plain versions of each."""

import zlib
from collections import defaultdict

import corpus_pipeline as C
from conftest import DATA
from test_text_ops import _brute_hits, _components


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.select("doc_id", "text").collect()]
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(C.STAGES) - 1:
            seen.append(docs.select("doc_id", "text").collect())
    start, calm, single, clean, hidden = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r.doc_id for r in calm}
    kept = [r.doc_id in left for r in start if labels.get(r.doc_id) == 0]
    assert sum(kept) >= 0.9 * len(kept)
    groups = _components([(r.doc_id, r.text) for r in calm], 5, 80)
    assert {r.doc_id for r in single} == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {h[0] for h in _brute_hits([(r.doc_id, r.text) for r in single], items) if not h[2]}
    assert {r.doc_id for r in hidden} == {r.doc_id for r in clean} and any(a.text != b.text for a, b in zip(sorted(clean), sorted(hidden), strict=True))
    from pairloom.llm.packing import TokenBytes

    tokens, bins, sizes = TokenBytes(C.tokenizer_path()), defaultdict(list), defaultdict(int)
    for r in docs.collect():
        bins[r.sequence_id].append((r.offset, r.length))
        sizes[r.doc_id] += r.length
        if r.piece == 0 and r.length < 2048:
            ids = tokens(next(h.text for h in hidden if h.doc_id == r.doc_id)) + b"\0\0\0\0"
            assert r.ids_crc32 == zlib.crc32(ids[: 4 * r.length])
    assert set(sizes) == {r.doc_id for r in hidden}
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_equals_stages(spark):
    assert C.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "Two words"), (5, "two WORDS"), (5, "another text of the same id, with words enough to differ from all"), (6, "a b c d e f 4282026678195914 g"), (6, "a b c d e f 4282026678195914 g"), (None, "no id here at all, but a text"), (7, "x " * 300_000)]


def _odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "clash", 1.0, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _contamination string, _score double, salt int")


def test_stages_with_odd_input(spark):
    want = {
        "toxicity": ODD,
        "near_duplicates": [r for r in ODD if r != (5, "two WORDS") and r[0] != 5],
        "decontamination": ODD,
        "pii": ODD,
    }
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, _odd(spark, ODD), DATA)
        assert out.columns == C.COLUMNS
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name == "pii":
            assert [i for i, _ in got] == [i for i, _ in ODD] and got[6] == got[7] != ODD[6] and got[:6] == ODD[:6] and got[8:] == ODD[8:]
        else:
            assert sorted(map(str, got)) == sorted(map(str, want[name])), name
    packed = C.pack_sequences(spark, _odd(spark, ODD), DATA).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in ODD} and sum(r.length for r in packed if r.doc_id in (1, 2)) == 2 and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    _odd(spark, []).select(C.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
    rows = _odd(spark, ODD[:4])
    for name, stage in C.STAGES[:3]:
        assert stage(spark, rows, str(tmp_path)).count() == 4, name
