"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "f3_quality_sentences", "f16_shuffled_split", "c16_unigrams", "c15_slor", "x8_sari", "e32_x5_x6_diff_metrics", "a4_a6_distribution", "a5_grouping_sets", "a21_frc", "st5_auroc_sparse",
    "a22_a23_spec_summary", "a25_v16_moments_weights", "j9_outer_chain", "j12_set_pairs", "j15_neighbours", "a40_threshold_choice", "st1_mcnemar", "w5_e4_islands", "c12_round_trips",
    "a52_uniformity", "e31_token_distance", "c2_replacements", "op1_ngram_jaccard", "op2_pii", "op3_html_text", "op4_decontamination", "op5_licences", "op6_url_filter", "op7_packing", "op8_ann", "op9_repeated_passages", "op10_toxicity", "op11_vector_codes", "op12_collocations", "op13_chat_format", "pipeline", "c6_compound_draws", "c14_m8_weighted_picks", "c21_near_pairs", "k10_minimal_subsets", "f1_split_sentences",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, taken = entry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        if name not in queries:
            continue
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
