"""Evaluation aggregates: per-group means, sweeps, routers, confusion, histograms, distribution summaries and tests."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def mean_table(records: DataFrame, group: str, cells: str, names: list[str], value: str, min_n: int = 1) -> DataFrame:
    """One row for each group: n (largest cell) and the mean of each named cell, null where empty."""
    each = [F.avg(F.when(F.col(cells) == n, F.col(value))).alias(n) for n in names]
    counts = [F.count(F.when(F.col(cells) == n, F.col(value))) for n in names]
    return records.groupBy(group).agg(F.greatest(*counts).alias("n") if len(counts) > 1 else counts[0].alias("n"), *each).where(F.col("n") >= min_n)


def best_label(records: DataFrame, group: str, label: str, value: str) -> DataFrame:
    """(group, best, mean, n): the label of the largest mean, ties to the smaller label."""
    means = records.groupBy(group, label).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    rank = Window.partitionBy(group).orderBy(F.desc("mean"), label)
    return means.withColumn("r", F.row_number().over(rank)).where("r = 1").select(group, F.col(label).alias("best"), "mean", "n")


def weighted_oracle(best: DataFrame) -> DataFrame:
    """Mean of the best labels' means, weighted by n."""
    return best.agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("oracle"), F.sum("n").alias("n"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and quantiles by linear interpolation of the finite values."""
    v = finite(F.col(value).cast("double"))
    names = [f"p{int(q * 100):02d}" for q in QUANTILES]
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.array(*map(F.lit, QUANTILES))).alias("_q"))
    return out.select(*by, "n", "mean", *(F.element_at("_q", i + 1).alias(x) for i, x in enumerate(names)))


def grouping_summary(df: DataFrame, sets: list[list[str]], columns: list[str], aggregates: list[Column], having: Column | None = None) -> DataFrame:
    """One summary over several groupings in a single pass."""
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(*aggregates, F.grouping_id().alias("grouping"))
    return out if having is None else out.where(having)


def tail_bucket(v: Column, exact: int = 20, middle: int = 50) -> Column:
    """0..exact by themselves, then one bucket up to `middle`, one above, and `other`."""
    return F.when(v.between(0, exact), v.cast("int").cast("string")).when(v.between(exact + 1, middle), f"{exact + 1}-{middle}").when(v > middle, f"{middle + 1}+").otherwise("other")


def tail_rank(v: Column, exact: int = 20, middle: int = 50) -> Column:
    return F.when(v.between(0, exact), v.cast("int")).when(v.between(exact + 1, middle), exact + 1).when(v > middle, exact + 2).otherwise(exact + 3)


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """(bucket, n, share, cumulative) in bucket order; one row per bucket reaches the window."""
    counts = df.groupBy(tail_bucket(value).alias("bucket"), tail_rank(value).alias("o")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    running = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("bucket", "n", (F.col("n") / F.sum("n").over(total)).alias("share"), (F.sum("n").over(running) / F.sum("n").over(total)).alias("cumulative"))


def count_bucket(n: Column, edges: tuple[int, ...] = (1, 3, 8), unknown: str = "unknown") -> Column:
    """Names like 1, 2-3, 4-8, 9+."""
    low, out = 0, F.when(n.isNull(), unknown)
    for high in edges:
        out = out.when(n <= high, str(high) if high == low + 1 or low == 0 and high == 1 else f"{low + 1}-{high}")
        low = high
    return out.otherwise(f"{low + 1}+")


def gate_reason(rules: list[tuple[str, Column]]) -> Column:
    """First rule that fails, `ok` if none does; an undefined test passes."""
    out = reduce(lambda w, r: w.when(r[1], r[0]) if w is not None else F.when(r[1], r[0]), rules, None)
    return out.otherwise("ok")


def gate_yield(df: DataFrame, by: list[str], reason: Column, reasons: list[str]) -> DataFrame:
    """n, count of each reason and the share that passes."""
    counts = [F.count_if(reason == r).alias(r) for r in reasons]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *counts, F.avg((reason == "ok").cast("double")).alias("pass_rate"))


def confusion(df: DataFrame, gold: str, predicted: str, ignore: int = -100) -> DataFrame:
    return df.where(F.col(gold) != ignore).groupBy(gold, predicted).agg(F.count("*").alias("n"))


def majority_confusion(conf: DataFrame, gold: str, predicted: str, label: int = 0) -> DataFrame:
    """What predicting one label everywhere would give."""
    return conf.groupBy(gold).agg(F.sum("n").alias("n")).withColumn(predicted, F.lit(label))


def class_scores(conf: DataFrame, gold: str, predicted: str, classes: list[int]) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = conf.select(F.explode(F.array(*map(F.lit, classes))).alias("class"), gold, predicted, "n")
    sums = each.groupBy("class").agg(
        F.sum(F.when((F.col(gold) == F.col("class")) & (F.col(predicted) == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(predicted) == F.col("class"), F.col("n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col(gold) == F.col("class"), F.col("n")).otherwise(0)).alias("gp"),
    )
    scored = sums.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("gp"))})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0))


def macro_f1(scores: DataFrame, skip_absent: bool = False, skip_zero: bool = False) -> DataFrame:
    """Mean F1 over all classes; optionally without class 0 and without classes that gold and prediction both lack."""
    if skip_zero:
        scores = scores.where("class <> 0")
    if skip_absent:
        scores = scores.where("gp > 0 or pp > 0")
    return scores.agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("correct"), F.sum("gp").alias("total"))


def threshold_scores(df: DataFrame, score: str, gold: str, thresholds: list[float]) -> DataFrame:
    """Binary precision, recall and F1 at many thresholds from one scan."""
    each = df.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), score, gold)
    hit, true = F.col(score) >= F.col("threshold"), F.col(gold)
    out = each.groupBy("threshold").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).otherwise(0.0)
    return out.select("threshold", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0).alias("f1"))


def family_metrics(df: DataFrame, members: str, aggregates: list[Column], composed: str = "(composed)") -> DataFrame:
    """A row counts once for each of its families, and once more as composed if it has several."""
    names = F.concat(F.array_distinct(members), F.when(F.size(members) > 1, F.array(F.lit(composed))).otherwise(F.array().cast("array<string>")))
    return df.withColumn("family", F.explode(names)).groupBy("family").agg(*aggregates)


def rate(df: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """Share of true among decided verdicts; groups without one are left out."""
    v = F.col(verdict).cast("int")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("rate")).where("n > 0")


def net_rate(rates: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """Rate under `true` less that under `random`."""
    pick = lambda name: F.max(F.when(F.col(condition) == name, F.col("rate")))
    return rates.groupBy(*keys).agg(pick("true").alias("true_rate"), pick("random").alias("base_rate")).withColumn("net", F.col("true_rate") - F.col("base_rate"))


def half_selected(df: DataFrame, by: str, factor: str, index: str, size: str, value: str) -> DataFrame:
    """Best factor on the first half of the inputs, its mean on the second."""
    first = df.where(F.col(index) < F.col(size) / 2)
    rest = df.where(F.col(index) >= F.col(size) / 2).groupBy(by, factor).agg(F.avg(value).alias("held_out"), F.count("*").alias("n"))
    best = best_label(first, by, factor, value).select(by, F.col("best").alias(factor), F.col("mean").alias("selected_on"))
    return best.join(rest, [by, factor])


def saturation(df: DataFrame, by: list[str], k: str, value: str, share: float = 0.95) -> DataFrame:
    """Smallest k whose mean reaches `share` of that at the largest k."""
    means = df.groupBy(*by, k).agg(F.avg(value).alias("m"))
    top = means.groupBy(*by).agg(F.max_by("m", k).alias("at_most"))
    return means.join(top, by).groupBy(*by).agg(F.min(F.when(F.col("m") >= share * F.col("at_most"), F.col(k))).alias("r95"))


def minimal_k(df: DataFrame, key: str, k: str, exact: str) -> DataFrame:
    """Histogram of the smallest k at which each row is exact; `never` for none."""
    own = df.groupBy(key).agg(F.min(F.when(F.col(exact) > 0, F.col(k))).alias("least"))
    return own.groupBy(F.coalesce(F.col("least").cast("string"), F.lit("never")).alias("k")).agg(F.count("*").alias("n"))


def threshold_choice(df: DataFrame, key: str, k: str, gain: str, values: list[str], thresholds: list[float]) -> DataFrame:
    """For each threshold the smallest k whose gain reaches it, else the largest; means of `values` there."""
    own = Window.partitionBy(key)
    chosen = {f"_k{i}": F.coalesce(F.min(F.when(F.col(gain) >= tau, F.col(k))).over(own), F.max(k).over(own)) for i, tau in enumerate(thresholds)}
    rows = df.where(F.col(key).isNotNull()).select(key, k, gain, *values).withColumns(chosen)
    met = F.filter(F.array(*(F.when(F.col(k) == F.col(f"_k{i}"), F.lit(tau)) for i, tau in enumerate(thresholds))), lambda tau: tau.isNotNull())
    return rows.select(k, *values, F.explode(met).alias("tau")).groupBy("tau").agg(*(F.avg(v).alias(v) for v in values), F.avg(k).alias("mean_k"))


def oracle_rows(df: DataFrame, key: str, order: list[str], system: str) -> DataFrame:
    """The best system of each row by the given values, ties to the smaller name."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order), system)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def route_by_count(df: DataFrame, count: str, threshold: int, few: str, many: str) -> Column:
    """Value of system `few` up to the threshold, else that of `many`."""
    return F.when(F.col(count) <= threshold, F.col(few)).otherwise(F.col(many))


def perplexity(df: DataFrame, by: list[str], loss: str, tokens: str) -> DataFrame:
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return df.groupBy(*by).agg(mean.alias("loss"), F.exp(mean).alias("perplexity"))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.median(v).alias("median"))


def condition_table(df: DataFrame, condition: str, mode: str, values: list[str]) -> DataFrame:
    return df.groupBy(condition, mode).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def token_and_pair_means(df: DataFrame, by: list[str], hits: str, total: str) -> DataFrame:
    """Ratio of sums and mean of ratios side by side."""
    return df.groupBy(*by).agg((F.sum(hits) / F.sum(total)).alias("token_weighted"), F.avg(F.when(F.col(total) > 0, F.col(hits) / F.col(total))).alias("pair_weighted"))


def information_gain(df: DataFrame, by: list[str], p_b: str, log_a: str, log_b: str) -> DataFrame:
    """Sum of p_b * (log p_b - log p_a) for each group."""
    return df.groupBy(*by).agg(F.sum(F.col(p_b) * (F.col(log_b) - F.col(log_a))).alias("kl"))


def _ngram_counts(items: list[str], n: int) -> Counter:
    return Counter(zip(*(items[k:] for k in range(n)), strict=False))


def ngram_overlap(output: Column, reference: Column, most: int) -> Column:
    """array<struct<hit, out, ref>> for n of 1..most: clipped matches and totals of the n-grams of two arrays; null counts as empty."""

    @F.arrow_udf(ArrayType(StructType([StructField(c, LongType()) for c in ("hit", "out", "ref")])))
    def overlap(outputs: pa.Array, references: pa.Array) -> pa.Array:
        rows = []
        for o, r in zip(outputs.to_pylist(), references.to_pylist(), strict=True):
            o, r, row = o or [], r or [], []
            for n in range(1, most + 1):
                a, b = _ngram_counts(o, n), _ngram_counts(r, n)
                row.append({"hit": sum((a & b).values()), "out": max(0, len(o) - n + 1), "ref": max(0, len(r) - n + 1)})
            rows.append(row)
        return pa.array(rows, pa.list_(pa.struct([(c, pa.int64()) for c in ("hit", "out", "ref")])))

    return overlap(output, reference)


def _overlap_sums(df: DataFrame, by: list[str], output: Column, reference: Column, most: int) -> DataFrame:
    """hit1.., out1.., ref1.. summed for each group."""
    rows = df.select(*by, ngram_overlap(output, reference, most).alias("_o"))
    return rows.groupBy(*by).agg(*(F.sum(F.col("_o")[n - 1][c]).alias(f"{c}{n}") for n in range(1, most + 1) for c in ("hit", "out", "ref")))


def bleu_statistics(df: DataFrame, by: list[str], output: str, reference: str, most: int = 4) -> DataFrame:
    """Corpus BLEU from clipped n-gram counts with brevity penalty, 0 if an order never matches."""
    sums = _overlap_sums(df, by, F.col(output), F.col(reference), most)
    log_p = sum((F.log(F.col(f"hit{n}") / F.col(f"out{n}")) for n in range(1, most + 1)), F.lit(0.0)) / most
    penalty = F.when(F.col("out1") >= F.col("ref1"), 1.0).otherwise(F.exp(1 - F.col("ref1") / F.col("out1")))
    whole = reduce(lambda a, b: a & b, [F.col(f"hit{n}") > 0 for n in range(1, most + 1)])
    return sums.select(*by, F.col("out1").alias("out_len"), F.col("ref1").alias("ref_len"), F.when(whole, 100 * penalty * F.exp(log_p)).otherwise(0.0).alias("bleu"))


def chrf_statistics(df: DataFrame, by: list[str], output: str, reference: str, *, most: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF: F-beta of the mean precision and recall of character n-grams (white space left out) over the orders that both sides have."""
    chars = lambda c: F.filter(F.split(F.regexp_replace(c, r"\s", ""), ""), lambda x: x != "")
    sums = _overlap_sums(df, by, chars(output), chars(reference), most)
    both = [(F.col(f"out{n}") > 0) & (F.col(f"ref{n}") > 0) for n in range(1, most + 1)]
    orders = sum((b.cast("int") for b in both), F.lit(0))
    mean = lambda side: sum((F.when(b, F.col(f"hit{n}") / F.col(f"{side}{n}")).otherwise(0.0) for n, b in enumerate(both, 1)), F.lit(0.0)) / orders
    rated = sums.select(*by, F.when(orders > 0, mean("out")).otherwise(0.0).alias("p"), F.when(orders > 0, mean("ref")).otherwise(0.0).alias("r"))
    score = 100 * (1 + beta * beta) * F.col("p") * F.col("r") / (beta * beta * F.col("p") + F.col("r"))
    return rated.select(*by, F.when(F.col("p") + F.col("r") > 0, score).otherwise(0.0).alias("chrf"))


# Tests and intervals


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p of k or fewer of n at even odds, doubled and at most 1; 1 for no trials."""
    least = F.least(k, n - k)
    # terms by recurrence: log C(n, i) = log C(n, i - 1) + log((n - i + 1) / i)
    first = -n * F.log(F.lit(2.0))
    step = lambda s, i: F.struct((s["c"] + F.log((n - i + 1) / i)).alias("c"), (s["sum"] + F.exp(s["c"] + F.log((n - i + 1) / i) + first)).alias("sum"))
    tail = F.aggregate(F.when(least >= 1, F.sequence(F.lit(1).cast("long"), least.cast("long"))).otherwise(F.array().cast("array<long>")), F.struct(F.lit(0.0).alias("c"), F.exp(first).alias("sum")), step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def mcnemar(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Discordant counts of two verdicts and the exact test on them."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    counts = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.avg(x.cast("int")).alias("rate_a"), F.avg(y.cast("int")).alias("rate_b"))
    p = binomial_two_sided(F.col("b"), F.col("b") + F.col("c"))
    return counts.withColumn("p", p).withColumn("band", stars(F.col("p")))


def sign_test(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    d = F.col(delta)
    counts = df.groupBy(*by).agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"))
    return counts.withColumn("p", binomial_two_sided(F.col("up"), F.col("up") + F.col("down")))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson interval within 0 and 1; null for n = 0."""
    p, z2 = k / n, z * z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def paired_difference(df: DataFrame, by: list[str], a: str, b: str, z: float = 1.96) -> DataFrame:
    """Mean difference with a normal interval (sample deviation) and wins and losses."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("_s"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    half = z * F.col("_s") / F.sqrt("n")
    return out.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "wins", "losses")


def average_rank(by: list[str], value: str, ascending: bool = True) -> Column:
    """Rank from 1 with ties averaged."""
    order = F.asc(value) if ascending else F.desc(value)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by average ranks; 0.5 if a class is empty."""
    ranked = df.withColumn("_rank", average_rank(by, score))
    pos = F.col(positive)
    sums = ranked.groupBy(*by).agg(F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.sum(F.when(pos, F.col("_rank"))).alias("_sum"))
    area = (F.col("_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), 0.5).otherwise(area).alias("auroc"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    ranked = df.withColumns({"_ra": average_rank(by, a), "_rb": average_rank(by, b)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def trend_verdict(df: DataFrame, by: str, order: str, value: str, strong: float = 0.40, weak: float = 0.15) -> DataFrame:
    """Fall from the mean of the first to that of the last third of a series, as a share, and a verdict on it."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": n})
    third = F.floor(F.col("_i") * 3 / F.col("_n"))
    out = placed.withColumn("_t", third).groupBy(by).agg(F.avg(F.when(F.col("_t") == 0, F.col(value))).alias("early"), F.avg(F.when(F.col("_t") == 2, F.col(value))).alias("late"))
    change = (F.col("early") - F.col("late")) / F.col("early")
    return out.withColumn("change", change).withColumn("verdict", F.when(change >= strong, "improving").when(change >= weak, "slowing").otherwise("flat"))


def control_verdict(true_value: Column, empty_value: Column, random_value: Column, used: float = 0.05, weak: float = 0.01) -> Column:
    """Whether a condition is used: its lead over both controls."""
    lead = true_value - F.greatest(empty_value, random_value)
    return F.when(lead >= used, "USED").when(lead >= weak, "WEAK").otherwise("IGNORED")
