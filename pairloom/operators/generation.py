"""Generation of edited pairs: hashed proposals, buckets, gates, subsets and rule-based rewrites of sentences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import categorical, lcg, pick_index, text_uniform, truncated_geometric, uniform
from pairloom.operators.rewriting import contraction, each_every, inversion, quote_inversion, split_join, tough, uncleft
from pairloom.sources.lineage import materialise

# Fixed values.
OP_WEIGHTS = {"REPL": 0.60, "INS": 0.34, "DEL": 0.06}
BUCKETS = {"identity": 0.05, "single_op": 0.55, "compound_2_3": 0.35, "compound_4_plus": 0.05}
GEOMETRIC = 0.4


def unigrams(tokens: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(token, log_prob, unk_log_prob) with add-`smoothing` over the observed tokens and one unknown."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("c"))
    size = counts.agg(F.sum("c").alias("total"), F.count("*").alias("v"))  # one row
    below = F.col("total") + smoothing * (F.col("v") + 1)
    return counts.join(F.broadcast(size), how="cross").select("token", F.log((F.col("c") + smoothing) / below).alias("log_prob"), F.log(smoothing / below).alias("unk_log_prob"))


#: Fewer tokens than this can have a probability above its inverse; those are looked up where the rows lie.
LIKELY = 262_144


def looked_up(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tokens (token, ...) with log_prob from a table (token, log_prob, unk_log_prob) whose probabilities sum to 1 at most; the unknown token's where it has none.

    Rows of likely tokens are not sent, so that no token meets in one task.
    """
    table = materialise(table)
    likely = table.where(F.col("log_prob") > -math.log(LIKELY)).select("token", "log_prob")
    unk = table.select("unk_log_prob").limit(1)  # one row
    rest = tokens.join(F.broadcast(likely.select("token")), "token", "left_anti").join(table.where(F.col("log_prob") <= -math.log(LIKELY)).select("token", "log_prob"), "token", "left")
    rest = rest.join(F.broadcast(unk), how="cross").withColumn("log_prob", F.coalesce("log_prob", "unk_log_prob")).drop("unk_log_prob")
    return tokens.join(F.broadcast(likely), "token").unionByName(rest)


def slor(scored: DataFrame, table: DataFrame, row: str) -> DataFrame:
    """(sum of log p - sum of unigram log p) / n of each row with at least two tokens: scored (row, token, logp)."""
    out = looked_up(scored.select(row, "token", "logp"), table).groupBy(row).agg(F.count("*").alias("n"), F.sum("logp").alias("m"), F.sum("log_prob").alias("u"))
    return out.select(row, "n", F.when(F.col("n") >= 2, (F.col("m") - F.col("u")) / F.col("n")).alias("slor"))


def bucket(key: Column, seed: int = 0) -> Column:
    return categorical(uniform(key, seed), BUCKETS)


def operation_count(bucket_: Column, key: Column, seed: int = 1, most: int = 8) -> Column:
    """Operations of a bucket: 0, 1, 2 or 3, or 4 and more with geometric odds."""
    u = uniform(key, seed)
    return F.when(bucket_ == "identity", 0).when(bucket_ == "single_op", 1).when(bucket_ == "compound_2_3", truncated_geometric(u, GEOMETRIC, 2, 3)).otherwise(truncated_geometric(u, GEOMETRIC, 4, most))


def bucket_of(n: Column) -> Column:
    return F.when(n == 0, "identity").when(n == 1, "single_op").when(n <= 3, "compound_2_3").otherwise("compound_4_plus")


def operation_types(n: Column, key: Column, seed: int = 2) -> Column:
    """n operation types by weight."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: categorical(uniform(key * 31 + i, seed), OP_WEIGHTS))).otherwise(F.array().cast("array<string>"))


def attempts(df: DataFrame, budget: int) -> DataFrame:
    """A row for each attempt 1..budget."""
    return df.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(budget))))


def first_accepted(df: DataFrame, key: str, ok: str) -> DataFrame:
    """The first accepted attempt of each row."""
    return df.where(F.col(ok)).groupBy(key).agg(F.min_by(F.struct(*df.columns), "attempt").alias("_r")).select("_r.*")


def gate(slor_drop: Column, n: Column, topk_change: Column, *, per_op: float = 0.10, transform: Column | None = None, slack: float = 1.5, least_change: int = 1) -> Column:
    """First reason to reject, null if there is none: the fluency limit grows with the operations and there is none for n = 0."""
    is_transform = F.coalesce(transform, F.lit(False)) if transform is not None else F.lit(False)
    too_far = F.when(is_transform, F.abs(slor_drop) > slack).otherwise((n > 0) & (slor_drop > per_op * n))
    return F.when(too_far, "slor").when((n > 0) & (topk_change < least_change), "topk")


def subsets(df: DataFrame, key: Column, ops: str, partial: float = 1.0, null: float = 0.5) -> DataFrame:
    """Full records, a proper non-empty subset of those with two and more operations, and null records, by hashed chance."""
    full = df.withColumn("subset_kind", F.when(F.size(ops) == 0, "identity").otherwise("full")).withColumn("kept", F.col(ops))
    size = 1 + pick_index(uniform(key, 11), F.size(ops) - 1)
    order = F.array_sort(F.transform(ops, lambda o, i: F.struct(uniform(key * 131 + i, 12).alias("u"), i.alias("i"), o.alias("o"))))
    chosen = F.transform(F.array_sort(F.transform(F.slice(order, 1, size), lambda x: F.struct(x["i"].alias("i"), x["o"].alias("o")))), lambda x: x["o"])
    part = df.where((F.size(ops) >= 2) & (uniform(key, 13) < partial)).withColumn("subset_kind", F.lit("partial")).withColumn("kept", chosen)
    none = df.where((F.size(ops) >= 1) & (uniform(key, 14) < null)).withColumn("subset_kind", F.lit("null")).withColumn("kept", F.filter(ops, lambda _: F.lit(False)))
    return full.unionByName(part).unionByName(none)


def both_directions(df: DataFrame, x: str, y: str, kind: str) -> DataFrame:
    """Each pair forwards and backwards, the latter tagged /rev."""
    pair = F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(kind).alias("k")), F.struct(F.col(y).alias("x"), F.col(x).alias("y"), F.concat(F.col(kind), F.lit("/rev")).alias("k")))
    out = df.withColumn("_p", F.explode(pair))
    return out.withColumns({x: F.col("_p.x"), y: F.col("_p.y"), kind: F.col("_p.k")}).drop("_p")


def balanced_pick(proposals: DataFrame, key: str, seed: int = 3) -> DataFrame:
    """One proposal of each row: a family at even odds, then a type, then a proposal."""
    k = F.col(key)
    crc = lambda *c: F.crc32(F.concat_ws("|", k, *c).cast("binary")) + seed * 7919
    rank = F.struct(uniform(crc("family")).alias("a"), F.col("family").alias("b"), uniform(crc("family", "t_type")).alias("c"), F.col("t_type").alias("d"), uniform(crc("family", "t_type", "out_text")).alias("e"), F.col("out_text").alias("f"))
    return proposals.groupBy(key).agg(F.min_by(F.struct("family", "t_type", "out_text"), rank).alias("_p")).select(key, "_p.*")


def weighted_pick(proposals: DataFrame, key: str, weight: Column, seed: int = 3) -> DataFrame:
    """One proposal of each row: a family with odds by `weight` (an expression over `family`), then a type, then a proposal at even odds.

    The family of the least -ln(u) / weight wins, u a draw for each row and family: one aggregation, and a family's
    chance among those that a row offers is its share of their weights.
    """
    draw = lambda *c: text_uniform(F.lit(str(seed)), F.col(key), *(F.col(x) for x in c))
    rank = F.struct((-F.log(draw("family")) / weight).alias("a"), F.col("family").alias("b"), draw("family", "t_type").alias("c"), F.col("t_type").alias("d"), draw("family", "t_type", "out_text").alias("e"), F.col("out_text").alias("f"))
    return proposals.groupBy(key).agg(F.min_by(F.struct("family", "t_type", "out_text"), rank).alias("_p")).select(key, "_p.*")


#: Families whose accepts are counted on the driver, at most.
MOST_FAMILIES = 10_000


def priority(accepts: dict[str, int], family: Column | None = None) -> Column:
    """Weight 1 / (1 + accepts so far) of a family."""
    if not accepts:
        return F.lit(1.0)
    table = F.create_map(*(x for name in sorted(accepts) for x in (F.lit(name), F.lit(1.0 / (1 + accepts[name])))))
    return F.coalesce(F.try_element_at(table, family if family is not None else F.col("family")), F.lit(1.0))


def count_accepts(picked: DataFrame, accepted: Column) -> dict[str, int]:
    """Accepts of each family, of which there are `MOST_FAMILIES` at most."""
    rows = picked.where(accepted).groupBy("family").count().limit(MOST_FAMILIES + 1).collect()
    if len(rows) > MOST_FAMILIES:
        raise ValueError("too many families to weigh")
    return {r["family"]: r["count"] for r in rows}


def adaptive_picks(proposals: DataFrame, key: str, accepted: Column, batch: str, batches: int, *, seed: int = 3) -> DataFrame:
    """`weighted_pick` batch after batch: accepts of earlier batches lower a family's weight in the later ones.

    `accepted` judges a picked row (key, family, t_type, out_text).  Within a batch all rows are drawn alike, so each batch is
    one distributed aggregation; between batches go the accepts of each family alone.  The picks of all batches come from one last
    plan in which the weights stand as constants, so a lost task draws again what it drew before.
    """
    accepts: dict[str, int] = {}
    weight = F.lit(1.0)
    for b in range(batches):
        weight = F.when(F.col(batch) == b, priority(accepts)).otherwise(weight)
        if b < batches - 1:
            picked = weighted_pick(proposals.where(F.col(batch) == b), key, priority(accepts), seed)
            for family, n in count_accepts(picked, accepted).items():
                accepts[family] = accepts.get(family, 0) + n
    return weighted_pick(proposals, key, weight, seed)


def natural_pairs(pairs: DataFrame, low: int, high: int, most_ops: int) -> DataFrame:
    """First reason to drop a natural pair (src array, tgt array, n_ops), `ok` for none."""
    size = lambda c: F.size(c)
    reason = (
        F.when((size("src") == 0) | (size("tgt") == 0), "empty")
        .when(F.col("src") == F.col("tgt"), "identical")
        .when(~size("src").between(low, high) | ~size("tgt").between(low, high), "length")
        .when(~F.col("n_ops").between(1, most_ops), "n_ops")
        .otherwise("ok")
    )
    return pairs.withColumn("reason", reason)


def spec_rows(specs: DataFrame, scale: float) -> DataFrame:
    """(grp, dir, pos map, neg map): the spec forwards (enh) and backwards (abl), rescaled by scale * norm_median / mean_norm."""
    factor = scale * F.col("norm_median") / F.col("mean_norm")
    rows = specs.where("mean_norm > 0").select("grp", F.explode(F.array(F.struct(F.lit("enh").alias("dir"), F.lit(1.0).alias("s")), F.struct(F.lit("abl").alias("dir"), F.lit(-1.0).alias("s")))).alias("d"), "spec", factor.alias("factor"))
    moved = F.transform_values("spec", lambda _, v: v * F.col("factor") * F.col("d.s"))
    part = lambda sign: F.transform_values(F.map_filter(moved, lambda _, v: v * sign > 0), lambda _, v: F.abs(v))
    return rows.select("grp", F.col("d.dir").alias("dir"), part(1).alias("pos"), part(-1).alias("neg"))


#: Rows of a bucket within which partners are found.
PARTNERS = 10_000


def mismatched(df: DataFrame, key: Column, value: str, into: str, *, buckets: int | None = None, seed: int = 5) -> DataFrame:
    """The value of another row: the next in a hashed order within a hashed bucket, round to its first.

    There is a bucket for each `PARTNERS` rows unless their number is given.
    """
    from pyspark.sql.window import Window

    buckets = buckets or max(1, df.count() // PARTNERS)
    w = Window.partitionBy("_b").orderBy("_o", "_k")
    marked = df.withColumns({"_b": F.pmod(lcg(key, seed + 1), F.lit(buckets)), "_o": uniform(key, seed), "_k": key})
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return marked.withColumn(into, F.coalesce(F.lead(value).over(w), F.first(value).over(whole))).drop("_b", "_o", "_k")


def swapped_ids(own: Column, other: Column, key: Column, *, share: float = 0.5, seed: int = 41) -> Column:
    """`own` ids of which a hashed choice of at most `share` makes room for as many of `other` that it does not hold."""
    drawn = lambda ids, s: F.transform(F.array_sort(F.transform(ids, lambda f: F.struct(uniform(key * 131 + f, s).alias("u"), f.alias("f")))), lambda x: x["f"])
    new = F.array_except(other, own)
    n = F.least(F.floor(F.size(own) * share), F.size(new)).cast("int")
    return F.array_sort(F.concat(F.slice(drawn(own, seed), n + 1, F.greatest(F.size(own), F.lit(1))), F.slice(drawn(new, seed + 1), F.lit(1), n)))


def group_mean_mix(entries: DataFrame, sizes: DataFrame, row: str, group: str, *, low: float = 0.3, high: float = 0.7, seed: int = 43) -> DataFrame:
    """(row, f, v): w of the row's own values and 1 - w of its group's means, w drawn evenly for each row; missing entries count as 0.

    entries (row, group, f, v), sizes (group, n).
    """
    means = entries.groupBy(group, "f").agg(F.sum("v").alias("s")).join(sizes, group).select(group, F.struct("f", (F.col("s") / F.col("n")).alias("mean")).alias("_m"))
    means = means.groupBy(group).agg(F.collect_list("_m").alias("_means"))
    # dealt out before they are gathered: a task of the scan holds no entries
    rows = entries.select(row, group, F.struct("f", "v").alias("_e")).repartition(row).groupBy(row).agg(F.collect_list("_e").alias("_own"), F.collect_set(group).alias("_in"))
    w = low + (high - low) * uniform(F.col(row), seed)
    fs = F.transform("_own", lambda e: e["f"])
    plain = (F.size("_in") <= 1) & (F.size(F.array_distinct(fs)) == F.size("_own")) & F.forall(fs, lambda f: f.isNotNull())
    one = rows.where(plain).select(row, F.map_from_entries("_own").alias("_own"), F.get("_in", F.lit(0)).alias(group)).join(means, group, "left")
    alone = F.transform(F.map_keys("_own"), lambda f: F.struct(f.alias("f"), F.lit(None).cast("double").alias("mean")))
    one = one.select(row, "_own", F.inline(F.coalesce("_means", alone)))  # the means of a group have all features of its rows
    mine, theirs = w * F.col("_own")[F.col("f")], (1 - w) * F.col("mean")
    one = one.select(row, "f", F.coalesce(mine + theirs, theirs, mine).alias("v"))
    # rows in several groups or with a feature twice or null, if any: all their parts are added up
    several = rows.where(~plain)
    own = several.select(row, F.inline("_own")).select(row, "f", (w * F.col("v")).alias("v"))
    shared = several.select(row, F.explode("_in").alias(group)).join(means, group).select(row, F.inline("_means")).select(row, "f", ((1 - w) * F.col("mean")).alias("v"))
    return one.unionByName(own.unionByName(shared).groupBy(row, "f").agg(F.sum("v").alias("v")))


def class_weights(tags: DataFrame, tag: str, smoothing: float = 1.0) -> DataFrame:
    """Inverse frequency of each tag, with mean 1 over the tags."""
    from pyspark.sql.window import Window

    counts = tags.groupBy(tag).agg(F.count("*").alias("n")).withColumn("raw", 1.0 / (F.col("n") + smoothing))
    return counts.withColumn("weight", F.col("raw") / F.avg("raw").over(Window.partitionBy())).drop("raw")


#: Families that need no parse; others join by `register_family`.
FAMILIES = {"TOUGH": tough, "INVERSION": inversion, "CLEFT": uncleft, "QUOTINV": quote_inversion, "CONTRACT": contraction, "SPLITJOIN": split_join, "DETQUANT": each_every}


def register_family(name: str, function) -> None:
    """A family as a function from a text column to array<struct<t_type, family, out_text>>.

    Families that need a parser take one as an Arrow function over the text (or over a parse column of their own).
    """
    FAMILIES[name] = function


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly, some tasks for each core: a scan is cut by bytes, of which a sentence has few for the time its rewrites take."""
    spark = df.sparkSession
    return df.repartition(min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _rewritten(df: DataFrame, text: str, families: list[str] | None = None) -> DataFrame:
    chosen = [FAMILIES[n](F.col(text)) for n in families or FAMILIES]
    out = df.withColumn("_p", F.explode(F.concat(*chosen))).select(*df.columns, "_p.*")
    return out.where((F.col("out_text") != F.col(text)) & (F.trim("out_text") != ""))


def proposals(df: DataFrame, text: str, families: list[str] | None = None) -> DataFrame:
    """A row for each proposal that changes the text; blank ones are dropped."""
    return _rewritten(_spread(df), text, families)


def round_trips(found: DataFrame, key: str, text: str) -> DataFrame:
    """Proposals whose own family leads back to the text; the second rewrite is made on the rows found alone."""
    back = F.concat(*(rewrite(F.col("out_text")) for rewrite in FAMILIES.values()))
    good = F.exists(back, lambda p: (p["family"] == F.col("family")) & (p["out_text"] == F.col(text)))
    return found.where(F.coalesce(good, F.lit(False)))


def composed(found: DataFrame, key: str, text: str) -> DataFrame:
    """Second rewrites of other families on first ones, named a+b, that do not lead back to the text."""
    second = _rewritten(found.select(key, F.col(text).alias("_x"), F.col("out_text").alias("_y"), F.col("family").alias("_f"), F.col("t_type").alias("_t")), "_y")
    kept = second.where("family <> _f and out_text <> _x")
    return kept.select(key, F.col("_x").alias(text), F.concat_ws("+", "_t", "t_type").alias("t_type"), F.concat_ws("+", "_f", "family").alias("family"), "out_text")
