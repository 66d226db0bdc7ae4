"""Selection rules of iterative decoding, over tables of scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept_plans(plans: DataFrame, row: str, threshold: float) -> DataFrame:
    """Distinct plans of each row (row, plan, pos, op, prob) after ops below the threshold are dropped; position 0 is protected."""
    kept = plans.where((F.col("prob") >= threshold) & (F.col("pos") > 0))
    return kept.groupBy(row, "plan").agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("ops")).select(row, "ops").distinct()


def alternatives(candidates: DataFrame, keys: list[str], k: int, most: int, row: str) -> DataFrame:
    """The k best alternatives (tok, score) of each place, at most `most` for each row."""
    per_place = Window.partitionBy(*keys).orderBy(F.desc("score"), "tok")
    per_row = Window.partitionBy(row).orderBy(F.desc("score"), *keys, "tok")
    best = candidates.withColumn("_r", F.row_number().over(per_place)).where(F.col("_r") <= k)
    return best.withColumn("_r", F.row_number().over(per_row)).where(F.col("_r") <= most).drop("_r")


def best_candidate(candidates: DataFrame, row: str, score: str, order: str) -> DataFrame:
    """The candidate of the highest score, the first of equals; undefined scores lose."""
    w = Window.partitionBy(row).orderBy(F.desc_nulls_last(score), order)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def to_fixpoint(df: DataFrame, step: Callable[[DataFrame], DataFrame], passes: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat `step` until nothing changes, `passes` times at most; `keep` materialises each state (for example in a checkpoint)."""
    for _ in range(passes):
        after = keep(step(df))
        if after.exceptAll(df).isEmpty():
            return after
        df = after
    return df


def masked_count(n: Column, step: int, steps: int) -> Column:
    """Positions still masked after a step of a cosine schedule."""
    return F.floor(n * math.cos(math.pi / 2 * (step + 1) / steps)).cast("int")


def remask(scored: DataFrame, row: str, pos: str, confidence: str, step: int, steps: int) -> DataFrame:
    """Column `masked`: the positions of lowest confidence that are decoded again."""
    w = Window.partitionBy(row)
    rank = F.row_number().over(w.orderBy(confidence, pos))
    return scored.withColumn("masked", rank <= masked_count(F.count("*").over(w), step, steps))


def choose_operations(rates: DataFrame, row: str, *, step: float, threshold: float | None = None, floor: float = 0.1, coin: Column | None = None) -> DataFrame:
    """At most one operation for each position (row, pos, kind, rate).

    With a threshold, those whose firing chance 1 - exp(-step * rate) reaches it; with a coin (a draw for each
    row), those below their chance; otherwise the whole number of operations that the rates sum to (at least one
    while the sum is over `floor`), the strongest first.
    """
    top = Window.partitionBy(row, "pos").orderBy(F.desc("rate"), "kind")
    single = rates.withColumn("_k", F.row_number().over(top)).where("_k = 1").drop("_k")
    chance = 1 - F.exp(-step * F.col("rate"))
    if threshold is not None:
        return single.where(chance >= threshold)
    if coin is not None:
        return single.where(coin < chance)
    w = Window.partitionBy(row)
    strongest = w.orderBy(F.desc("rate"), "pos")
    mass = F.sum(F.col("rate") * step).over(strongest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # added up in one order: its last bits decide at whole numbers
    quota = F.when(mass >= 1, F.floor(mass)).when(mass > floor, 1).otherwise(0)
    return single.withColumn("_q", quota).withColumn("_k", F.row_number().over(strongest)).where("_k <= _q").drop("_q", "_k")


def operation_kind(next_: Column, current: Column, proposed: Column, likely: float = 0.5) -> Column:
    """DEL if the next token beats the current and the proposed one, INS if the current stays likely, else SUB."""
    return F.when((next_ > current) & (next_ > proposed), "DEL").when(current > likely, "INS").otherwise("SUB")


def smallest_prefix(items: Sequence, works: Callable[[Sequence], bool]) -> list:
    """The shortest prefix that works (if the whole does), then without items that are not needed, last first."""
    if not works(items):
        return []
    low, high = 0, len(items)
    while low < high:
        middle = (low + high) // 2
        if works(items[:middle]):
            high = middle
        else:
            low = middle + 1
    kept = list(items[:high])
    for item in reversed(list(kept)):
        rest = [x for x in kept if x is not item]
        if works(rest):
            kept = rest
    return kept


def minimal_subsets(rows: DataFrame, items: str, works: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], *, rounds: int | None = None) -> DataFrame:
    """`rows` with n_full, prefix (length of the shortest prefix of `items` that works) and kept (places that are left of it); all rows in step.

    `items` is an array column, strongest first.  `works` gets the rows with a column `chosen` (sorted places of a trial) and
    returns them with a column `works`; it may join what it needs.  First the whole array is tried (rows where it fails have null results), then
    prefixes by bisection, then places are taken out one at a time, the weakest first, while what is left works; the last one stays.
    Each round is one call for all rows (null in `chosen` where there is nothing left to try); `keep` materialises the state of a round.  There are as many
    rounds as the longest prefix has places, and its logarithm; `rounds` bounds the former (rows that need more raise an error).
    """
    columns = rows.columns
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    state = rows.withColumn("n_full", F.size(items)).withColumn("chosen", places(F.col("n_full")))
    state = works(state).withColumns({"low": F.lit(1), "high": F.when((F.col("n_full") > 0) & F.col("works"), F.col("n_full"))}).drop("works", "chosen")
    state = keep(state)

    def tried(open_: Column, chosen: Column, **then: Column) -> DataFrame:
        """The state with the columns of `then` in the rows that are open; `works` gets null trials in the others."""
        todo = works(state.withColumn("chosen", F.when(open_, chosen)))
        new = {c: F.when(open_, v).otherwise(F.col(c)) for c, v in then.items()}
        return keep(todo.withColumns(new).select(*state.columns))

    bisecting = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    while not state.where(bisecting).isEmpty():
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        state = tried(bisecting, places(middle), high=F.when(F.col("works"), middle).otherwise(F.col("high")), low=F.when(F.col("works"), F.col("low")).otherwise(middle + 1))
    state = state.withColumns({"kept": F.when(F.col("high").isNotNull(), places(F.col("high"))), "next": F.col("high") - 1}).drop("low")
    longest = state.agg(F.max("high")).first()[0] or 0
    if rounds is not None and longest > rounds:
        raise ValueError(f"a prefix of {longest} places needs more than {rounds} rounds")
    open_ = F.coalesce((F.col("next") >= 0) & (F.size("kept") > 1), F.lit(False))
    for _ in range(longest):
        state = tried(open_, F.array_remove("kept", F.col("next")), kept=F.when(F.col("works"), F.col("chosen")).otherwise(F.col("kept")), next=F.col("next") - 1)
    return state.select(*columns, "n_full", F.col("high").alias("prefix"), "kept")
