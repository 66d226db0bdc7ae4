"""Proposals of single edits on word arrays, from tables of ranked candidates; every choice is a hashed draw.

A candidate list stands for what a masked model would rank at a place; it comes in as a column.  `claimed`
holds the places of words that earlier operations of the same sentence took.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.hashing import pick_index, uniform
from pairloom.functions.text import looks_like_word


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _from_top(found: Column, top: int, u: Column) -> Column:
    """One of the upper half of `top` ranks, by a draw; null of none."""
    return F.get(found, F.when(F.size(found) > 0, pick_index(u, F.least(F.size(found), F.lit(max(1, top // 2))))))


def _operation(kind: str, start: Column, end: Column, payload: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), payload.alias("payload"))


def _tries(make, key: Column, tries: int) -> Column:
    """The first result that is not null of make(key of the attempt)."""
    every = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: make(key * 64 + k))
    return F.try_element_at(F.filter(every, lambda o: o.isNotNull()), F.lit(1))


def propose_replacement(words: Column, claimed: Column, candidates: Column, key: Column, *, top: int = 10, tries: int = 3, seed: int = 21) -> Column:
    """struct(kind, start, end, payload): a free word with one of the upper candidates of its place (candidates: an array for each place).

    Candidates that are no words, that equal the word, or that are longer than 20 and three times the word do not count.
    """
    free = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.array_contains(claimed, i))

    def attempt(k: Column, free: Column) -> Column:
        def among(x: Column) -> Column:
            own = x["own"]
            fits = lambda c: looks_like_word(c) & (F.lower(F.trim(c)) != F.lower(F.trim(own))) & (F.length(c) <= F.greatest(F.lit(20), 3 * F.length(own)))
            chosen = _let(F.filter(x["found"], fits), lambda found: _from_top(found, top, uniform(k, seed + 1)))
            return _let(chosen, lambda c: F.when(c.isNotNull(), _operation("repl", x["at"], x["at"] + 1, c)))

        at = F.get(free, pick_index(uniform(k, seed), F.size(free)))
        return _let(at, lambda i: _let(F.struct(i.alias("at"), F.get(words, i).alias("own"), F.get(candidates, i).alias("found")), among))

    return _let(free, lambda f: F.when(F.size(f) > 0, _tries(lambda k: attempt(k, f), key, tries)))


def deletable_spans(n: Column, claimed: Column, longest: int) -> Column:
    """array<struct<start, end>> of all runs of 1..longest words that leave a word on each side and touch no claimed one, nor the word behind."""
    starts = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - s - 1)), lambda k: F.struct(s.alias("start"), (s + k).alias("end")))))
    return F.filter(spans, lambda x: ~F.exists(claimed, lambda c: (c >= x["start"]) & (c <= x["end"])))


def propose_gap(words: Column, claimed: Column, high: Column, key: Column, *, longest: int = 3, p_high: float = 0.85, seed: int = 23) -> Column:
    """struct(kind, start, end, payload null): words to be taken out, which a later insertion brings back.

    `high`: places of words of high priority; spans that start with one are drawn from with chance `p_high`, or if there are no others.
    """
    spans = deletable_spans(F.size(words), claimed, longest)

    def choose(spans: Column) -> Column:
        upper, lower = spans["upper"], spans["lower"]
        pool = F.when((uniform(key, seed) < p_high) & (F.size(upper) > 0), upper).when(F.size(lower) > 0, lower).otherwise(upper)
        return _let(pool, lambda p: F.when(F.size(p) > 0, _let(F.get(p, pick_index(uniform(key, seed + 1), F.size(p))), lambda x: _operation("ins", x["start"], x["end"], F.lit(None).cast("string")))))

    marked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_contains(high, x["start"]).alias("high")))
    return _let(marked, lambda m: _let(F.struct(F.filter(m, lambda x: x["high"]).alias("upper"), F.filter(m, lambda x: ~x["high"]).alias("lower")), choose))


def propose_insertion(words: Column, claimed: Column, ranked: Column, key: Column, *, longest: int = 3, top: int = 10, p_first: float = 0.5, tries: int = 3, seed: int = 25) -> Column:
    """struct(kind, start, end, payload): words to put before a free word, grown one at a time.

    ranked: map of a word to the candidates for what follows it; the first grows from the word before the place.  A step takes
    the first candidate with chance `p_first`, else one of the upper half; growth ends where there is none.
    """
    free = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i >= 1) & ~F.array_contains(claimed, i))

    def attempt(k: Column, free: Column, by_word: Column) -> Column:
        wanted = 1 + pick_index(uniform(k, seed + 1), F.lit(longest))

        def grow(state: Column, step: Column) -> Column:
            last = F.element_at(state, -1)
            found = F.filter(F.coalesce(F.try_element_at(by_word, last), F.array().cast("array<string>")), looks_like_word)
            draw = k * 16 + step
            pick = lambda f: F.when(uniform(draw, seed + 2) < p_first, F.get(f, F.lit(0))).otherwise(_from_top(f, top, uniform(draw, seed + 3)))
            # a state of fewer words than steps has ended
            longer = _let(_let(found, pick), lambda w: F.when(w.isNotNull(), F.concat(state, F.array(w))).otherwise(state))
            return F.when((step <= wanted) & (F.size(state) == step), longer).otherwise(state)

        def at_place(at: Column) -> Column:
            grown = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.array(F.get(words, at - 1)), grow)
            return _let(F.array_join(F.slice(grown, 2, longest), " "), lambda p: F.when(p != "", _operation("del", at, at, p)))

        return _let(F.get(free, pick_index(uniform(k, seed), F.size(free))), at_place)

    both = F.struct(free.alias("free"), ranked.alias("ranked"))
    return _let(both, lambda b: F.when(F.size(b["free"]) > 0, _tries(lambda k: attempt(k, b["free"], b["ranked"]), key, tries)))


#: Reasons for which a compound draw is given up.
TOO_SHORT, UNSUITABLE = "too_short_sentence", "ops_unsuitable"


def claimed_places(op: Column) -> Column:
    """Places that an operation takes from later ones: its words, and the word behind words that are taken out."""
    last = F.when(op["kind"] == "ins", op["end"]).otherwise(op["start"])
    return F.sequence(op["start"], last)


def compound_draw(words: Column, types: Column, candidates: Column, high: Column, ranked: Column, key: Column, *, least_words: int = 3, top: int = 10) -> Column:
    """struct(ops, reason): operations of the given types (REPL, INS, DEL) drawn one after the other, each kept off the places of the earlier.

    A fold over the types with the places claimed so far as its state; the draws of the i-th operation are keyed by 8 * key + i.
    With the first operation that finds no place the draw is given up: no operations, and a reason (null otherwise).
    """
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,payload:string>>")

    def step(state: Column, item: Column) -> Column:
        own, claimed = key * 8 + item["i"], state["claimed"]
        proposed = (
            F.when(item["type"] == "REPL", propose_replacement(words, claimed, candidates, own, top=top))
            .when(item["type"] == "INS", propose_gap(words, claimed, high, own))
            .otherwise(propose_insertion(words, claimed, ranked, own, top=top))
        )

        def taken(op: Column) -> Column:
            return F.when(op.isNull(), F.struct(state["ops"].alias("ops"), claimed.alias("claimed"), F.lit(UNSUITABLE).alias("reason"))).otherwise(
                F.struct(F.concat(state["ops"], F.array(op)).alias("ops"), F.concat(claimed, claimed_places(op)).alias("claimed"), F.lit(None).cast("string").alias("reason"))
            )

        return F.when(state["reason"].isNotNull(), state).otherwise(_let(proposed, taken))

    short = F.when(F.size(words) < least_words, TOO_SHORT)
    begin = F.struct(nothing.alias("ops"), F.array().cast("array<int>").alias("claimed"), short.alias("reason"))
    items = F.transform(types, lambda t, i: F.struct(t.alias("type"), i.alias("i")))
    return F.aggregate(items, begin, step, lambda s: F.struct(F.when(s["reason"].isNull(), s["ops"]).otherwise(nothing).alias("ops"), s["reason"].alias("reason")))
