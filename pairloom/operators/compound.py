"""Compound word edits of a text: conflicts, application, token ranges, training arrays and partial reversal.

An operation is struct(op, ws, we, payload) over word indices of the original
text: `repl` puts the payload in place of the words, `ins` takes them out (an
editor is to insert them), `del` puts the payload before word ws (an editor is
to delete it).  Words are struct(w, cs, ce).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pairloom.functions.text import let
from pairloom.operators.alignment import span_to_tokens, splice, token_at


def _range(low: Column, high: Column) -> Column:
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))


def _claims(o: Column) -> dict[str, Column]:
    """Words, gaps and insertion points that an operation keeps others from."""
    none, is_ins, is_del = F.array().cast("array<int>"), o["op"] == "ins", o["op"] == "del"
    own = F.array(o["ws"])
    return {
        "words": F.when(is_ins, _range(o["ws"], o["we"])).otherwise(own),
        "gaps": F.when(is_ins, F.array(o["we"])).when(is_del, own).otherwise(none),
        "closed": F.when(is_ins, _range(o["ws"], o["we"] + 1)).otherwise(none),
        "points": F.when(is_del, own).otherwise(none),
    }


def conflicts(earlier: Column, later: Column) -> Column:
    """Whether an operation may not join one that was taken before."""
    c = _claims(earlier)
    taken = F.concat(c["words"], c["gaps"])
    span, wide = _range(later["ws"], later["we"]), _range(later["ws"], later["we"] + 1)
    point = F.array(later["ws"])
    return (
        F.when(later["op"] == "repl", F.arrays_overlap(span, taken))
        .when(later["op"] == "ins", F.arrays_overlap(wide, taken) | F.arrays_overlap(wide, c["closed"]))
        .otherwise(F.arrays_overlap(point, F.concat(taken, c["closed"], c["points"])))
    )


def compatible(proposed: Column) -> Column:
    """The operations in order, each kept if it conflicts with none kept before."""
    empty = F.filter(proposed, lambda _: F.lit(False))
    return F.aggregate(proposed, empty, lambda kept, o: F.when(F.exists(kept, lambda k: conflicts(k, o)), kept).otherwise(F.concat(kept, F.array(o))))


def text_edit(text: Column, words: Column, o: Column) -> Column:
    """struct(cs, ce, new); taking words out takes one space after them too."""
    cs = F.element_at(words, o["ws"] + 1)["cs"]
    end = F.element_at(words, F.greatest(o["we"], F.lit(1)))["ce"]
    after = F.when(F.substr(text, end + 1, F.lit(1)).rlike(r"^\s$"), end + 1).otherwise(end)
    ce = F.when(o["op"] == "repl", end).when(o["op"] == "ins", after).otherwise(cs)
    new = F.when(o["op"] == "repl", o["payload"]).when(o["op"] == "ins", "").otherwise(F.concat(o["payload"], F.lit(" ")))
    return F.struct(cs.alias("cs"), ce.alias("ce"), new.alias("new"))


def text_edits(text: Column, words: Column, ops: Column) -> Column:
    return F.transform(ops, lambda o: text_edit(text, words, o))


def change(edit: Column) -> Column:
    """Characters that an edit adds."""
    return F.length(edit["new"]) - (edit["ce"] - edit["cs"])


def apply_compound(text: Column, words: Column, ops: Column) -> Column:
    """struct(text, places): the edited text and where each operation stands in it."""

    def made(edits: Column) -> Column:
        before = lambda e: F.aggregate(F.filter(edits, lambda x: x["cs"] < e["cs"]), F.lit(0), lambda n, x: n + change(x))
        return F.struct(splice(text, edits).alias("text"), F.transform(edits, lambda e: e["cs"] + before(e)).alias("places"))

    return let(text_edits(text, words, ops), made)


def edited_ranges(text: Column, words: Column, ops: Column, places: Column, marker: int = 5) -> Column:
    """struct(x, xp) of array<struct<cs, ce>>: what an operation touches in the original and in the edited text.

    Words taken out leave a window of `marker` characters behind, text put in a window of a character on both sides.
    """
    both = F.arrays_zip(ops.alias("o"), places.alias("p"), text_edits(text, words, ops).alias("e"))
    span = lambda a, b: F.struct(a.cast("int").alias("cs"), b.cast("int").alias("ce"))
    end = lambda x: F.element_at(words, F.greatest(x["o"]["we"], F.lit(1)))["ce"]
    x_side = F.transform(both, lambda x: F.when(x["o"]["op"] == "del", span(F.greatest(x["e"]["cs"] - 1, F.lit(0)), F.least(x["e"]["cs"] + 1, F.length(text)))).otherwise(span(x["e"]["cs"], end(x))))
    xp_side = F.transform(both, lambda x: span(x["p"], x["p"] + F.when(x["o"]["op"] == "ins", marker).otherwise(F.length(x["o"]["payload"]))))
    real = lambda r: F.filter(r, lambda s: s["ce"] > s["cs"])
    return F.struct(real(x_side).alias("x"), real(xp_side).alias("xp"))


def token_ranges(words: Column, ops: Column, places: Column, x_tokens: Column, xp_tokens: Column) -> Column:
    """array<struct<op, xs, xe, ps, pe, gap>> in tokens of both texts; null if one does not resolve or a replacement changes the number of tokens."""

    def of(z: Column) -> Column:
        o, place = z["o"], z["p"]
        x = span_to_tokens(x_tokens, F.element_at(words, o["ws"] + 1)["cs"], F.element_at(words, F.greatest(o["we"], F.lit(1)))["ce"])
        p = span_to_tokens(xp_tokens, place, place + F.length(o["payload"]))
        both = F.struct(F.when(o["op"] != "del", x).alias("x"), F.when(o["op"] != "ins", p).alias("p"))
        gap = F.when(o["op"] == "ins", token_at(xp_tokens, place))
        return let(both, lambda b: F.struct(o["op"].alias("op"), b["x"]["ts"].alias("xs"), b["x"]["te"].alias("xe"), b["p"]["ts"].alias("ps"), b["p"]["te"].alias("pe"), gap.alias("gap")))

    def checked(r: Column) -> Column:
        bad = lambda t: ((t["op"] != "del") & t["xs"].isNull()) | ((t["op"] != "ins") & t["ps"].isNull()) | ((t["op"] == "ins") & t["gap"].isNull()) | ((t["op"] == "repl") & (t["pe"] - t["ps"] != t["xe"] - t["xs"]))
        return F.when(~F.exists(r, lambda t: F.coalesce(bad(t), F.lit(True))), r)

    return let(F.transform(F.arrays_zip(ops.alias("o"), places.alias("p")), of), checked)


_GOLD = StructType([StructField("tags", ArrayType(IntegerType())), StructField("input", ArrayType(LongType())), StructField("target", ArrayType(LongType()))])
_GOLD_ARROW = pa.struct([("tags", pa.list_(pa.int32())), ("input", pa.list_(pa.int64())), ("target", pa.list_(pa.int64()))])


def gold_row(ranges: list[dict], x: list, xp: list, mask_id: int, ins_id: int, del_id: int) -> dict | None:
    """tags, input and target of one text, as in `compound_gold`."""
    own, gaps = [None] * len(xp), {}
    for op in ("repl", "del"):
        for t in ranges:
            if t["op"] == op and t["ps"] is not None and t["pe"] is not None:
                for k in range(max(t["ps"], 0), min(t["pe"], len(xp))):
                    own[k] = own[k] or t
    for t in ranges:
        if t["op"] == "ins" and t["gap"] is not None:
            gaps.setdefault(t["gap"], t)
    tags, cells = [], []
    for k, token in enumerate(xp):
        t, gap = own[k], gaps.get(k)
        if t and t["op"] == "repl" and t["xs"] is None or gap and None in (gap["xs"], gap["xe"]):
            return None
        tags.append((1 if t["op"] == "repl" else 3) if t else 2 if gap else 0)
        if t:
            cells.append((mask_id, x[t["xs"] + k - t["ps"]]) if t["op"] == "repl" else (token, del_id))
            continue
        if gap:
            cells.extend((ins_id, missing) for missing in x[gap["xs"] : gap["xe"]])
        cells.append((token, token))
    if tags.count(2) != sum(t["op"] == "ins" for t in ranges) or [t for _, t in cells if t != del_id] != x:
        return None
    return {"tags": tags, "input": [i for i, _ in cells], "target": [t for _, t in cells]}


@F.arrow_udf(_GOLD)
def _gold(ranges: pa.Array, x_ids: pa.Array, xp_ids: pa.Array, mask_id: pa.Array, ins_id: pa.Array, del_id: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (ranges, x_ids, xp_ids, mask_id, ins_id, del_id)), strict=True)
    return pa.array([None if None in row[:3] else gold_row(*row) for row in rows], _GOLD_ARROW)


_gold_once = _gold.asNondeterministic()


def compound_gold(ranges: Column, x_ids: Column, xp_ids: Column, mask_id: int, ins_id: int, del_id: int) -> Column:
    """struct(tags, input, target) over the edited text's tokens from known token ranges.

    Tags are 0 keep, 1 replace, 2 insert before, 3 delete.  Null if an insertion meets another edit or the
    target without its deletions is not the original.
    """
    ids = lambda c: c.cast("array<bigint>")
    return _gold_once(ranges, ids(x_ids), ids(xp_ids), *(F.lit(v).cast("long") for v in (mask_id, ins_id, del_id)))


def editor_pair(xp_ids: Column, input_: Column, target: Column, sep_id: int, del_id: int, bos_id: int, ignore: int = -100) -> Column:
    """struct(input, target, start): edited text, separator and template without deletions and second start token; labels on the template only."""

    def made(c: Column) -> Column:
        body = F.when(F.element_at(c, 1)["i"] == bos_id, F.slice(c, 2, F.size(c))).otherwise(c)
        return F.struct(
            F.concat(xp_ids, F.array(F.lit(sep_id).cast("long")), F.transform(body, lambda x: x["i"])).alias("input"),
            F.concat(F.array_repeat(F.lit(ignore).cast("long"), F.size(xp_ids) + 1), F.transform(body, lambda x: x["t"])).alias("target"),
            (F.size(xp_ids) + 1).alias("start"),
        )

    return let(F.filter(F.arrays_zip(input_.alias("i"), target.alias("t")), lambda x: x["t"] != del_id), made)


def rebase(text: Column, words: Column, ops: Column, chosen: Column) -> Column:
    """struct(text, edits): the text with all but the chosen operations (positions in `ops`) applied, and these as edits of it.

    Null without a chosen operation or where one's span does not survive as it was.
    """
    indexed = F.transform(text_edits(text, words, ops), lambda e, i: F.struct(e.alias("e"), F.array_contains(chosen, i).alias("c")))

    def made(z: Column) -> Column:
        rest = F.transform(F.filter(z, lambda x: ~x["c"]), lambda x: x["e"])
        inside = lambda p: F.exists(rest, lambda r: (r["cs"] < p) & (p < r["ce"]))
        at = lambda p: p + F.aggregate(F.filter(rest, lambda r: r["ce"] <= p), F.lit(0), lambda n, r: n + change(r))
        moved = F.transform(F.filter(z, lambda x: x["c"]), lambda x: F.struct(F.when(~inside(x["e"]["cs"]), at(x["e"]["cs"])).alias("cs"), (at(x["e"]["cs"]) + x["e"]["ce"] - x["e"]["cs"]).alias("ce"), x["e"]["new"].alias("new"), F.substr(text, x["e"]["cs"] + 1, x["e"]["ce"] - x["e"]["cs"]).alias("old")))
        return F.struct(splice(text, rest).alias("text"), moved.alias("m"))

    def checked(s: Column) -> Column:
        same = F.forall(s["m"], lambda m: m["cs"].isNotNull() & (F.substr(s["text"], m["cs"] + 1, m["ce"] - m["cs"]) == m["old"]))
        edits = F.transform(s["m"], lambda m: F.struct(m["cs"].alias("cs"), m["ce"].alias("ce"), m["new"].alias("new")))
        return F.when((F.size(s["m"]) > 0) & same, F.struct(s["text"].alias("text"), edits.alias("edits")))

    return let(let(indexed, made), checked)


def opcode_ranges(ops: Column, source_tokens: Column, target_tokens: Column) -> Column:
    """struct(x, xp): character ranges that opcodes touch on each side, tokens at (0, 0) left out."""

    def side(tokens: Column, low: str, high: str) -> Column:
        touched = lambda o: F.filter(F.slice(tokens, o[low] + 1, F.greatest(o[high] - o[low], F.lit(0))), lambda t: (t["cs"] != 0) | (t["ce"] != 0))
        each = F.transform(F.filter(ops, lambda o: o["tag"] != "equal"), lambda o: let(touched(o), lambda t: F.when(F.size(t) > 0, F.struct(F.element_at(t, 1)["cs"].alias("cs"), F.element_at(t, -1)["ce"].alias("ce")))))
        return F.filter(each, lambda r: r.isNotNull())

    return F.struct(side(source_tokens, "i1", "i2").alias("x"), side(target_tokens, "j1", "j2").alias("xp"))


def firing_mask(tokens: Column, features: Column) -> Column:
    """Per token whether one of the features fires in its map of activations; null if none does anywhere."""
    hit = F.transform(tokens, lambda m: F.exists(features, lambda f: F.coalesce(F.try_element_at(m, f), F.lit(0.0)) > 0))
    return let(hit, lambda h: F.when(F.exists(h, lambda x: x), h))
