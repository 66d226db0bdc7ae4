"""Rewriting of sentences by rules held as data, over word positions.

A sentence is split at spaces.  A rule names the parts of a sentence from left to
right: words out of a set, any word, and stretches whose end is found by position (the
rest, the first word with a comma, the word before a given one, the end of a
quotation).  What the parts cover is put together again in the order of the rule's
target.  Rules of substitution work on a table of forms and the words' places.

All of it is native: arrays of words, their positions, slices and joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import let

# Fixed values.
TOUGH_ADJECTIVES = ("hard", "easy", "difficult", "tough", "impossible", "simple")
SPEECH_VERBS = ("said", "asked", "replied", "shouted", "whispered", "added", "answered", "explained")
CONTRACTIONS = (
    ("do not", "don't"), ("does not", "doesn't"), ("did not", "didn't"), ("is not", "isn't"), ("are not", "aren't"), ("was not", "wasn't"), ("were not", "weren't"), ("has not", "hasn't"), ("have not", "haven't"),
    ("had not", "hadn't"), ("will not", "won't"), ("would not", "wouldn't"), ("could not", "couldn't"), ("should not", "shouldn't"), ("cannot", "can't"), ("I am", "I'm"), ("you are", "you're"), ("we are", "we're"),
    ("they are", "they're"), ("I will", "I'll"), ("you will", "you'll"), ("we will", "we'll"), ("they will", "they'll"), ("I have", "I've"), ("you have", "you've"), ("we have", "we've"), ("they have", "they've"),
)
UNIVERSALS = (("every", "each"), ("each", "every"))

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class One:
    """A single word: one of `among` in any case, else any word of letters and digits."""

    name: str
    among: Sequence[str] = ()


@dataclass(frozen=True)
class Run:
    """One or more words.  `until` tests the last word; the first such word ends the run (the last one with `greedy`).

    Without `until` a run takes all words that the parts behind it leave.  `every` tests each of its words.
    """

    name: str
    until: Test | None = None
    #: the word that must follow the last one
    before: str | None = None
    greedy: bool = False
    every: Test | None = None
    least: int = 1
    most: int | None = None


@dataclass(frozen=True)
class Rule:
    kind: str
    family: str
    parts: tuple[One | Run, ...]
    #: names with `^` are capitalised, with `_` start small, with `-` lose their last character; others are words
    target: tuple[str, ...]
    #: whether both sides end with a full stop, which belongs to no part
    stop: bool = True
    #: further test of the whole text
    also: Test | None = field(default=None, compare=False)


def capital(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def small(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def _at(words: Column, place: Column) -> Column:
    return F.coalesce(F.get(words, place), F.lit(""))


def _ending(words: Column, place: Column, run: Run) -> Column:
    """For each word whether it stands at the place or behind it and may end the run."""
    follows = (lambda i: _at(words, i + 1) == run.before) if run.before else lambda i: F.lit(True)
    return F.transform(words, lambda w, i: (i >= place) & run.until(w) & follows(i))


def _matched(words: Column, rule: Rule, then: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """then(whether the parts cover the words, the text of each part); the end of each run is computed once and bound to a name."""

    def step(k: int, place: Column, tests: list[Column], found: dict[str, Column]) -> Column:
        if k == len(rule.parts):
            return then(reduce(lambda x, y: x & y, [*tests, place == F.size(words)]), found)
        part = rule.parts[k]
        if isinstance(part, One):
            word = _at(words, place)
            test = F.lower(word).isin(*(w.lower() for w in part.among)) if part.among else word.rlike(r"^\w+$")
            return step(k + 1, place + 1, [*tests, test], found | {part.name: word})
        if part.until is not None:
            here = _ending(words, place, part)
            last = F.array_position(F.reverse(here), True) if part.greedy else F.array_position(here, True)
            end = let(last, lambda x: F.when(x > 0, F.size(words) - x + 1 if part.greedy else x).otherwise(-1).cast("int"))
        else:
            end = F.size(words) - (len(rule.parts) - k - 1)

        def run(both: Column) -> Column:
            place, end = both["place"], both["end"]
            length = end - place
            taken = F.slice(words, F.greatest(place + 1, F.lit(1)), F.greatest(length, F.lit(0)))
            own = [(length >= part.least) & (length <= (part.most or 1 << 30))]
            if part.every is not None:
                own.append(F.forall(taken, part.every))
            return step(k + 1, end, [*tests, *own], found | {part.name: F.array_join(taken, " ")})

        return let(F.struct(place.cast("int").alias("place"), end.alias("end")), run)

    return step(0, F.lit(0), [], {})


def _piece(name: str, found: dict[str, Column]) -> Column:
    shape = {"^": capital, "_": small, "-": lambda s: F.substr(s, F.lit(1), F.length(s) - 1)}
    if name[:-1] in found and name[-1] in shape:
        return shape[name[-1]](found[name[:-1]])
    return found[name] if name in found else F.lit(name)


def _made(test: Column, kind: str, family: str, text: Column) -> Column:
    one = F.struct(F.lit(kind).alias("t_type"), F.lit(family).alias("family"), text.alias("out_text"))
    return F.filter(F.array(one), lambda _: F.coalesce(test, F.lit(False)))


def apply_rule(text: Column, rule: Rule) -> Column:
    """array<struct<t_type, family, out_text>> of none or one; the cheap tests of the whole text come first."""
    body = F.regexp_replace(text, r"\.$", "") if rule.stop else text

    def made(test: Column, found: dict[str, Column]) -> Column:
        joined = F.concat_ws(" ", *(_piece(name, found) for name in rule.target))
        return _made(test, rule.kind, rule.family, F.concat(joined, F.lit("." if rule.stop else "")))

    whole = let(F.split(body, " "), lambda words: _matched(words, rule, made))
    cheap = [text.endswith(".")] if rule.stop else []
    cheap += [rule.also(text)] if rule.also is not None else []
    if not cheap:
        return whole
    return F.when(reduce(lambda x, y: x & y, cheap), whole).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<t_type:string,family:string,out_text:string>>")


def _ends(mark: str) -> Test:
    return lambda w: w.endswith(mark)


_BE = One("be", ("is", "was"))
_ADJECTIVE = One("adjective", TOUGH_ADJECTIVES)
_NAME = Run("name", every=lambda w: w.rlike("^[A-Z][a-z]+$"), most=2)
_SPEECH = One("verb", SPEECH_VERBS)
_QUOTE = Run("quote", until=lambda w: w.rlike('[,!?]["”]$'), greedy=True)
_quoted = lambda text: text.rlike('^["“]')
_PLAIN = lambda w: ~w.rlike("[.!?]$")

RULES: tuple[Rule, ...] = (
    Rule("TOUGH:IT->RAISED", "TOUGH", (One("it", ("It",)), _BE, _ADJECTIVE, One("to", ("to",)), One("verb"), Run("thing")), ("thing^", "be", "adjective", "to", "verb"), also=lambda t: t.startswith("It ")),
    Rule("TOUGH:RAISED->IT", "TOUGH", (Run("thing", least=1), _BE, _ADJECTIVE, One("to", ("to",)), One("verb")), ("It", "be", "adjective", "to", "verb", "thing_"), also=lambda t: ~t.startswith("It ") & t.rlike(" (?:is|was) (?:" + "|".join(TOUGH_ADJECTIVES) + ") to ")),
    Rule("INV:IF->AUX", "INVERSION", (One("if", ("If",)), One("who"), One("aux", ("had", "were")), Run("condition", until=_ends(",")), Run("main")), ("aux^", "who", "condition", "main"), stop=False, also=lambda t: t.startswith("If ")),
    Rule("INV:AUX->IF", "INVERSION", (One("aux", ("Had", "Were")), One("who"), Run("condition", until=_ends(",")), Run("main")), ("If", "who", "aux_", "condition", "main"), stop=False, also=lambda t: t.rlike("^(Had|Were) ")),
    Rule("CLEFT:-IT", "CLEFT", (One("it", ("It",)), _BE, Run("subject", until=lambda w: w == "who", least=2), Run("rest")), ("subject^", "rest"), stop=False, also=lambda t: t.startswith("It ")),
    Rule("QI:VS->SV", "QUOTINV", (_QUOTE, _SPEECH, _NAME), ("quote", "name", "verb"), also=_quoted),
    Rule("QI:SV->VS", "QUOTINV", (_QUOTE, _NAME, _SPEECH), ("quote", "verb", "name"), also=_quoted),
    Rule("SPLIT:,and->.", "SPLITJOIN", (Run("left", until=_ends(","), before="and", least=3, every=_PLAIN), One("and", ("and",)), Run("right", least=3, every=_PLAIN)), ("left-", "right^"), also=lambda t: t.contains(", and ")),
    Rule("JOIN:.->,and", "SPLITJOIN", (Run("left", until=_ends(".")), Run("right", every=_PLAIN)), ("left-", "right_"), also=lambda t: t.contains(". ")),
)


def _with_rules(*kinds: str) -> Callable[[Column], Column]:
    """The proposals of the rules of these kinds."""
    rules = [r for r in RULES if r.kind in kinds]
    return lambda text: F.concat(*(apply_rule(text, rule) for rule in rules))


tough = _with_rules("TOUGH:IT->RAISED", "TOUGH:RAISED->IT")
inversion = _with_rules("INV:IF->AUX", "INV:AUX->IF")
quote_inversion = _with_rules("QI:VS->SV", "QI:SV->VS")


def uncleft(text: Column) -> Column:
    """It was X who ...  ->  X ..."""
    made = apply_rule(text, next(r for r in RULES if r.kind == "CLEFT:-IT"))
    # the run that ends at "who" holds it
    return F.transform(made, lambda p: p.withField("out_text", F.regexp_replace(p["out_text"], "^(.*?) who ", "$1 ")))


def split_join(text: Column) -> Column:
    """A, and B.  <->  A. B.  (split where each part has three words or more)."""
    split, join = (apply_rule(text, next(r for r in RULES if r.kind == k)) for k in ("SPLIT:,and->.", "JOIN:.->,and"))
    end = {",": Run("left", until=_ends(","), before="and"), ".": Run("left", until=_ends("."))}

    def put(p: Column, mark: str, between: str) -> Column:
        """The two parts with another mark between them; they are joined by a space so far."""
        left = lambda words: let(F.array_position(_ending(words, F.lit(0), end[mark]), True).cast("int"), lambda k: F.length(F.array_join(F.slice(words, 1, F.greatest(k, F.lit(0))), " ")) - 1)
        return let(let(F.split(text, " "), left), lambda cut: p.withField("out_text", F.concat(F.substr(p["out_text"], F.lit(1), cut), F.lit(between), F.substr(p["out_text"], cut + 2))))

    return F.concat(F.transform(split, lambda p: put(p, ",", ". ")), F.transform(join, lambda p: put(p, ".", ", and ")))


def _cased(pairs: Sequence[tuple[str, str]]) -> dict[str, str]:
    upper = lambda s: s[:1].upper() + s[1:]
    return {a: b for a, b in pairs} | {upper(a): upper(b) for a, b in pairs}


def substitution(text: Column, table: dict[str, tuple[str, str]], family: str) -> Column:
    """A proposal for each form of `table` (form -> (other form, kind)) that occurs, at its first place; forms have one or two words."""
    # one literal: a map of constants is folded once, and takes no call for each entry to build
    known = F.from_json(F.lit(json.dumps({form: f"{kind}\t{other}" for form, (other, kind) in table.items()})), "map<string,string>")
    words = F.transform(F.split(text, " "), lambda w: F.struct(F.regexp_extract(w, r"^(\W*)", 1).alias("head"), F.regexp_extract(w, r"^\W*(.*?)\W*$", 1).alias("core"), F.regexp_extract(w, r"^\W*.*?(\W*)$", 1).alias("tail")))

    def places(words: Column) -> Column:
        two = lambda w, i: F.when((w["tail"] == "") & (F.get(words, i + 1)["head"] == ""), F.concat(w["core"], F.lit(" "), F.get(words, i + 1)["core"]))
        one = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.lit(1).alias("n"), w["core"].alias("form")))
        return F.filter(F.concat(one, F.transform(words, lambda w, i: F.struct(i.alias("i"), F.lit(2).alias("n"), two(w, i).alias("form")))), lambda p: p["form"].isNotNull() & F.element_at(known, p["form"]).isNotNull())

    def made(words: Column, p: Column) -> Column:
        other = F.split(F.element_at(known, p["form"]), "\t")
        last = F.get(words, p["i"] + p["n"] - 1)
        whole = lambda part: F.transform(part, lambda w: F.concat(w["head"], w["core"], w["tail"]))
        here = F.concat(F.get(words, p["i"])["head"], other[1], last["tail"])
        parts = F.concat(whole(F.slice(words, 1, p["i"])), F.array(here), whole(F.slice(words, p["i"] + p["n"] + 1, F.size(words))))
        return F.struct(other[0].alias("t_type"), F.lit(family).alias("family"), F.array_join(parts, " ").alias("out_text"))

    def proposals(words: Column) -> Column:
        found = places(words)
        first = lambda found: F.filter(found, lambda p: F.array_min(F.transform(F.filter(found, lambda q: q["form"] == p["form"]), lambda q: q["i"])) == p["i"])
        return F.transform(first(found), lambda p: made(words, p))

    # most texts hold none of the forms
    some = text.rlike("|".join(re.escape(form) for form in sorted(table)))
    return F.when(some, F.flatten(F.transform(F.array(words), proposals))).otherwise(_none())


def contraction(text: Column, pairs: Sequence[tuple[str, str]] = CONTRACTIONS) -> Column:
    """Full forms fused and contracted forms split, each at its first place."""
    forms = _cased(pairs)
    return substitution(text, {a: (b, "CTR:FUSE") for a, b in forms.items()} | {b: (a, "CTR:SPLIT") for a, b in forms.items()}, "CONTRACT")


def each_every(text: Column) -> Column:
    """every <-> each."""
    kind = {a: f"DETQ:{a}->{b}" for a, b in UNIVERSALS}
    return substitution(text, {a: (b, kind[a.lower()]) for a, b in _cased(UNIVERSALS).items()}, "DETQUANT")
