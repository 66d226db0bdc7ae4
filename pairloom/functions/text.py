"""Scalar text functions as native columns: sentences, prose quality, equality, n-grams, SARI and verdict parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the prose-quality predicate.
LIST_ITEM = r"^\s*(?:[*\-•]|\d{1,3}[.)]|[a-zA-Z][.)])\s+"
URL = r"https?://|www\.[A-Za-z0-9]"
PUNCTUATION_RUN = r"[^\p{L}\p{N}_\s\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}]{5,}"
TERMINAL = r"[.!?。！？…‼⁇⁈⁉][\"'”’)\]》]*$"

#: A sentence: text up to and with its closing punctuation, within a line.
SENTENCE = r"[^.!?\n]+[.!?]*"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space as in Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Without white space at either end; no regular expression, as it is evaluated in many tests of one text."""
    return F.btrim(s, F.lit(SPACES))


def collapse(s: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def words(s: Column) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(1)), strip), lambda s: s != "")


# Sentences with protected spans

#: Abbreviations that a sentence goes on after, and those that it goes on after where no capital follows.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Sra", "Jr", "Gen", "Col", "Capt", "Lt", "Sgt", "Rev", "Hon", "Gov", "Sen", "Mme", "Mlle", "Hr", "Fr", "Ud", "Uds", "vs", "cf", "Fig", "Figs", "Vol", "pp", "Abs", "Art", "Bd", "bzw", "vgl", "ggf", "sog")
LIGHT = ("etc", "Inc", "Ltd", "Co", "Corp", "usw", "al", "ca", "approx", "dept", "est")
NUMBERED = ("No", "Nos", "Nr", "núm", "p", "S", "vol", "fig", "ch", "sec")


def _boundaries(hold: str) -> str:
    """An automaton over characters as a regular expression: one sentence with its closing marks and what white space follows.

    Inside a sentence, a word is taken whole, so abbreviations are looked for where words begin.  Full stops do not end it
    within quotations and parentheses of one line, after titles, after single letters (initials, "e.g.", "z. B."), before a
    number after "No.", in numbers and names ("3.14", "a.b"), and where an ellipsis or a light abbreviation is followed by a
    small letter.  Otherwise it ends after a run of marks, with closing quotes, before white space or the end; and at line ends.
    `hold`: "+" to never give back what a repetition took (no recursion for long texts), "" for engines without that.
    """
    marks, close = r"[.!?…]", r"""["'”’»)\]]"""
    ends = rf"(?:{marks}+{close}*)+{hold}"
    inside = "|".join((
        r'"[^"\n]*"', r"“[^”\n]*”", r"«[^»\n]*»", r"\([^()\n]*\)",
        rf"(?:{'|'.join(TITLES)})\.", rf"(?:{'|'.join(LIGHT)})\.[ \t]+[\p{{Ll}}0-9,;(]", rf"(?:{'|'.join(NUMBERED)})\.[ \t]*[0-9]",
        r"(?:\p{L}\.)+" + hold, rf"(?:\.\.\.|…)[ \t]+\p{{Ll}}", rf"[\p{{L}}\p{{M}}\p{{N}}]+{hold}",
        rf"{ends}[^ \t\n\r\f\x0B.!?…\"'”’»)\]]", r"[^.!?…\n]",
    ))
    return rf"(?:{inside})*{hold}(?:{ends}(?:[ \t\r\f\x0B]+|\n+|\z)|\n+|\z)"


SPLITTER, SQL_SPLITTER = _boundaries("+"), _boundaries("")


def split_sentences(text: Column) -> Column:
    """Sentences of a text in order, white space at their ends taken off; abbreviations, initials, numbers, quotations and ellipses do not end one.

    A null text gives null, an empty one none; a text of any length is read whole.
    """
    found = F.regexp_extract_all(text, F.lit(f"({SPLITTER})"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda s: s != "")


@dataclass(frozen=True)
class ProseQuality:
    """Which strings read like sentences; every test can be set or switched off."""

    min_words: int = 3
    min_alpha_ratio: float = 0.5
    terminal: bool = True
    urls: bool = True
    list_items: bool = True
    punctuation_runs: bool = True
    initial_capital: bool = False

    def __call__(self, text: Column) -> Column:
        s = strip(text)
        test = (F.length(s) > 0) & (F.size(words(s)) >= self.min_words) & (alpha_ratio(s) >= self.min_alpha_ratio)
        if self.terminal:
            test &= s.rlike(TERMINAL)
        if self.urls:
            test &= ~s.rlike(URL)
        if self.list_items:
            test &= ~s.rlike(LIST_ITEM)
        if self.punctuation_runs:
            test &= ~s.rlike(PUNCTUATION_RUN)
        if self.initial_capital:
            test &= ~s.rlike(r"^[^\p{L}]*[\p{L}&&[^\p{Lu}]]")
        return F.coalesce(test, F.lit(False))


def alpha_ratio(s: Column) -> Column:
    """Letters over all characters."""
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, r"\P{L}+", "")) / F.length(s))


def looks_like_word(s: Column) -> Column:
    """Has a letter and is no continuation piece."""
    return s.rlike(r"\p{L}") & ~s.startswith("##") & ~s.startswith("▁")


def exact_casefold(a: Column, b: Column) -> Column:
    """Equal up to case and white space; German sharp s counts as ss."""
    fold = lambda s: F.lower(F.regexp_replace(collapse(s), "[ßẞ]", "ss"))
    return fold(a) == fold(b)


def exact_spaces(a: Column, b: Column) -> Column:
    return collapse(a) == collapse(b)


def exact_strip(a: Column, b: Column) -> Column:
    return strip(a) == strip(b)


def ngrams(items: Column, n: int) -> Column:
    """Set of n-word runs, joined by a space."""
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _share(hit: Column, of: Column, other: Column) -> Column:
    return F.when((of == 0) & (other == 0), 1.0).when(of == 0, 0.0).otherwise(hit / F.greatest(of, F.lit(1)))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def sari(source: Column, output: Column, reference: Column) -> Column:
    """SARI over sets of 1- to 4-grams with one reference, 0 to 100."""

    def counts(g: Column) -> Column:
        s, o, r = g["s"], g["o"], g["r"]
        sets = {"k": (F.array_intersect(s, o), F.array_intersect(s, r)), "a": (F.array_except(o, s), F.array_except(r, s)), "d": (F.array_except(s, o), F.array_except(s, r))}
        size = lambda x: F.size(x).cast("double")
        return F.struct(*(c for name, (x, y) in sets.items() for c in (size(x).alias(f"{name}1"), size(y).alias(f"{name}2"), size(F.array_intersect(x, y)).alias(f"{name}0"))))

    def score(c: Column) -> Column:
        f = lambda n: _f1(_share(c[f"{n}0"], c[f"{n}1"], c[f"{n}2"]), _share(c[f"{n}0"], c[f"{n}2"], c[f"{n}1"]))
        return (f("k") + f("a") + _share(c["d0"], c["d1"], c["d2"])) / 3

    def mean(w: Column) -> Column:
        grams = lambda n: F.struct(*(ngrams(w[x], n).alias(x) for x in "sor"))
        return sum((let(let(grams(n), counts), score) for n in range(1, 5)), F.lit(0.0)) / 4 * 100

    return let(F.struct(*(words(F.lower(x)).alias(n) for n, x in zip("sor", (source, output, reference), strict=True))), mean)


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    """Of two arrays as sets; `empty` for an empty union."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty).cast("double"))


def symmetric_difference_size(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def humanise(name: Column) -> Column:
    return F.translate(name, "_", " ")


def truncate(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


# Verdict parsing


def parse_relation(text: Column) -> Column:
    """MORE, LESS or SAME, the first of the three that occurs in this order of priority."""
    t = F.upper(F.coalesce(text, F.lit("")))
    return F.when(t.contains("MORE"), "MORE").when(t.contains("LESS"), "LESS").when(t.contains("SAME"), "SAME")


def parse_choice(text: Column) -> Column:
    """A, B or C: a letter at the start, else after ANSWER, else the last lone one."""
    t = F.upper(F.regexp_replace(F.regexp_replace(strip(text), "^[\"'`* ]+", ""), "[\"'`* ]+$", ""))
    start = F.regexp_extract(t, r"^([ABC])(?:$|\P{L})", 1)
    named = F.regexp_extract(t, r"\bANSWER\s*(?:IS|:)?\s*([ABC])\b", 1)
    lone = F.element_at(F.regexp_extract_all(t, F.lit(r"\b([ABC])\b"), F.lit(1)), -1)
    return F.when(start != "", start).when(named != "", named).otherwise(F.when(F.size(F.regexp_extract_all(t, F.lit(r"\b([ABC])\b"), F.lit(1))) > 0, lone))


def parse_yes_no(text: Column) -> Column:
    """1 for YES and 0 for NO: a prefix, else the first such word."""
    word = F.regexp_extract(F.upper(strip(text)), r"\b(YES|NO)\b", 1)
    return F.when(word == "YES", 1).when(word == "NO", 0)


def parse_rubric(text: Column) -> Column:
    """struct(concept, instruct, fluency) of digits 0 to 2, else null."""
    pattern = r"(?is)concept\s*=\s*([0-2]).*?instruct\s*=\s*([0-2]).*?fluency\s*=\s*([0-2])"
    digit = lambda k: F.regexp_extract(text, pattern, k).cast("int")
    return F.when(text.rlike(pattern), F.struct(digit(1).alias("concept"), digit(2).alias("instruct"), digit(3).alias("fluency")))


def parse_rating(text: Column) -> Column:
    """0, 1 or 2 after the last `Rating:` (brackets optional), else the last [[x]]."""
    tail = F.element_at(F.split(strip(F.element_at(F.split(text, "Rating:"), -1)), "\n"), 1)
    plain = F.regexp_replace(F.regexp_replace(F.translate(strip(tail), "[]", ""), r"\.+$", ""), "^[\"'* ]+|[\"'* ]+$", "")
    value = plain.try_cast("double")
    boxed = F.regexp_extract_all(text, F.lit(r"\[\[([0-2])\]\]"), F.lit(1))
    return F.when(text.contains("Rating:"), F.when(value.isin(0.0, 1.0, 2.0), value.cast("int"))).otherwise(F.when(F.size(boxed) > 0, F.element_at(boxed, -1).cast("int")))


def unflip(relation: Column, flipped: Column) -> Column:
    """Turns MORE and LESS round where the two texts were shown in reverse order."""
    return F.when(flipped & (relation == "MORE"), "LESS").when(flipped & (relation == "LESS"), "MORE").otherwise(relation)


def realized(gold: Column, system: Column, copied: Column) -> Column:
    """Null where gold is undecided; else whether the system's verdict agrees with gold's side."""
    return F.when(gold == "equal", F.lit(None).cast("boolean")).when(gold == "tgt", system == "out").when(gold == "src", (system == "src") & ~copied)


def first_line(text: Column, fallback: Column) -> Column:
    """First usable line of a generation, quotes and lead-ins stripped; `fallback` without one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda s: F.regexp_replace(strip(s), r'^[\s"]+|[\s"]+$', ""))
    plain = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)^(?:rewritten sentence:|sentence:|output:)", ""), r'^[\s"]+|[\s"]+$', ""))
    return F.coalesce(F.try_element_at(F.filter(plain, lambda s: s != ""), F.lit(1)), fallback)


def or_default(parsed: Column, default) -> Column:
    """Unparsed verdicts count as the cautious one."""
    return F.coalesce(parsed, F.lit(default))
