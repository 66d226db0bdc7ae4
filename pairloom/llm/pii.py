"""Format-preserving pseudonyms of personal data, in DataFrame operations only.

Validated numbers and dates are permuted by a keyed Feistel network over mixed
radices within their own format, so equal values get equal pseudonyms in all
documents and different values different ones:

- payment cards: 13 to 19 digits (or groups of 4-4-4-4 or 4-6-5) that pass Luhn;
  the first digit stays and the last is the new Luhn digit;
- IBANs that pass modulo 97, in one piece or in groups of four; country and letters stay, check digits are new;
- IPv4 addresses with octets up to 255;
- telephone numbers (international, or of ten digits with an area code, which count
  as +1): the country code stays, the national number is permuted by its digits
  alone, so that +49 30 123456 and +4930123456 stay one number;
- US social security numbers that can exist, permuted among those that can;
- calendar dates from the year 100 on (2024-01-31, 31.01.2024, 01/31/2024 or
  31/01/2024) that exist, whatever their format, as one day: permuted within blocks
  of 200 years, days of the month up to 12 among themselves and later ones among
  themselves, so that 31/01/2024 is not mistaken for month and day afterwards;
- e-mail addresses: the letters and digits of the local part, in lower case,
  permuted as numbers to base 36 in parts of 24, each part keyed by the one before;
  the domain stays.

The round function is SHA-256 of key, kind, round and the other half.  The key is an
argument, or the session's `spark.pairloom.pii.secret`; where neither is given each
Spark application draws one of its own, so its pseudonyms are linked among themselves
and nobody can turn them back.  The key stands in the query plan: who may read plans
and event logs may know it.

Texts without digit and without @ are passed through.

Defined results: a null text stays null, an empty one empty; what does not
validate stays as it is; a text without findings comes out unchanged; repeated rows
each come out; texts of any length are searched whole (repetitions in the patterns
are bounded or possessive, so no text exhausts the matcher's stack).
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

ROUNDS = 10

_EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z])"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)"
#: Countries by the length of their IBANs; in groups of four the end is not seen otherwise.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN_LENGTHS.items())
#: Candidates in groups of four, also where they overlap.
_GROUPED_IBAN = rf"(?<!\w)(?=((?:{_GROUPED}|(?!{'|'.join(_IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}\d{{2}}(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?!\w)))"
_CARD = r"(?<![\w])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_DATE = r"(?<![\w/-])\d{4}-\d{2}-\d{2}(?![\w/-])|(?<![\w.])\d{2}\.\d{2}\.\d{4}(?!\w|\.\d)|(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])"
_PHONE = r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![.-]?\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
#: Country calling codes of one or two digits (all others have three).
_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
FOUND = "|".join((_EMAIL, _IBAN, _CARD, _SSN, _DATE, _PHONE, _IP))


def _power(base: int, n: Column) -> Column:
    """base ** n, exactly, for results below 2 ** 63."""
    values = [base**k for k in range(64) if base**k < 2**63]
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), n + 1)


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, invert: bool = False) -> Column:
    """struct(l, r): a permutation of the pairs below (left_size, right_size), keyed by key, kind and tweak."""

    def merge(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, state["r"]).otherwise(state["l"])
        size = F.when(even, left_size).otherwise(right_size)
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak, left_size.cast("string"), right_size.cast("string"), i.cast("string"), other.cast("string")), 256)
        step = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)
        moved = F.when(even, state["l"]).otherwise(state["r"]) + (-step if invert else step)
        moved = F.pmod(moved, size)
        return F.struct(F.when(even, moved).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(moved).alias("r"))

    rounds = list(range(ROUNDS))[:: -1 if invert else 1]
    return F.aggregate(F.array(*map(F.lit, rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), merge)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(key: str, kind: str, digits: Column, invert: bool, tweak: Column | None = None) -> Column:
    """Up to 36 digits, permuted; one or no digit stays."""

    def body(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        left, right = F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1).cast("long")
        out = feistel(key, kind, left, right, _power(10, u), _power(10, v), tweak if tweak is not None else F.lit(""), invert)
        joined = _let(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), u, F.lit("0")), F.lpad(s["r"].cast("string"), v, F.lit("0"))))
        return F.when(F.length(d) < 2, d).otherwise(joined)

    return _let(digits, body)


def _refill(shape: Column, symbols: Column, slot: str) -> Column:
    """`shape` with its characters that match `slot` replaced by `symbols` in turn."""
    merge = lambda s, c: F.when(c.rlike(slot), F.struct(F.concat(s["o"], F.substr(symbols, s["k"] + 1, F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("o"), F.lit(0).alias("k")), merge, lambda s: s["o"])


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last not doubled."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))))
    return F.aggregate(at, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _mod97(text: Column) -> Column:
    """Of a string of digits and capital letters (A = 10)."""

    def merge(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[A-Z]"), F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(s * 10 + F.coalesce(c.cast("int"), F.lit(0)), F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), merge)


def _card(key: str, m: Column, invert: bool) -> Column:
    def body(d: Column) -> Column:
        n = F.length(d)
        inner = _permuted_digits(key, "card", F.substr(d, F.lit(2), n - 2), invert, F.substr(d, F.lit(1), F.lit(1)))
        return _let(F.concat(F.substr(d, F.lit(1), F.lit(1)), inner), lambda p: _refill(m, F.concat(p, F.pmod(-_luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")), "[0-9]"))

    return _let(_digits(m), body)


def _joined(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _is_iban(m: Column) -> Column:
    return _let(_joined(m), lambda j: _mod97(F.concat(F.substr(j, F.lit(5)), F.substring(j, 1, 4))) == 1)


def _iban(key: str, m: Column, invert: bool) -> Column:
    country, body = F.substring(m, 1, 2), F.substr(m, F.lit(5))
    moved = _refill(body, _permuted_digits(key, "iban", _digits(body), invert, F.concat(country, F.regexp_replace(_joined(body), "[0-9]", "0"))), "[0-9]")
    return _let(moved, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(_joined(b), country, F.lit("00")))).cast("string"), 2, "0"), b))


def _phone(key: str, m: Column, invert: bool) -> Column:
    code = F.regexp_extract(m, _CODE, 0)
    shown = F.substr(m, F.length(code) + 1)
    return F.concat(code, _let(_digits(shown), lambda d: _refill(shown, _permuted_digits(key, "phone", d, invert, F.when(code == "", F.lit("+1")).otherwise(code)), "[0-9]")))


def _ip(key: str, m: Column, invert: bool) -> Column:
    def body(o: Column) -> Column:
        octet = lambda k: F.element_at(o, k).cast("long")
        out = feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), F.lit(""), invert)
        return _let(out, lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))))

    return _let(F.split(m, r"\."), body)


def _ssn(key: str, m: Column, invert: bool) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # of 898 areas
    out = feistel(key, "ssn", rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit(""), invert)

    def shaped(s: Column) -> Column:
        place = F.floor(s["l"] / 99)
        number = F.when(place >= 665, place + 2).otherwise(place + 1)
        parts = ((number, 3), (s["l"] % 99 + 1, 2), (s["r"] + 1, 4))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return _let(out, shaped)


_DATE_FORMATS = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}/", "dd/MM/yyyy"))


def _date_in(m: Column, shape: str) -> Column:
    """The date, if it exists in this format."""
    at = {part: shape.index(part) + 1 for part in ("yyyy", "MM", "dd")}
    year, month, day = (F.substring(m, at[part], len(part)).try_cast("int") for part in ("yyyy", "MM", "dd"))
    return F.when((year >= 100) & month.between(1, 12) & day.between(1, 31), F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((year, 4), (month, 2), (day, 2)))).try_cast("date"))


#: Years of a block in which dates are permuted, and the radices for its days of the month up to 12 and after 12:
#: there are 44,249 of the latter in a block (44,248 where both of its century years are common ones), and
#: 250 * 177 = 44,250; the one or two numbers without a day are walked past.
_YEARS, _EARLY, _LATE = 200, (160, 180), (250, 177)


def _moved_day(key: str, d: Column, invert: bool) -> Column:
    """The date that date `d` becomes."""
    first = F.floor((F.year(d) - 1900) / _YEARS) * _YEARS + 1900
    start = F.make_date(first.cast("int"), F.lit(1), F.lit(1))

    def walk(number: Column, radices: tuple[int, int], size: Column, kind: str) -> Column:
        def once(n: Column) -> Column:
            out = feistel(key, kind, F.floor(n / radices[1]), n % radices[1], F.lit(radices[0]), F.lit(radices[1]), first.cast("string"), invert)
            return _let(out, lambda s: s["l"] * radices[1] + s["r"])

        again = lambda n: F.when(n < size, n).otherwise(once(n))
        return _let(_let(once(number), again), again)

    month = (F.year(d) - first) * 12 + F.month(d) - 1
    early = walk(month * 12 + F.dayofmonth(d) - 1, _EARLY, F.lit(_YEARS * 144), "date")
    # days after the 12th, counted from the block's start: all days less 12 for each month begun
    days = F.datediff(F.make_date((first + _YEARS).cast("int"), F.lit(1), F.lit(1)), start)
    late = walk(F.datediff(d, start) - 12 * (month + 1), _LATE, days - _YEARS * 144, "late date")

    def early_day(n: Column) -> Column:
        return F.date_add(F.add_months(start, F.floor(n / 12).cast("int")), (n % 12).cast("int"))

    def late_day(n: Column) -> Column:
        # 18.4 such days a month: the month is within one or two of this guess
        guess = F.floor(n * (_YEARS * 12) / (days - _YEARS * 144))
        before = lambda k: F.datediff(F.add_months(start, k.cast("int")), start) - 12 * k
        found = F.array_max(F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda x: guess + x), lambda k: (k >= 0) & (k < _YEARS * 12) & (before(k) <= n)))
        return _let(found, lambda k: F.date_add(F.add_months(start, k.cast("int")), (12 + n - before(k)).cast("int")))

    return F.when(F.dayofmonth(d) <= 12, _let(early, early_day)).otherwise(_let(late, late_day))


def _date(key: str, m: Column, invert: bool) -> Column:
    """Null if it is no date."""

    def moved(shape: str):
        return lambda d: F.date_format(_moved_day(key, d, invert), shape)

    found = [F.when(m.rlike(rx) & _date_in(m, shape).isNotNull(), _let(_date_in(m, shape), moved(shape))) for rx, shape in _DATE_FORMATS]
    return F.coalesce(*found)


def _email(key: str, m: Column, invert: bool) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substr(m, F.locate("@", m))
    number = lambda s: F.coalesce(F.conv(s, 36, 10).cast("long"), F.lit(0))
    text = lambda x, n: F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), n, F.lit("0"))

    def part(state: Column, p: Column) -> Column:
        """The pseudonym so far, and what keys the next part: the pseudonym of this one."""
        u = F.floor(F.length(p) / 2).cast("int")
        v = F.length(p) - u
        out = feistel(key, "email", number(F.substr(p, F.lit(1), u)), number(F.substr(p, u + 1)), _power(36, u), _power(36, v), F.concat_ws("|", state["before"], F.lower(domain)), invert)
        joined = _let(out, lambda s: F.concat(F.when(u > 0, text(s["l"], u)).otherwise(""), text(s["r"], v)))
        return _let(joined, lambda j: F.struct(F.concat(state["out"], j).alias("out"), (p if invert else j).alias("before")))

    def body(symbols: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(symbols) - 1) / 24).cast("int")), lambda k: F.substr(symbols, k * 24 + 1, F.lit(24)))
        made = F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit("").alias("before")), part, lambda s: s["out"])
        return F.when(F.length(symbols) == 0, F.lit("")).otherwise(made)

    moved = _let(F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", "")), body)
    return F.concat(_refill(local, moved, "[A-Za-z0-9]"), domain)


def finding(m: Column) -> Column:
    """Kind of a match of `FOUND` that validates, else null."""
    octets = F.transform(F.split(m, r"\."), lambda o: o.try_cast("int"))
    digits = _digits(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]"), F.when(_is_iban(m), "iban"))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), F.when(F.coalesce(*(F.when(m.rlike(rx), _date_in(m, shape)) for rx, shape in _DATE_FORMATS)).isNotNull(), "date"))
        .when(m.rlike(r"^[0-9]{13,19}$|^\d{4}([ -])\d{4}\1\d{4}\1\d{4}$|^\d{4}[ -]\d{6}[ -]\d{5}$"), F.when(_luhn_sum(digits) % 10 == 0, "card"))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(F.length(digits).between(7, 18), "phone"))
    )


def _pseudonym(key: str, m: Column, kind: Column, invert: bool) -> Column:
    makers = {"email": _email, "iban": _iban, "card": _card, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date}
    choose = reduce(lambda w, item: w.when(kind == item[0], item[1](key, m, invert)), makers.items(), F.when(kind.isNull(), m))
    return F.coalesce(choose, m)


def session_key(spark: SparkSession) -> str:
    """The configured key, else one that this Spark application draws once."""
    context = spark.sparkContext
    found = spark.conf.get("spark.pairloom.pii.secret", None)
    if not found:
        found = context._pairloom_key = getattr(context, "_pairloom_key", None) or secrets.token_hex(16)
    return found


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str | None = None, into: str = "pii", invert: bool = False) -> DataFrame:
    """`docs` with the findings in column `text` replaced and a column `into`:
    array<struct<kind, pseudonym>> in text order (empty without findings).

    A column of the name `into` is replaced; `invert` turns pseudonyms back.  It finds
    them by the same patterns, so it may err where one that stands against other digits
    validates together with these.
    """
    key = key or session_key(docs.sparkSession)
    body = F.col(text).cast("string")
    held, pattern = fresh(docs.withColumn(into, F.lit(None)), "_found", "_pattern")
    # only those that validate, so that what else stands in such groups is found as before
    grouped = F.when(body.rlike(r"[A-Z]{2}[0-9]{2} [A-Z0-9]{4} "), F.filter(F.regexp_extract_all(body, F.lit(_GROUPED_IBAN), F.lit(1)), _is_iban))
    docs = docs.withColumn(pattern, F.when(F.size(grouped) > 0, F.concat(F.lit(r"(?<!\w)(?:"), F.array_join(grouped, "|"), F.lit(rf")(?!\w)|{FOUND}"))).otherwise(F.lit(FOUND)))
    matches = F.when(body.rlike("[0-9@]"), F.regexp_extract_all(body, F.col(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    judged = F.transform(held, lambda m: F.struct(m.alias("match"), finding(m).alias("kind")))
    made = F.transform(held, lambda f: F.struct(f["kind"].alias("kind"), _pseudonym(key, f["match"], f["kind"], invert).alias("pseudonym")))
    gaps = F.split(body, F.col(pattern), -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(held)), held, lambda g, f: F.concat(g, f["pseudonym"])), ""), F.element_at(gaps, -1))
    out = docs.withColumn(held, F.coalesce(matches, F.array().cast("array<string>"))).withColumn(held, judged).withColumn(held, made)
    out = out.withColumn(text, F.when(F.exists(held, lambda f: f["kind"].isNotNull()), new).otherwise(body))
    return out.withColumn(into, F.filter(held, lambda f: f["kind"].isNotNull())).drop(held, pattern)
