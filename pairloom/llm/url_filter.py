"""URL filtering by association rules over URL tokens, in DataFrame operations only.

Tokens are the words (letters, at least `MIN_LETTERS`) of the host's labels and
of the path; web prefixes, the last host label and file endings say nothing and
are left out.  Labelled URLs are those whose page `labels` marks: bad for quality 0
or toxic 1, good otherwise; besides, a URL with a seed word is bad.  FP-growth over
their tokens together with their labels finds the combinations.  A rule that
concludes "bad" stays if its confidence reaches `min_confidence` and at least
`MIN_COUNT` labelled URLs bear it out (fewer agree by chance); a rule that concludes
"seed" needs its confidence alone.  Both need `min_support`, and a rule goes when
another on a part of its tokens stays.  Rules match by an inverted index: each distinct
set of tokens is joined on its tokens with the rules' tokens, and a rule fires when all
of its tokens were met.

Listed (host, path) rules are stronger: a rule fits its host and all subdomains
when the URL's path starts with the rule's; the longest wins, of equally long ones
the first by name.

Defined results: a null URL or one without `://` has an empty host and path, fits
no listed rule and is allowed; URLs of any length are read whole; repeated rows each
come out; labels of a null id, and null labels, say nothing, and of several labels of
one page a bad one counts; without bad URLs there are no mined rules; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Labelled URLs that a rule from `labels` needs at least.
MIN_COUNT = 8
#: Firing token sets are broadcast up to this many (some 100 bytes each), else shuffled.
BROADCAST_SETS = 100_000

#: Seed words that label a URL as bad, tokens that carry no meaning.
SEED_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
PLAIN_TOKENS = ("www", "blog", "html", "htm", "php", "index")
MIN_LETTERS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host_: Column, path_: Column) -> Column:
    """Sorted distinct tokens of a host and path."""
    labels = F.split(host_, r"\.")
    words = F.concat(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), F.split(F.lower(path_), "/"))
    parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(r"(\p{L}+)"), F.lit(1))))
    plain = F.array(*map(F.lit, PLAIN_TOKENS))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= MIN_LETTERS) & ~F.array_contains(plain, t))))


def listed_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest listed rule `host/path` that fits, else null."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fit = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def mined_rules(labelled: DataFrame, *, min_support: float = 0.0005, min_confidence: float = 0.8, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule long, items array<string>) from (tokens array<string>, bad boolean, seed boolean)."""
    bad, good, seed = "label=bad", "label=good", "label=seed"
    spark = labelled.sparkSession
    known = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("bad")).first()
    if not known["bad"]:
        return spark.createDataFrame([], "rule long, items array<string>")
    marks = F.concat(F.array(F.when(F.col("bad"), bad).otherwise(good)), F.when(F.col("seed"), F.array(F.lit(seed))).otherwise(F.array().cast("array<string>")))
    baskets = labelled.select(F.concat("tokens", marks).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    concluded = F.col("consequent")[0]
    borne_out = (concluded == seed) | (concluded == bad) & (F.col("support") * known["n"] > min_count - 0.5)
    rules = model.associationRules.where(borne_out).where(~F.arrays_overlap("antecedent", F.array(F.lit(bad), F.lit(good), F.lit(seed))))
    rules = stash(rules.select(F.array_sort("antecedent").alias("items")).distinct().withColumn("rule", F.xxhash64("items")), "rules")
    # a rule is not needed when one on some of its tokens fires already
    single = F.explode("items").alias("token")
    parts = rules.select(F.col("rule").alias("part"), F.size("items").alias("need"), single)
    inside = rules.select("rule", F.size("items").alias("own"), single).join(parts, "token").where("part <> rule and need < own")
    wider = inside.groupBy("rule", "part", "need").count().where("count = need").select("rule").distinct()
    return rules.join(wider, "rule", "left_anti").select("rule", "items")


def fired(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct `tokens` arrays for which some mined rule has all its tokens."""
    index = rules.select("rule", F.size("items").alias("need"), F.explode("items").alias("token"))
    sets = token_sets.select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.groupBy("tokens", "rule", "need").count().where("count = need").select("tokens").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), *, url: str = "url", page_id: str = "page_id", label_id: str = "doc_id", **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`; `mining` goes to `mined_rules`."""
    parsed = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    parsed = parsed.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    seeds = F.array(*map(F.lit, SEED_WORDS))
    judged = labels.where(F.col(label_id).isNotNull()).select(F.col(label_id).alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = judged.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("marked"))
    seeded = parsed.withColumn("seed", F.arrays_overlap("tokens", seeds))
    labelled = seeded.join(judged, "page_id", "left").where("seed or marked is not null").select("tokens", (F.col("seed") | F.coalesce("marked", F.lit(False))).alias("bad"), "seed")
    hits = stash(fired(parsed, mined_rules(stash(labelled, "labelled"), **mining)), "fired").withColumn("hit", F.lit(True))
    listed = listed_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(F.broadcast(hits) if hits.count() <= BROADCAST_SETS else hits, "tokens", "left").withColumn("listed", listed)
    own = F.when(F.col("hit"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", own).alias("verdict"))
