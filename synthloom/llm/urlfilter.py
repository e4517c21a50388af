"""URL filter: exact rules first, then a logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions: parsing, rules, features, gradients and scores. The labelled table is small by
contract (``bound`` rows); what training brings to the driver is one weight per hash bucket and round.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.llm.common import stored

BUCKETS = 8192
GRAMS = (3, 4, 5)
UNIT = 10**9           # gradients are summed as integers of 1 / UNIT, so that their order does not matter
ROUNDS = 60
STEP = 2.0             # over how often a bucket occurs; the scaled features' matrix has a norm of at most root 2
BOUND = 4096           # labelled rows that training takes

PATHS = 4              # urls of each built-in host

# What the built-in labelled table is composed of.
SELLING = ("casino", "cheap", "free", "spam", "best", "win", "hot", "fast", "lucky", "easy", "poker", "bonus", "adult", "ads")
SOLD = ("bets", "pills", "win", "farm", "loans", "slots", "deals", "meds", "track", "x")
PLAIN = ("city", "daily", "open", "north", "river", "green", "old", "public", "world", "garden", "little", "modern")
NAMES = ("library", "news", "museum", "school", "weather", "recipes", "forum", "maps")
SYLLABLES = ("th", "er", "on", "an", "re", "ti", "es", "sh", "ou", "le", "in", "ment", "ung", "que", "ado", "tion")
ENDS = ("com", "net", "org")
LANGUAGES = ("en", "de", "fr", "es")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """A rule from its text, such as ``example.net/en/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    text = F.coalesce(url, F.lit(""))
    found = F.regexp_extract(text, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, r: Rule) -> Column:
    return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest of a short list of rules that fits, or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        found = F.when(fits(host, path, r), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule_table(df: DataFrame, rules: DataFrame, name: str = "_rule") -> DataFrame:
    """As ``longest_rule`` for a table of rules (verdict, host, path) of any size, joined by host suffixes.

    Every distinct host meets the rules of its suffixes once; rows then take their host's rules and choose by path.
    ``df`` has columns host and path.
    """
    hosts = df.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_suffix"))
    order = F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("name"), "path", "verdict")
    of_host = rules.groupBy(F.col("host").alias("_suffix")).agg(F.collect_set(order).alias("_own"))
    known = suffixes.join(of_host, "_suffix").groupBy("host").agg(F.flatten(F.collect_list("_own")).alias("_all"))
    best = F.array_max(F.filter("_all", lambda r: F.col("path").startswith(r["path"])))
    return df.join(known, "host", "left").withColumn(
        name, F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["verdict"].alias("verdict")))).drop("_all")


def features(host: Column, path: Column) -> Column:
    """Buckets (from 1) of all character n-grams of host and path, each marked with where it stands."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)):
        parts += [F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)),
                              lambda g, mark=mark: (F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)) + 1).cast("int"))
                  for n in GRAMS]
    return F.concat(*parts)


def margin(found: Column, bias: float, weights: list[float]) -> Column:
    """Bias and the mean weight of the features, over the root of their number."""
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, f: a + F.element_at(table, f))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def chance(m: Column) -> Column:
    return 1 / (1 + F.exp(-m))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, label): names that sell (1), plain names and plain syllables (0)."""
    def urls(first: tuple, second: tuple, join: str, label: int) -> DataFrame:
        df = spark.range(1).select(F.explode(F.array(*map(F.lit, first))).alias("a"))
        df = df.select("a", F.explode(F.array(*map(F.lit, second))).alias("b"))
        df = df.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(PATHS))).alias("copy"))  # paths of a host say nothing
        h = F.pmod(F.xxhash64("a", "b", "copy"), F.lit(10**6))
        pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(h / by, F.lit(len(values))) + 1).cast("int"))
        return df.select(F.concat(F.lit("https://"), pick(("", "www.", "blog.", "m."), 1), F.concat_ws(join, "a", "b"), F.lit(".example."),
                                  pick(ENDS, 4), F.lit("/"), pick(LANGUAGES, 12), F.lit("/"), h.cast("string")).alias("url"),
                         F.lit(label).alias("label"))
    return (urls(SELLING, SOLD, "-", 1).unionByName(urls(PLAIN[:4], NAMES, "-", 0)).unionByName(urls(PLAIN[4:], NAMES, "", 0))
            .unionByName(urls(SYLLABLES, SYLLABLES, "", 0)))


@dataclass
class UrlModel:
    bias: float
    weights: list[float]

    def score(self, host: Column, path: Column) -> Column:
        return chance(margin(features(host, path), self.bias, self.weights))


def fit_urls(labelled: DataFrame, rounds: int = ROUNDS, decay: float = 0.0005, bound: int = BOUND) -> UrlModel:
    """Logistic regression with an L2 penalty by accelerated full gradients, each one aggregation.

    A bucket's step is over its number of occurrences, so rare n-grams learn as fast as those of every url.
    Rows without a label of 0 or 1 are left out. Of a table above ``bound`` rows those with the smallest hash are taken.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("double").alias("y"), host.alias("host"), path.alias("path"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(bound).select("y", features(F.col("host"), F.col("path")).alias("f"))
    rows = stored(rows, "labelled-urls")
    n = rows.count()
    if n == 0:
        return UrlModel(0.0, [0.0] * BUCKETS)
    every = rows.select(F.explode(F.concat("f", F.array(F.lit(BUCKETS + 1)))).alias("b"))
    often = {r["b"]: r["n"] for r in every.groupBy("b").agg(F.count("*").alias("n")).collect()}
    at = ahead = [0.0] * (BUCKETS + 1)  # the last one is the bias
    speed = 1.0
    for _ in range(rounds):
        off = chance(margin(F.col("f"), ahead[-1], ahead[:-1])) - F.col("y")
        each = rows.select(F.explode(F.concat("f", F.array(F.lit(BUCKETS + 1)))).alias("b"), off.alias("off"),
                           F.sqrt(F.greatest(F.size("f"), F.lit(1))).alias("root"))
        part = F.when(F.col("b") > BUCKETS, F.col("off")).otherwise(F.col("off") / F.col("root"))
        sums = each.groupBy("b").agg(F.sum(F.round(part * UNIT).cast("long")).alias("g")).collect()
        new = [w * (1 - STEP * decay) for w in ahead[:-1]] + [ahead[-1]]
        for r in sums:
            new[r["b"] - 1] -= STEP * r["g"] / UNIT / often[r["b"]]
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead = [b + (speed - 1) / faster * (b - a) for a, b in zip(at, new)]
        at, speed = new, faster
    return UrlModel(at[-1], at[:-1])


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), score (chance of block).

    The longest rule that fits decides; without one the model does. A null url or one without ``://`` has an empty
    host and path, fits no rule and gets the model's verdict on nothing (its bias). Null ids and repeated rows are kept;
    other columns are not looked at. Rows are judged one by one, without a shuffle.
    """
    model = fit_urls(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "score", model.score(F.col("host"), F.col("path")))
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.name").alias("rule"),
                         F.coalesce("_rule.verdict", own).alias("verdict"), "score")
