"""Empirical-Bayes host reputation over labelled pages.

Labelled page outcomes (good or bad) are counted by host, registered domain
and suffix. Each level is a beta-binomial whose prior is the posterior of the
level above: the suffix shrinks to the overall rate, the domain to its suffix,
the host to its domain. A level's prior strength comes from the data by the
method of moments (how much more its members differ than chance allows). A
host is blocked when the lower bound of its posterior rate of bad pages
exceeds the threshold.

All of it is DataFrame code. Pages are reduced to one row a host before any
other level is built, and only ids and urls take part, never page bodies; a
host with a third of all pages is combined before the shuffle, and joined back
from a table with one row a host, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)

#: Bounds of the prior strength of a level, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 0.01, 1000.0
OVERALL_GOOD, OVERALL_BAD = 1.0, 1.0
UPPER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_RULES = 10_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER_CASE, UPPER_CASE.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two if they are a known suffix; a port is no part of it."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it, or the whole name if there is none."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    front = F.expr("substring(name, 1, length(name) - length(suffix) - 1)")
    label = F.regexp_extract(F.when(F.length(name) > F.length(suffix), front).otherwise(""), r"([^.]*)$", 1)
    return F.when(F.length(name) > F.length(suffix), F.concat(label, F.lit("."), suffix)).otherwise(name)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict), or null.

    A rule fits its host and all subdomains when the path starts with its path.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fit = F.when(here, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _strength(level: DataFrame) -> DataFrame:
    """One row: the prior strength of a level whose rows have good, bad and the
    expected bad rate ``mu``. With rate x/n and intra-class correlation r the
    expected sum of n (x/n - mu)^2 is sum mu (1 - mu) (1 + (n - 1) r)."""
    n = F.col("good") + F.col("bad")
    spread = F.col("mu") * (1 - F.col("mu"))
    sums = level.where(n > 0).agg(
        F.sum((F.col("bad") - n * F.col("mu")) ** 2 / n).alias("s"), F.sum(spread).alias("a"),
        F.sum(spread * (n - 1)).alias("b"))
    r = F.when(F.col("b") > 0, (F.col("s") - F.col("a")) / F.col("b")).otherwise(0.0)
    r = F.greatest(F.least(r, F.lit(1 / (1 + LEAST_STRENGTH))), F.lit(1 / (1 + MOST_STRENGTH)))
    return sums.select(F.coalesce((1 - r) / r, F.lit(MOST_STRENGTH)).alias("strength"))


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds the posterior mean bad rate and its weight to (good, bad, mu)."""
    with_strength = level.crossJoin(F.broadcast(_strength(level)))  # one row
    weight = F.col("strength") + F.col("good") + F.col("bad")
    return (with_strength.withColumn("rate", (F.col("mu") * F.col("strength") + F.col("bad")) / weight)
            .withColumn("weight", weight).drop("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, good, bad, rate, weight) for every host of
    ``outcomes`` (host string, good long, bad long): rate is the posterior mean
    of the bad rate, weight its sample size, prior included. Hosts may come
    in any number of rows; a host without labelled pages has zeros."""
    hosts = (outcomes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
             .withColumn("suffix", suffix_of(F.col("host")))
             .withColumn("name", F.regexp_replace("host", r":[0-9]*$", "")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))).drop("name")
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + OVERALL_BAD)
                            / (F.coalesce(F.sum(F.col("good") + F.col("bad")), F.lit(0)) + OVERALL_GOOD + OVERALL_BAD)).alias("mu"))
    top = _shrunk(suffixes.crossJoin(F.broadcast(overall)))  # one row
    middle = _shrunk(domains.join(top.select("suffix", F.col("rate").alias("mu")), "suffix"))
    return _shrunk(hosts.join(middle.select("domain", "suffix", F.col("rate").alias("mu")), ["domain", "suffix"])).drop("mu")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], outcomes: DataFrame | None = None,
               id_col: str = "page_id", url_col: str = "url", z: float = 1.6448536269514722,
               threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, bad_rate, labelled), one row per row of ``pages``.

    verdict is the longest fitting rule's; without one, ``block`` if the
    host's posterior bad rate minus ``z`` standard deviations exceeds
    ``threshold``, else ``allow``. Labelled outcomes are ``outcomes`` (host,
    good, bad) or, without them, the pages that a rule fits: good if it allows
    them, bad if it blocks them. bad_rate (6 digits) is the host's posterior
    mean, labelled its number of labelled pages.

    A null url or one without ``://`` has an empty host and path; such pages
    share the empty host. Null ids and repeated rows are kept as they are; an
    empty table gives an empty result; other columns are ignored.
    """
    prepare(pages.sparkSession)
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    own = seen.select("host", (F.col("fit.verdict") == "allow").cast("long").alias("good"),
                      (F.col("fit.verdict") == "block").cast("long").alias("bad"))
    if outcomes is not None:
        own = (own.select("host", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))
               .union(outcomes.select("host", F.col("good").cast("long"), F.col("bad").cast("long"))))
    known = host_reputation(own.select("host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")))
    bound = F.col("rate") - F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    judged = known.select("host", F.when(bound > threshold, "block").otherwise("allow").alias("own_verdict"),
                          F.round("rate", 6).alias("bad_rate"), (F.col("good") + F.col("bad")).alias("labelled"))
    return seen.join(judged, "host").select(
        F.col("page").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "own_verdict").alias("verdict"), "bad_rate", "labelled")
