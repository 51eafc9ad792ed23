"""URL filters: rules on hosts and paths, then reputations of hosts for what no rule decides.

A host's labelled page outcomes are shrunk by empirical Bayes: its beta prior is centred on its registered domain's
posterior mean, that one on its suffix's, that one on the mean of all pages. The strength of each prior is fitted by
the method of moments to how far outcomes spread over the groups of that level. A host is allowed if the lower bound
of its posterior, mean less `z` standard deviations, reaches `least`; a host without labels is judged by its prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels under which names are registered; all others have one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
LEAST, Z = 0.5, 1.0
STRENGTH_RANGE = (2.0, 500.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty if the URL is null or has no ://."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    long = F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES)
    return (
        F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)),
        F.when(long, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1)),
    )


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path taken together; the first of equals), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: the weight of the level's prior in pages, by the method of moments over groups of two pages or more."""
    low, high = STRENGTH_RANGE
    rate = F.col("good") / F.col("seen")
    m, v = F.avg(rate), F.var_samp(rate)
    within = F.avg(rate * (1 - rate) / F.col("seen"))
    spread = F.greatest(v - within, F.lit(1e-9))
    fitted = m * (1 - m) / spread - 1
    return groups.where("seen >= 2").agg(
        F.least(F.greatest(F.coalesce(fitted, F.lit(high)), F.lit(low)), F.lit(high)).alias(f"k_{level}")
    )


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, seen, mean and bound of every host of pages(host, page_id), from outcomes(page_id, good 0 or 1).

    Sums are taken by host first; all later steps work on a row a host or fewer.
    """
    good = outcomes.where(F.col("good").isNotNull() & F.col("page_id").isNotNull())
    good = good.groupBy("page_id").agg(F.max("good").alias("good"))
    hosts = (
        pages.join(good, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"), F.count("good").cast("double").alias("seen"))
    )
    domain, suffix = registered(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = (F.sum("good").alias("good"), F.sum("seen").alias("seen"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    everything = suffixes.agg(((F.sum("good") + 1) / (F.sum("seen") + 2)).alias("top"))
    weights = _strength(hosts, "host").crossJoin(_strength(domains, "domain")).crossJoin(_strength(suffixes, "suffix"))
    weights = weights.crossJoin(everything)  # one row
    mean = lambda k, prior: (F.col("good") + F.col(k) * F.col(prior)) / (F.col("seen") + F.col(k))
    suffixes = suffixes.crossJoin(F.broadcast(weights)).select("suffix", mean("k_suffix", "top").alias("of_suffix"), "k_host", "k_domain")
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", mean("k_domain", "of_suffix").alias("of_domain"), "k_host")
    hosts = hosts.join(domains, ["domain", "suffix"])
    a = F.col("good") + F.col("k_host") * F.col("of_domain")
    b = F.col("seen") - F.col("good") + F.col("k_host") * (1 - F.col("of_domain"))
    return hosts.select("host", "seen", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST, z: float = Z
) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's bound, a row for each row of pages(page_id, url).

    outcomes(page_id, good): labelled pages; repeated labels of a page count once, as good if any is. Null page ids
    have no labels; null or odd URLs have an empty host, which is judged like any other. Without any labels every
    prior is even and nothing reaches a bound above it.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputations(parsed.select("page_id", "host"), outcomes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    bound = F.greatest(F.col("mean") - F.lit(z) * F.col("deviation"), F.lit(0.0))
    by_host = F.when(bound >= least, "allow").otherwise("block")
    return parsed.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round(bound, 6).alias("bound")
    )
