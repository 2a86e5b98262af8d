"""URL filtering by empirical-Bayes host reputation: beta-binomial priors shrink a host towards its domain, a domain towards its suffix."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package

#: Second labels under which names are registered below a country's two letters (``co.uk``, ``gov.au``, ``or.jp``).
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")

#: (action, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), A_TO_Z, A_TO_Z.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def domain_and_suffix(host: Column, second_level=SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without its user and port.

    The suffix is the last label, or the last two where a country's two letters follow one of ``second_level``; a host
    that is an address of digits is its own domain and suffix. A full suffix list can be given by joining it before.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    long_suffix = name.rlike(rf"(^|\.)({'|'.join(second_level)})\.[a-z]{{2}}$")
    suffix = F.when(long_suffix, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(long_suffix, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    address = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def beta_tail(a: float, b: float, rate: float) -> float:
    """P(X > rate) for X ~ Beta(a, b): the continued fraction of the incomplete beta function, of as many terms as its size needs."""
    if rate <= 0 or rate >= 1:
        return 1.0 if rate <= 0 else 0.0
    upper = rate <= (a + 1) / (a + b + 2)
    p, q, x = (a, b, rate) if upper else (b, a, 1 - rate)
    terms = int(200 + 4 * math.sqrt(a + b))
    k = 1.0
    for m in range(terms, 0, -1):
        k = 1 - (p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1)) / k
        k = 1 + m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)) / k
    k = 1 - (p + q) * x / (p + 1) / k
    part = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p / k
    return min(1.0, max(0.0, 1 - part if upper else part))


def probability_above(a: Column, b: Column, rate: Column) -> Column:
    """Probability that a rate with the posterior Beta(a, b) exceeds ``rate``, in Arrow batches; meant for a row per host."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([beta_tail(*x) for x in zip(a, b, rate)], dtype=float)

    return tail(a, b, rate)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, action); null if none does."""
    fits = []
    for action, rule_host, rule_path in rules:
        hit = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        fits.append(F.when(hit, F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _with_strength(level: DataFrame, parent_mean: str, children: DataFrame, most: float) -> DataFrame:
    """Add ``strength``: pseudo-counts of the beta prior that this level's groups give their children.

    Method of moments: with the children's rates around their group's mean m, the strength is
    m(1-m)/variance - 1, the variance being what binomial noise does not explain.
    """
    return level.join(children, "group", "left").select(
        level["*"],
        F.when(
            (F.col("n_children") >= 2) & (F.col("between") > 0),
            F.least(F.greatest(F.col(parent_mean) * (1 - F.col(parent_mean)) / F.col("between") - 1, F.lit(1.0)), F.lit(most)),
        ).otherwise(F.lit(most)).alias("strength"),
    )


def reputations(outcomes: DataFrame, base_strength: float = 10.0, most_strength: float = 200.0, hosts: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior Beta(a, b) of the bad rate of every labelled host and of every one of ``hosts(host)``: (host, labelled, bad, mean, a, b, overall).

    ``outcomes(host, bad)`` has one row per labelled page, bad 0 or 1. Counts are summed per host first, so that a
    host with most of the pages is one row afterwards. The prior of a suffix is the overall rate with
    ``base_strength``; that of a domain is its suffix's posterior, that of a host its domain's posterior, with a
    strength found from the spread of the children's rates (at most ``most_strength``). A host without labels has its
    prior: its domain's posterior and strength, else its suffix's, else the overall rate with ``base_strength``. Rows
    with a null label or host are ignored. ``suffixes(suffix)`` is a list of public suffixes to go by instead of the rule.
    """
    counted = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).select("host", F.lit(1).alias("n"), F.col("bad").cast("double").alias("s"))
    if hosts is not None:
        counted = counted.unionByName(hosts.where(F.col("host").isNotNull()).select("host", F.lit(0).alias("n"), F.lit(0.0).alias("s")))
    # one row for each host, read by every level
    hosts = materialize(counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    domain, suffix = domain_and_suffix(F.col("host"))
    listed = suffixes
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "s")
    if listed is not None:
        hosts = by_listed_suffix(hosts, listed)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = suffixes.agg((F.sum("s") + 1).alias("s"), (F.sum("n") + 2).alias("n")).select((F.col("s") / F.col("n")).alias("overall"))

    def spread(children: DataFrame, parents: DataFrame, key: str, mean: str) -> DataFrame:
        """Variance between the children's rates beyond binomial noise, weighted by their labels."""
        deviation = (F.col("s") / F.col("n") - F.col(mean)) ** 2 - F.col(mean) * (1 - F.col(mean)) / F.col("n")
        return children.where("n > 0").join(parents.select(key, mean), key).groupBy(F.col(key).alias("group")).agg(
            F.count("*").alias("n_children"), (F.sum(F.col("n") * deviation) / F.sum("n")).alias("between")
        )

    suffixes = suffixes.crossJoin(F.broadcast(overall)).select(  # one row
        "suffix", "n", ((F.col("s") + base_strength * F.col("overall")) / (F.col("n") + base_strength)).alias("suffix_mean")
    )
    suffixes = _with_strength(suffixes.withColumn("group", F.col("suffix")), "suffix_mean", spread(domains, suffixes, "suffix", "suffix_mean"), most_strength)
    # a group without labels has no children to tell its spread: it hands on the strength that it was given
    strength = F.when(F.col("n") > 0, F.col("strength")).otherwise(F.lit(base_strength)).alias("strength")
    domains = domains.join(suffixes.select("suffix", "suffix_mean", strength), "suffix").select(
        "domain", "n", F.col("strength").alias("given"), ((F.col("s") + F.col("strength") * F.col("suffix_mean")) / (F.col("n") + F.col("strength"))).alias("domain_mean")
    )
    domains = _with_strength(domains.withColumn("group", F.col("domain")), "domain_mean", spread(hosts, domains, "domain", "domain_mean"), most_strength)
    strength = F.when(F.col("n") > 0, F.col("strength")).otherwise(F.col("given")).alias("strength")
    hosts = hosts.join(domains.select("domain", "domain_mean", strength), "domain").crossJoin(F.broadcast(overall))  # one row
    total = F.col("n") + F.col("strength")
    mean = (F.col("s") + F.col("strength") * F.col("domain_mean")) / total
    return hosts.select("host", F.col("n").alias("labelled"), F.col("s").alias("bad"), mean.alias("mean"), (mean * total).alias("a"), ((1 - mean) * total).alias("b"), "overall")


def by_listed_suffix(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts(host, domain, suffix, ...)`` with the longest of ``suffixes(suffix)`` that a host ends with, and the domain one label longer; others stay."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    ends = hosts.select("host", name.alias("__name"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("__labels"))
    ends = ends.withColumn("suffix", F.expr("substring_index(__name, '.', -__labels)"))
    found = ends.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max("__labels").alias("__labels"), F.first("__name").alias("__name"))
    found = found.select(F.col("host").alias("__host"), F.expr("substring_index(__name, '.', -__labels)").alias("__suffix"), F.expr("substring_index(__name, '.', -__labels - 1)").alias("__domain"))
    joined = hosts.join(found, hosts["host"] == found["__host"], "left")
    return joined.withColumns({"suffix": F.coalesce("__suffix", "suffix"), "domain": F.coalesce("__domain", "domain")}).drop("__host", "__suffix", "__domain")


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    url_col: str = "url",
    times: float = 1.5,
    confidence: float = 0.95,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Add ``host, path, rule, verdict`` and the host's posterior (``bad_mean, bad_probability``) to every page.

    ``outcomes(host, bad)``: labelled pages. A rule's action wins; else a page is blocked if its host's
    bad rate exceeds ``times`` the rate of all labelled pages with at least the probability ``confidence``
    (``bad_probability``), that is, if the posterior's lower bound does. A host without labels is judged by its prior from its domain,
    suffix or all labels; null and odd urls have no host and are allowed. Existing columns of these names are replaced; all rows are returned, repeated ones too.
    """
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col("__url"))
    taken = {"host", "path", "rule", "verdict", "bad_mean", "bad_probability", "__url"}
    judged = pages.withColumn("__url", F.col(url_col)).withColumns({"__host": host, "__path": path})
    judged = judged.select(*(c for c in pages.columns if c not in taken or c == url_col), F.col("__host").alias("host"), F.col("__path").alias("path"))
    known = reputations(outcomes, hosts=judged.where(F.col("host") != "").select("host"), suffixes=suffixes).select(F.col("host").alias("__known"), F.col("mean").alias("bad_mean"), "a", "b", "overall")
    # written once: the probability is worked out for each host, not for each page
    known = materialize(known.select("__known", "bad_mean", probability_above(F.col("a"), F.col("b"), F.lit(times) * F.col("overall")).alias("bad_probability")), "reputations")
    judged = judged.join(known, F.col("host") == F.col("__known"), "left").drop("__known")
    best = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_probability") >= confidence, "block").otherwise("allow")
    return judged.withColumn("rule", best["rule"]).withColumn("verdict", F.coalesce(best["action"], by_method))
