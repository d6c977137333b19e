"""URL filters: path rules, and host reputation by empirical Bayes from labelled page outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import fits, spread_join, written

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains where the url's path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Second labels that stand before a country code as part of a suffix.
SECOND_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """block_below: hosts are blocked whose whole credible interval for the share of good pages is below it; z: its half width in deviations."""

    block_below: float = 0.8
    z: float = 1.645
    least_correlation: float = 1e-3
    most_correlation: float = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = [(host == h) | host.endswith(f".{h}") for _, h, _ in ranked]
    fits = [f & path.startswith(p) for f, (_, _, p) in zip(fits, ranked, strict=True)]
    return F.coalesce(*(F.when(f, h + p) for f, (_, h, p) in zip(fits, ranked, strict=True))), F.coalesce(*(F.when(f, v) for f, (v, _, _) in zip(fits, ranked, strict=True)))


def domain_columns(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host: the suffix is the last label, or the last two where the second is like 'co' and the last a country code."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    labels = F.split(name, r"\.")
    two = (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LABELS)
    n = F.when(two & (F.size(labels) > 1), 2).otherwise(1)
    return F.concat_ws(".", F.slice(labels, F.greatest(-n - 1, -F.size(labels)), n + 1)), F.concat_ws(".", F.slice(labels, F.greatest(-n, -F.size(labels)), n))


def host_reputation(outcomes: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """host, domain, suffix, rows, labelled, good, mean, deviation, from one row per host: host, domain, suffix, rows, n, k (n labelled pages, k of them good).

    At each level (suffix, registered domain, host) the share of good pages has a beta prior around the mean of the level above.
    Its strength is 1/rho - 1, where rho is the moment estimate of the correlation within the level's groups:
    sum((k - n*mu)^2 - n*mu*(1-mu)) / sum(n*(n-1)*mu*(1-mu)). A host without labels takes its domain's mean, and that its suffix's.
    """
    summed = [F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("size")]

    def level(groups: DataFrame) -> DataFrame:
        """groups: n, k, and the mean mu of the level above; adds mean and strength of the posterior. One row comes to the driver."""
        sums = groups.agg(F.expr("sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu))").alias("over"), F.expr("sum(n * (n - 1D) * mu * (1 - mu))").alias("pairs")).collect()[0]
        rho = sums["over"] / sums["pairs"] if (sums["pairs"] or 0) > 0 else settings.most_correlation
        prior = F.lit(1 / max(settings.least_correlation, min(settings.most_correlation, rho)) - 1)
        return groups.withColumns({"mean": (F.col("mu") * prior + F.col("k")) / (prior + F.col("n")), "strength": prior + F.col("n")})

    def under(groups: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        return spread_join(groups, above.select(*keys, F.col("mean").alias("mu"), F.col("size").alias("below")), keys, "below").drop("below")

    domains = written(outcomes.groupBy("suffix", "domain").agg(*summed), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*summed), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()[0]
    suffixes = level(suffixes.withColumn("mu", F.lit(((total["k"] or 0) + 1) / ((total["n"] or 0) + 2))))
    domains = written(level(under(domains, suffixes, ["suffix"])), "domain-means")
    hosts = level(under(outcomes, domains, ["suffix", "domain"]))
    return hosts.select("host", "domain", "suffix", "rows", F.col("n").alias("labelled"), F.col("k").alias("good"), "mean", F.expr("sqrt(mean * (1 - mean) / (strength + 1))").alias("deviation"))


def judge_urls(pages: DataFrame, labels: DataFrame, settings: Reputation = Reputation(), rules=RULES, hot_share: int = 200) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's mean and upper bound, for every row of pages (page_id, url).

    labels: doc_id (of the page), quality 0 or 1. A null url, or one without '://', has an empty host and path, no rule, and the
    reputation of the empty host. Repeated pages are all returned; several labels of one page all count; null labels do not.
    Further columns are left out; empty labels leave a prior mean of 1/2 with its full width, which blocks nothing.

    Only DataFrame functions. Hosts are summed up before the shuffle. Reputations are broadcast if they are small; otherwise a host
    with over 1/hot_share of all rows is joined by broadcast (there are fewer than hot_share of those), the others by a shuffle.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col("page_id"), "url").withColumns({"host": host, "path": path}).drop("url")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.count("quality").alias("n"), F.sum(F.col("quality").cast("long")).alias("k"))
    by_host = (
        urls.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    )
    domain, suffix = domain_columns(F.col("host"))
    # one row a host, written once: all levels read it
    by_host = written(by_host.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    reputation = host_reputation(by_host, settings).withColumn("upper", F.expr(f"mean + {settings.z}D * deviation")).select("host", "rows", "mean", "upper")
    reputation = written(reputation, "reputation")
    if fits(reputation):
        known = F.broadcast(reputation.withColumnsRenamed({"mean": "hot_mean", "upper": "hot_upper"}))
        judged = urls.join(known, "host", "left").withColumns({"mean": F.col("hot_mean"), "upper": F.col("hot_upper")})
    else:
        total = pages.count()
        hot = reputation.where(F.col("rows") * hot_share > total)
        judged = urls.join(F.broadcast(hot.select("host", F.col("mean").alias("hot_mean"), F.col("upper").alias("hot_upper"))), "host", "left")
        # rows of a hot host have their answer: in the shuffled join they get keys that meet nothing
        key = F.when(F.col("hot_mean").isNull(), F.col("host")).otherwise(F.concat(F.lit("\u0000"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("path")))
        judged = judged.withColumn("key", key).join(reputation.where(F.col("rows") * hot_share <= total).select(F.col("host").alias("key"), "mean", "upper"), "key", "left")
    mean, upper = F.coalesce("hot_mean", "mean"), F.coalesce("hot_upper", "upper")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(upper < settings.block_below, "block").otherwise("allow")).alias("verdict"),
        F.round(mean, 6).alias("good_mean"), F.round(upper, 6).alias("good_upper"),
    )
