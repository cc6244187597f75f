"""URL filtering by empirical-Bayes host reputation, with explicit rules on top.

Labelled page outcomes are shrunk through a chain of beta-binomial priors:
public suffix -> registered domain -> host. Each level's prior is centred on its
parent's posterior mean, and the prior's strength is the method-of-moments
estimate over all groups of that level. A host is blocked when the upper bound
of its posterior for good pages lies under ``min_good``. Everything is DataFrame
code; the counts are aggregated before any join, so a hot host costs one row.

Cases: a null url, or one without ``://``, has an empty host and path and forms
the reputation group of the empty host. Ports and user names stay part of the
host. An empty table gives an empty result. A host without labelled pages gets
its domain's posterior, a domain without any its suffix's, and so on up to the
overall rate; with no label at all the overall rate is ``prior_good``. Repeated
rows are judged one by one. Null outcomes count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import written

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Second-level labels under which registrations are made, as in ``co.uk``.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
URL_PATTERN = r"(?s)://([^/?#]*)([^?#]*)"
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    found = F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit(""))
    return F.translate(found, ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two of a ``co.uk`` kind."""
    labels = F.split(host, r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    two = (F.size(labels) > 2) & second.isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(two, F.concat_ws(".", second, F.element_at(labels, -1))).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more, or the host itself."""
    labels, suffix = F.split(host, r"\."), suffix_of(host)
    take = F.size(F.split(suffix, r"\.")) + 1
    return F.when(F.size(labels) >= take, F.array_join(F.slice(labels, -take, take), ".")).otherwise(host)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none fits.

    ``rules`` holds (verdict, host, path). A rule fits its host and every
    subdomain if the path starts with the rule's path.
    """
    named = sorted(((h + p, v, h, p) for v, h, p in rules), key=lambda r: (-len(r[0]), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, v, h, p in reversed(named):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, n: str, good: str, parent_mean: str) -> DataFrame:
    """One row: the method-of-moments strength of a level's beta prior.

    With group rates p_i, sizes n_i and parent means m_i, the between-group
    variance beyond binomial noise gives strength = m(1-m)/var - 1.
    """
    p = F.col(good) / F.col(n)
    m = F.col(parent_mean)
    noise = m * (1 - m) / F.col(n)
    spread = F.sum(F.col(n) * ((p - m) * (p - m) - noise)) / F.sum(n)
    base = F.sum(F.col(n) * m * (1 - m)) / F.sum(n)
    value = F.when(spread > 0, base / spread - 1).otherwise(F.lit(MAX_STRENGTH))
    return groups.filter(F.col(n) > 0).agg(
        F.coalesce(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), value)), F.lit(MIN_STRENGTH)).alias("strength")
    )


def host_reputation(pages: DataFrame, url: str = "url", outcome: str = "outcome", prior_good: float = 0.5, z: float = 1.645) -> DataFrame:
    """Per host: labelled counts, the shrunken good rate and its posterior bounds.

    ``outcome`` is 1 for a good page, 0 for a bad one, null where unlabelled.
    Returns host, domain, suffix, n, good, posterior, lower, upper.
    """
    host = host_of(F.col(url))
    hosts = (
        pages.select(host.alias("host"), F.col(outcome).cast("double").alias("y"))
        .groupBy("host")
        .agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("good"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    hosts = written(hosts, "hosts")  # a row a host; each level below reads it again
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("good").alias("dgood"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dgood").alias("sgood"))
    total = suffixes.agg(F.sum("sn").alias("tn"), F.sum("sgood").alias("tgood")).select(
        F.when(F.col("tn") > 0, F.col("tgood") / F.col("tn")).otherwise(F.lit(prior_good)).alias("top")
    )
    one_row = F.broadcast  # each of these has exactly one row
    level = suffixes.crossJoin(one_row(total))
    level = level.crossJoin(one_row(_strength(level, "sn", "sgood", "top"))).select(
        "suffix", ((F.col("sgood") + F.col("strength") * F.col("top")) / (F.col("sn") + F.col("strength"))).alias("smean")
    )
    mid = domains.join(written(level, "suffixes"), "suffix")
    mid = mid.crossJoin(one_row(_strength(mid, "dn", "dgood", "smean"))).select(
        "domain", "suffix", ((F.col("dgood") + F.col("strength") * F.col("smean")) / (F.col("dn") + F.col("strength"))).alias("dmean")
    )
    low = hosts.join(written(mid, "domains"), ["domain", "suffix"])
    low = low.crossJoin(one_row(_strength(low, "n", "good", "dmean")))
    alpha = F.col("good") + F.col("strength") * F.col("dmean")
    weight = F.col("n") + F.col("strength")
    mean = alpha / weight
    half = F.lit(z) * F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / (weight + 1))
    return low.select(
        "host", "domain", "suffix", "n", "good", mean.alias("posterior"),
        F.greatest(mean - half, F.lit(0.0)).alias("lower"), F.least(mean + half, F.lit(1.0)).alias("upper"),
    )


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", outcome: str = "outcome",
    min_good: float = 0.8, z: float = 1.645,
) -> DataFrame:
    """Add host, path, rule, verdict, posterior and upper to ``pages``.

    ``labelled`` has the url and outcome columns that the reputation is learned
    from. The rule's verdict wins; else a host whose upper posterior bound is
    under ``min_good`` is blocked.
    """
    reputation = host_reputation(labelled, url, outcome, z=z).select(
        F.col("host").alias("_host"), F.col("posterior").alias("_posterior"), F.col("upper").alias("_upper")
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "posterior", "upper")]
    seen = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("_upper") < F.lit(min_good), F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(reputation, seen["host"] == reputation["_host"], "left").select(
        *kept, "host", "path", rule.alias("rule"), F.coalesce(ruled, learned).alias("verdict"),
        F.round("_posterior", 6).alias("posterior"), F.round("_upper", 6).alias("upper"),
    )
