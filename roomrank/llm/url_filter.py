"""3. URL filters: rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted per host. Three beta-binomial priors are chained: the suffix is
shrunk towards the overall rate, the registered domain towards its suffix's posterior mean and the
host towards its domain's. The strength of each prior (its pseudo-count) is estimated from the
spread of the rates at that level by the method of moments, and is never more than the count its own
mean rests on, so few labels never block a host. A page without a rule is blocked when the lower
posterior bound of its host's bad rate is above a threshold; a host without labels is judged by its domain.

A null url or one without `://` has empty host and path, fits no rule, and shares the reputation of
the other such pages. Empty label tables allow every page without a rule. Repeated pages and labels
count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrank.llm.shared import only

THRESHOLD = 0.5
Z = 1.645
STRENGTH = (1.0, 10000.0)
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]  # fixed values: labels that make a suffix with a two-letter last label

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    after = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(lower_ascii(after), F.lit(""))


def after_scheme(url: Column) -> Column:
    """What follows the first `://`, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def path_of(url: Column) -> Column:
    rest = after_scheme(url)
    raw_host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substring(rest, F.length(raw_host) + 1, F.length(rest))
    return F.coalesce(F.substring_index(F.substring_index(tail, "?", 1), "#", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label, or the last two where the last has two letters and the one before is a usual second level."""
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when((F.length(last) == 2) & F.substring_index(two, ".", 1).isin(SECOND_LEVEL) & (two != last), two).otherwise(last)


def domain_of(host: Column) -> Column:
    """The suffix and one label more, or the host where it has no more labels."""
    suffix = suffix_of(host)
    return F.when(F.instr(suffix, ".") > 0, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null without one); of fitting rules of equal length the last given."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])) :
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame, mean: str) -> Column:
    """Pseudo-count of the prior over units with counts n, bad around their parent's mean; one aggregate row."""
    m, n = F.col(mean), F.col("n")
    within = F.sum(m * (1 - m))
    # E[(bad - n m)^2 / n] = m (1 - m) (1 + (n - 1) / (strength + 1)) under the beta-binomial
    spread = F.sum(F.pow(F.col("bad") - n * m, 2) / n)
    over = (spread - within) / F.nullif(F.sum(m * (1 - m) * (n - 1)), F.lit(0.0))
    return F.least(F.greatest(F.coalesce(1 / F.nullif(F.greatest(over, F.lit(0.0)), F.lit(0.0)) - 1, F.lit(STRENGTH[1])),
                              F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def _shrunk(units: DataFrame, mean: str, out: str, strength: float) -> DataFrame:
    """Posterior mean and its count. A prior is worth no more than what its own mean rests on (mean_n)."""
    prior = 1 / (1 / F.lit(strength) + 1 / F.col(mean + "_n"))
    return (units.withColumn(out + "_n", F.col("n") + prior)
            .withColumn(out, (F.col("bad") + prior * F.col(mean)) / F.col(out + "_n")))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host of every page) and (page_id, bad 0/1) -> host, n, bad, rate (posterior mean), bound (lower posterior bound).

    One row per host of pages. The estimated strengths are one number per level, read to the driver.
    """
    labelled = (pages.select("page_id", "host").join(outcomes, "page_id", "left")
                .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
                .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    hosts = labelled
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    overall = (all_["bad"] + 0.5) / (all_["n"] + 1)

    def fitted(units: DataFrame, mean: str) -> float:
        k = units.where("n > 0").agg(_strength(units, mean).alias("k")).first()["k"]
        return STRENGTH[1] if k is None else float(k)

    suffixes = suffixes.withColumn("overall", F.lit(overall)).withColumn("overall_n", F.lit(all_["n"] + 1.0))
    suffixes = _shrunk(suffixes, "overall", "suffix_rate", fitted(suffixes, "overall"))
    domains = domains.join(suffixes.select("suffix", "suffix_rate", "suffix_rate_n"), "suffix")
    domains = _shrunk(domains, "suffix_rate", "domain_rate", fitted(domains, "suffix_rate"))
    hosts = hosts.join(domains.select("suffix", "domain", "domain_rate", "domain_rate_n"), ["suffix", "domain"])
    hosts = _shrunk(hosts, "domain_rate", "rate", fitted(hosts, "domain_rate"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("rate_n") + 1))
    return hosts.select("host", "n", "bad", "rate", F.greatest(F.col("rate") - Z * sd, F.lit(0.0)).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD,
                page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_rate, host_bound."""
    parsed = (only(pages, page_id=page_id, url=url)
              .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    rep = reputations(parsed, outcomes).select(F.col("host").alias("h2"), "rate", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (parsed.join(rep, F.col("host") == F.col("h2"), "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    F.round("rate", 6).alias("host_rate"), F.round("bound", 6).alias("host_bound")))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): a labelled page is bad if its quality is 0; rows without a quality label say nothing."""
    return labels.where("quality is not null").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
