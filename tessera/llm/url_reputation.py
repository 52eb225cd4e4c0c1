"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  A host's bad rate is
a beta posterior; its prior comes down from all labels to the suffix, the
registered domain and the host, and each level adds what the level above cannot
tell:

* Labels of one host resemble one another, so for its domain they count as
  n / (1 + (n - 1) * rho) labels, where rho is their correlation; a domain's
  count so for its suffix, a suffix's for the whole.  A level's rho is fitted to
  the spread of rates around those of the others with the same parent, by the
  method of moments, and pulled to a weak ``RHO`` as if ``FEW`` more units had
  shown that: a spread seen on few units does not make a strong prior.
* A unit's own labels are left out of its parent's evidence, so that they count
  once, at the host.
* A child's prior is as doubtful as its parent's rate and the level's spread
  together: the shares of variance that are left multiply.

A url is blocked when the host's posterior bad rate minus ``Z`` standard
deviations is above ``LIMIT``; hosts without enough evidence pass.  One rule
holds for all hosts: without labels of its own a host is judged by its prior.
Fixed rules override the verdict.

Only DataFrame functions are used.  Counts are combined on the map side, so a
host with a third of all pages costs one row per task; the table joined back
to the pages has one row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, lower_ascii, materialise

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Two-label suffixes under which names are registered one label deeper (fixed values).
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za", "co.in")

#: Block when mean - Z standard deviations of the posterior bad rate exceeds LIMIT.
Z, LIMIT = 3.0, 0.5

#: Correlation of a level that shows none, and how many units it counts as; a fitted one stays between the bounds.
RHO, FEW, LEAST, MOST = 1 / 3, 10.0, 0.001, 0.9


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*WIDE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*WIDE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, rule_host, rule_path = rule
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def _with_totals(units: DataFrame, parent: str, n: str, bad: str) -> DataFrame:
    """``units`` with all_n and all_bad, the sums over their ``parent``."""
    sums = units.groupBy(parent).agg(F.sum(n).alias("all_n"), F.sum(bad).alias("all_bad"))
    return units.join(sums, parent)


def _correlation(units: DataFrame, n: str, bad: str) -> float:
    """rho of a level whose units have n, bad, all_n and all_bad: one number reaches the driver.

    A unit's squared distance from the rate m of the others, in units of
    m (1 - m) / n, is 1 + (n - 1) * rho on average.
    """
    others, e = F.col("all_n") - F.col(n), F.col(n)
    m = (F.col("all_bad") - F.col(bad) + 1) / (others + 2)
    off = e * F.pow(F.col(bad) / e - m, 2) / (m * (1 - m)) - 1
    seen = units.where((others > 1e-9) & (e >= 2)).agg(F.sum(F.least(off, e - 1) / e), F.sum((e - 1) / e)).first()
    rho = (FEW * RHO + (seen[0] or 0.0)) / (FEW + (seen[1] or 0.0))
    return min(MOST, max(LEAST, rho))


def _counting(units: DataFrame, n: str, bad: str, rho: float) -> DataFrame:
    """Add e and b: the labels that a unit counts as for its parent, and the bad ones of them."""
    e = F.col(n) / (1 + (F.col(n) - 1) * rho)
    return units.withColumn("e", e).withColumn("b", e * F.col(bad) / F.col(n))


def _posterior(rate: Column, weight: Column, rho: float, n: Column, bad: Column) -> tuple[Column, Column]:
    """Rate and weight of a child from its parent's, the level's correlation and its own evidence."""
    left = weight / (weight + 1) * (1 - rho)
    prior = left / (1 - left)
    return (prior * rate + bad) / (prior + n), prior + n


def reputations(outcomes: DataFrame, z: float = Z, limit: float = LIMIT, hosts_too: DataFrame | None = None) -> DataFrame:
    """One row per labelled host: host, n, bad, rate, bound, blocked.

    ``outcomes`` has ``host`` and ``bad`` (0 or 1); rows with a null in either
    are left out.  Repeated rows count as often as they appear.  An empty table
    gives no rows.  Hosts of ``hosts_too`` (a column ``host``) without labels
    get a row too, with n = 0 and their prior; with no labels at all its rate
    is one half.
    """
    hosts = materialise(outcomes.where("host is not null and bad is not null").groupBy("host")
                        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
                        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    host_rho = _correlation(_with_totals(hosts, "domain", "n", "bad"), "n", "bad")
    domains = materialise(_counting(hosts, "n", "bad", host_rho).groupBy("suffix", "domain")
                          .agg(F.sum("e").alias("domain_n"), F.sum("b").alias("domain_bad")), "domains")
    domain_rho = _correlation(_with_totals(domains, "suffix", "domain_n", "domain_bad"), "domain_n", "domain_bad")
    domains = _counting(domains, "domain_n", "domain_bad", domain_rho).withColumnsRenamed({"e": "domain_e", "b": "domain_b"})
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("domain_e").alias("suffix_n"), F.sum("domain_b").alias("suffix_bad")), "suffixes")
    suffix_rho = _correlation(_with_totals(suffixes.withColumn("all", F.lit(0)), "all", "suffix_n", "suffix_bad"), "suffix_n", "suffix_bad")
    suffixes = _counting(suffixes, "suffix_n", "suffix_bad", suffix_rho).withColumnsRenamed({"e": "suffix_e", "b": "suffix_b"})
    all_n, all_bad = suffixes.agg(F.coalesce(F.sum("suffix_e"), F.lit(0.0)), F.coalesce(F.sum("suffix_b"), F.lit(0.0))).first()

    d = hosts
    if hosts_too is not None:
        others = hosts_too.select("host").where("host <> ''").distinct().join(hosts.select("host"), "host", "left_anti")
        none = F.lit(0).cast("bigint")
        d = d.unionByName(others.select("host", none.alias("n"), none.alias("bad"), domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")))
    d = _counting(d.withColumn("__n", F.greatest("n", F.lit(1))), "__n", "bad", host_rho)
    own, own_bad = F.when(F.col("n") > 0, F.col("e")).otherwise(0.0), F.when(F.col("n") > 0, F.col("b")).otherwise(0.0)
    d = d.join(domains.drop("suffix"), "domain", "left").join(suffixes, "suffix", "left").fillna(0.0)

    def rest(total, part) -> Column:
        return F.greatest((F.lit(total) if isinstance(total, float) else F.col(total)) - part, F.lit(0.0))

    top = rest(all_n, F.col("suffix_e")) + 2
    rate, weight = (rest(all_bad, F.col("suffix_b")) + 1) / top, top
    for name, rho, n, bad in (("suffix", suffix_rho, rest("suffix_n", F.col("domain_e")), rest("suffix_bad", F.col("domain_b"))),
                              ("domain", domain_rho, rest("domain_n", own), rest("domain_bad", own_bad)),
                              ("host", host_rho, F.col("n"), F.col("bad"))):
        d = d.withColumn(f"{name}_rate", rate).withColumn(f"{name}_weight", weight)
        rate, weight = _posterior(F.col(f"{name}_rate"), F.col(f"{name}_weight"), rho, n, bad)
    d = d.withColumn("rate", rate).withColumn("weight", weight)
    d = d.withColumn("bound", F.col("rate") - z * F.sqrt(F.greatest(F.col("rate") * (1 - F.col("rate")), F.lit(0.0)) / (F.col("weight") + 1)))
    return d.select("host", "n", "bad", "rate", "bound", (F.col("bound") > limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules=RULES,
          z: float = Z, limit: float = LIMIT) -> DataFrame:
    """``pages`` plus host, path, rule, blocked_host and verdict.

    A null url or one without ``://`` has an empty host and path, fits no rule
    and is allowed.  A host without labels is judged by its prior.  Every row of
    ``pages`` gives one row; columns of ``pages`` with the new names are replaced.
    """
    d = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "blocked_host") if c not in (url_col,)])
    url = F.col(url_col)
    d = d.withColumn("host", url_host(url)).withColumn("path", url_path(url))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        hit = fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(hit, r[1] + r[2]).otherwise(rule), F.when(hit, r[0]).otherwise(verdict)
    known, flag = fresh(d, "__host"), "blocked_host"
    rep = materialise(reputations(outcomes, z, limit, d).select(F.col("host").alias(known), F.col("blocked").alias(flag)), "reputation")
    d = d.join(rep, F.col("host") == F.col(known), "left").drop(known)
    method = F.when(F.coalesce(F.col(flag), F.lit(False)), "block").otherwise("allow")
    return (d.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method))
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, bad)`` of every labelled page: the label of a page's number, bad when toxic or of low quality.

    Several labels of one page all count; labels with both values null do not.
    """
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    return (pages.select(F.col("page_id").alias("k"), url_host(F.col("url")).alias("host")).where("host <> ''")
            .join(labels.select(F.col("doc_id").alias("k"), bad.cast("int").alias("bad")), "k").select("host", "bad"))
