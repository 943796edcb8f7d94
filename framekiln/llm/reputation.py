"""URL filters by host reputation, in DataFrame functions only.

Outcomes of labelled pages are counted per host, registered domain and suffix (each host once, from
counts that were combined before the shuffle). From the top down, a node's bad outcomes are beta-binomial with
its parent's posterior mean ``m`` as prior mean. With ``s`` the prior's weight, in outcomes,

    bad rate of the node ~ Beta(s * m + bad, s * (1 - m) + good)

Here ``m`` leaves the node's own outcomes out of its parent's, so that none counts twice.
``s = 1 / rho - 1`` is fitted per level from the data by moments: the squared deviations
``(bad - n m)^2`` exceed their binomial expectation ``n m (1 - m)`` by the factor ``1 + (n - 1) rho`` (where no node has two outcomes, ``s`` is 1). The first mean
is the rate of all outcomes, with one good and one bad outcome added. A host without outcomes has its domain's posterior as prior and posterior,
a domain without outcomes its suffix's, a suffix without outcomes that of the whole. A page is blocked if the lower posterior bound
(mean less ``z`` deviations) of its host is above ``limit``: a few bad pages of a host that is little known
aren't enough. A rule that fits a url goes before the method.

The registered domain is the public suffix and one label more; a suffix is the last label, or one of ``suffixes``
(``co.uk``). A port and a user name do not count for domains; an address in numbers is its own domain.

Joins on hosts and domains take the keys that hold over 1 / ``SHARES`` of the rows apart: there are fewer than
``SHARES`` of them, whatever the data, so their side is broadcast and their rows are not shuffled.

Cases: null urls, and urls without ``://``, have an empty host and path, and that empty host is judged as any other;
a null ``page_id`` has no outcome but a verdict; repeated pages each count and each get a row; an outcome that is null
counts as none; if labels of one page differ, the bad one counts. Without outcomes all pages are allowed but for the rules.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekiln.session import written

# (host, path, verdict) of each rule; the longest that fits a url counts.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LIMIT = 0.5
Z = 1.645
SHARES = 1000
# Bounds of rho: a prior weighs between 1 and 999 outcomes.
LEAST_RHO, MOST_RHO = 0.001, 0.5


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column, suffixes: list[str] | None = None) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; ``suffixes`` has public suffixes of several labels."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    numeric = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    suffix = F.substring_index(bare, ".", -1)
    domain = F.substring_index(bare, ".", -2)
    for long in sorted(suffixes or [], key=lambda s: s.count(".")):
        fits = (bare == long) | bare.endswith(f".{long}")
        suffix = F.when(fits, F.lit(long)).otherwise(suffix)
        domain = F.when(fits, F.substring_index(bare, ".", -2 - long.count("."))).otherwise(domain)
    return F.when(numeric, bare).otherwise(domain), F.when(numeric, F.lit("")).otherwise(suffix)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def first_fit(values: list[str]) -> Column:
        cases = [
            F.when(((host == on) | host.endswith(f".{on}")) & path.startswith(begin), F.lit(value))
            for (on, begin, _), value in zip(ordered, values)
        ]
        return F.coalesce(*cases, F.lit(None).cast("string"))

    return first_fit([on + begin for on, begin, _ in ordered]), first_fit([verdict for *_, verdict in ordered])


def spread_join(rows: DataFrame, named: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``named`` (one row per key), in which no key makes a large task.

    ``sizes`` has (key, rows). Keys with over 1 / ``SHARES`` of all rows, fewer than ``SHARES``, are
    broadcast; the others are left to Spark.
    """
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    hot = written(sizes.filter(F.col("rows") * SHARES > total).select(key), "reputation-hot")
    few = F.broadcast(hot.join(named, key, "left").withColumn("__few", F.lit(True)))
    apart = rows.join(few, key).select(*rows.columns, *[c for c in named.columns if c != key])
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(named, key, "left")
    return apart.unionByName(rest.select(*apart.columns))


def _level(nodes: DataFrame, above: DataFrame, name: str, parent: str) -> DataFrame:
    """``nodes`` with m, weight: the prior's mean, which is the parent's posterior mean without the node's own outcomes."""
    sizes = nodes.groupBy(parent).agg(F.count(F.lit(1)).alias("rows"))
    above = above.select(parent, F.expr("weight * m + bad").alias("bad_above"), F.expr("weight + n").alias("n_above"))
    placed = spread_join(nodes, above, parent, sizes).withColumn("m", F.expr("(bad_above - bad) / (n_above - n)"))
    placed = written(placed.drop("bad_above", "n_above"), f"reputation-{name}")
    over = F.expr("sum(pow(bad - n * m, 2) - n * m * (1 - m))")
    rho = placed.agg(over / F.expr("nullif(sum(n * (n - 1) * m * (1 - m)), 0D)")).first()[0]
    rho = MOST_RHO if rho is None else min(max(rho, LEAST_RHO), MOST_RHO)
    return placed.withColumn("weight", F.lit(1 / rho - 1))


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """(host, pages, n, bad, mean, variance) of every host of ``pages`` (page_id, host).

    ``outcomes`` has (page_id, bad), bad being a boolean.
    """
    judged = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.join(judged, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    domain, suffix = domains_of(F.col("host"), suffixes)
    hosts = hosts.join(seen, "host", "left").fillna(0, ["n", "bad"]).withColumns({"domain": domain, "suffix": suffix})
    hosts = written(hosts, "reputation-hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    by_domain = written(hosts.groupBy("domain", "suffix").agg(*counts), "reputation-domains")
    by_suffix = by_domain.groupBy("suffix").agg(*counts).withColumn("whole", F.lit(""))
    # One good and one bad outcome, and all others.
    whole = by_domain.agg(*counts).fillna(0).withColumns({"whole": F.lit(""), "m": F.lit(0.5), "weight": F.lit(2.0)})
    suffix_level = _level(by_suffix, whole, "suffixes", "whole")
    domain_level = _level(by_domain, suffix_level, "domains", "suffix")
    mean = F.expr("(weight * m + bad) / (weight + n)")
    known = _level(hosts, domain_level, "of-hosts", "domain").withColumn("mean", mean)
    return known.select("host", "pages", "n", "bad", "mean", F.expr("mean * (1 - mean) / (weight + n + 1)").alias("variance"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    limit: float = LIMIT,
    z: float = Z,
    suffixes: list[str] | None = None,
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict and the host's n_labelled, n_bad, bound."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = reputations(rows.select("page_id", "host"), outcomes, suffixes)
    bound = F.col("mean") - z * F.sqrt("variance")
    hosts = hosts.select("host", "pages", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), bound.alias("bound"))
    hosts = written(hosts, "reputation-of-hosts")
    known = spread_join(rows, hosts.drop("pages"), "host", hosts.select("host", F.col("pages").alias("rows")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return known.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "n_bad", "bound")
