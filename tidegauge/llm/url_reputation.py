"""Url verdicts by rules and, where none fits, by the reputation of the host.

Outcomes of labelled pages are counted by host. A beta-binomial prior shrinks each suffix
towards all pages, each registered domain towards its suffix and each host towards its domain;
the strength of each prior comes from the spread of the shares at its level. A host passes if
the lower bound of its posterior does. DataFrame operations only.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.session import persist_plan

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
WIDTH = 1.28                     # standard deviations from the mean to the bound
LEAST = 0.5                      # bound from which a host passes
STRENGTH = (1.0, 1000.0)         # range of a prior's strength, in pages
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """Host of a url, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """Path of a url; empty without a host."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule, rules=RULES):
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _strength(groups, share):
    """Pages that the prior of a level is worth, by moments of the shares of its groups."""
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    m, pages, squares, spread = groups.where("n > 0").agg(
        F.count("*"), F.sum(n), F.sum(n * n), F.sum(n * F.pow(good / n - F.lit(share), 2))).first()
    noise = share * (1 - share)
    room = (pages or 0.0) - (squares or 0.0) / (pages or 1.0) - ((m or 0) - 1)
    if not m or m < 2 or noise <= 0 or room <= 0:
        return STRENGTH[1]
    extra = (spread - noise * (m - 1)) / (noise * room)
    if extra <= 0:
        return STRENGTH[1]
    return min(max(1.0 / extra - 1.0, STRENGTH[0]), STRENGTH[1])


def host_reputation(hosts):
    """Posterior of every host from ``host``, ``n`` labelled pages and ``good`` ones: mean, bound."""
    parts = F.split("host", r"\.")
    hosts = hosts.withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")) \
                 .withColumn("suffix", F.element_at(parts, -1))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = persist_plan(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    domains = persist_plan(domains)
    n, good = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = (good + 1.0) / (n + 2.0)
    by_suffix, by_domain, by_host = (_strength(g, share) for g in (suffixes, domains, hosts))
    shrunk = lambda prior, strength: (F.col("good") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))     # noqa: E731
    suffixes = suffixes.select("suffix", shrunk(F.lit(share), by_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(F.col("suffix_mean"), by_domain).alias("domain_mean"))
    out = hosts.join(domains, ["suffix", "domain"]).withColumn("mean", shrunk(F.col("domain_mean"), by_host))
    error = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(by_host + 1.0)))
    return out.select("host", "mean", (F.col("mean") - F.lit(WIDTH) * error).alias("bound"))


def judge_pages(pages, rules=RULES):
    """Verdict of every page: page_id, host, path, rule, verdict.

    ``pages`` has ``page_id`` and ``url``; other columns are ignored. Null urls and such without
    ``://`` have an empty host and path. Pages that a rule fits are the labelled outcomes; their
    verdict is the rule's. Repeated rows count each. An empty table gives an empty result.
    """
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    read = read.withColumn("ruled", verdict_of(F.col("rule"), rules))
    hosts = persist_plan(read.groupBy("host").agg(F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good")))
    known = persist_plan(host_reputation(hosts))
    judged = F.when(F.col("bound") >= LEAST, "allow").otherwise("block")
    return read.join(known, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"))
