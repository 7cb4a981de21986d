"""URL filter: path rules, and empirical-Bayes host reputation for what no rule fits (DataFrame functions only).

Labelled outcomes of pages are counted by host, registered domain and suffix.  Each level's beta prior has the mean of the level
above and a concentration fitted by moments of the beta-binomial over that level's groups; a host's posterior is filtered by an
upper bound of its good rate.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Second-level labels under which names are registered in two-letter suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_and_path(url):
    """After the first "://": up to / ? # or the end, A-Z lower-cased; then up to ? # or the end; else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substr(url, at + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(at > 0, host).otherwise(F.lit("")), F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str, str]]):
    """(rule, verdict) columns of the longest fitting rule; rules: (verdict, host, path), a list of bounded length."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found, verdict = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(v)).otherwise(verdict)
    return found, verdict


def suffix_of(host):
    two = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[^.]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host, suffix):
    ahead = F.substr(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix) - F.lit(1), F.lit(0)))
    last = F.regexp_extract(ahead, r"([^.]*)$", 1)
    return F.when(last != "", F.concat(last, F.lit("."), suffix)).otherwise(host)


def _concentration(n, k, mean, low=0.001, high=0.9):
    """Beta concentration from the intra-group correlation, by moments: sum (k - n m)^2 = sum n m (1 - m) (1 + (n - 1) rho)."""
    spread = F.sum(mean * (1 - mean) * n)
    rho = (F.sum((k - n * mean) * (k - n * mean)) - spread) / F.nullif(F.sum(mean * (1 - mean) * n * (n - 1)), F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(low)), F.lit(low)), F.lit(high))
    return (1 - rho) / rho


def host_posteriors(hosts: DataFrame, z: float) -> DataFrame:
    """hosts: host, n (labelled pages), k (good ones), a row for each host.  Adds mean, low and high of the good rate."""
    host = F.col("host")
    rows = hosts.withColumn("suffix", suffix_of(host)).withColumn("domain", domain_of(host, F.col("suffix")))
    domains = rows.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("mean"))

    def level(frame: DataFrame, parent: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
        joined = frame.crossJoin(F.broadcast(parent)) if not on else frame.join(parent, on)
        n, k, m = F.col("n").cast("double"), F.col("k").cast("double"), F.col("mean")
        fit = joined.agg(_concentration(n, k, m).alias("kappa"))  # one row
        a, b = F.col("kappa") * m + k, F.col("kappa") * (1 - m) + n - k
        return joined.crossJoin(F.broadcast(fit)).select(*keep, a.alias("a"), b.alias("b"))

    def mean(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))

    by_suffix = level(suffixes, top, [], ["suffix"])
    by_domain = level(domains, mean(by_suffix, "suffix"), ["suffix"], ["domain", "suffix"])
    by_host = level(rows, mean(by_domain, "domain", "suffix"), ["domain", "suffix"], ["host"])
    total = F.col("a") + F.col("b")
    m = F.col("a") / total
    sd = F.sqrt(m * (1 - m) / (total + 1))
    return by_host.select("host", m.alias("mean"), (m - z * sd).alias("low"), (m + z * sd).alias("high"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], z: float = 1.645, least_good: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    outcomes: url or host, and good (0/1).  Without a rule a page is blocked when the upper posterior bound of its host's good
    rate is below least_good.  Hosts without outcomes stand at their domain's or suffix's posterior, and all of them at the prior
    when there are no outcomes.  A null or odd url has empty host and path (and is judged as the host ""); repeated rows are judged
    alike; other columns are ignored.  The host table joins by Spark's choice at run time, which splits a hot host.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = outcomes.select("host", F.col("good").cast("int").alias("good")) if "host" in outcomes.columns else outcomes.select(host_and_path(F.col("url"))[0].alias("host"), F.col("good").cast("int").alias("good"))
    # a row for each host, summed by partial aggregates; the levels above are read from it again and again
    counted = cut_lineage(parsed.select("host", F.lit(None).cast("int").alias("good")).unionByName(known).groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")))
    judged = host_posteriors(counted, z).select("host", F.when(F.col("high") < least_good, "block").otherwise("allow").alias("by_host"))
    return parsed.join(judged, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict"))
