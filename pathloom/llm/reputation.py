"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or good) are counted by host, registered domain and
suffix. A beta-binomial prior runs down that chain: the suffix is shrunk to all
outcomes, the domain to its suffix, the host to its domain, each with a
strength that the spread of the level's own rates gives (method of moments). A
page is blocked where the posterior's lower bound of its host's bad rate is
above a limit, so a few outcomes never condemn a host on their own.

Outcomes come from the rules that fit a page (a blocked page is a bad outcome)
and, where given, from a table of labels. All counts are map-side combined
aggregations; the chain is joined by equi-joins of a row a host, so a host with
a third of all pages is one row by then. No Python on the data path.

Defined results: a null url, or one without ``://``, has empty host and path;
such pages fit no rule and are judged by the outcomes of all pages. Without any
outcome the prior is even and pages are allowed. Repeated rows each keep a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import cut

#: Host, path prefix and verdict of each rule. Fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

LIMIT = 0.5
WIDTH = 1.645  # of the one-sided 95 % bound, in standard deviations
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; from there to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER_CASE), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path`` and its verdict; null where none fits. Of equal lengths the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last two labels and the last one; an address of digits is its own domain."""
    address = host.rlike(r"^[0-9.]+(:[0-9]+)?$|^\[")
    plain = F.regexp_replace(host, r":[0-9]+$|\.+$", "")
    return F.when(address, host).otherwise(F.substring_index(plain, ".", -2)), F.when(address, F.lit("")).otherwise(F.substring_index(plain, ".", -1))


def _strength(counts: DataFrame) -> float:
    """The prior's weight in outcomes: mean * (1 - mean) / variance - 1 of the rates, within 1 and 1000."""
    rates = counts.select((F.col("bad") / F.col("n")).alias("rate"), "n", "prior")
    got = rates.agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"), F.avg(F.expr("1D / n")).alias("noise")).first()
    if got["m"] is None:
        return 2.0
    spread = got["m"] * (1 - got["m"])
    beyond = (got["v"] or 0.0) - spread * got["noise"]  # what binomial noise leaves
    return min(1000.0, max(1.0, spread / beyond - 1)) if beyond > 1e-9 else 1000.0


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """From (host, bad): posterior (a, b) by host, by domain and by suffix, and the bad rate of all."""
    domain, suffix = levels(F.col("host"))
    by_host = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).withColumns({"domain": domain, "suffix": suffix})
    by_host = cut(by_host)
    total = by_host.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total["bad"] + 1) / (total["n"] + 2) if total["n"] else 0.5

    def posterior(counts: DataFrame, key: str) -> DataFrame:
        weight = _strength(counts)
        a = F.col("bad") + weight * F.col("prior")
        b = F.col("n") - F.col("bad") + weight * (1 - F.col("prior"))
        return counts.select(key, *(c for c in ("domain", "suffix") if c in counts.columns and c != key), a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))

    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = posterior(by_host.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(mean)), "suffix")
    domains = by_host.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = posterior(domains, "domain")
    hosts = posterior(by_host.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "host")
    return hosts, domains, suffixes, mean


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, outcomes: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """Per page its id, ``host``, ``path``, ``rule``, ``verdict`` and ``bad_rate``, the bound that the method compares.

    ``outcomes`` (host, bad) adds labels to those that the rules give.
    """
    own = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    own = own.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    own = own.withColumns({"rule": rule, "ruled": verdict})
    seen = own.where("ruled is not null").select("host", (F.col("ruled") == "block").alias("bad"))
    if outcomes is not None:
        seen = seen.unionByName(outcomes.select("host", F.col("bad").cast("boolean")))
    hosts, domains, suffixes, mean = reputation(seen)

    # One row a host of the pages: its own posterior, or else its domain's, its suffix's, or that of all.
    domain, suffix = levels(F.col("host"))
    known = own.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    named = known.join(hosts.select("host", F.struct("a", "b").alias("h")), "host", "left").join(domains.select("domain", F.struct("a", "b").alias("d")), "domain", "left").join(suffixes.select("suffix", F.struct("a", "b").alias("s")), "suffix", "left")
    best = named.select("host", F.coalesce("h", "d", "s", F.struct(F.lit(2 * mean).alias("a"), F.lit(2 * (1 - mean)).alias("b"))).alias("p"))
    m = F.col("p.a") / (F.col("p.a") + F.col("p.b"))
    sd = F.sqrt(m * (1 - m) / (F.col("p.a") + F.col("p.b") + 1))
    best = best.select("host", F.greatest(F.lit(0.0), m - WIDTH * sd).alias("bad_rate"))
    judged = own.join(best, "host", "left")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad_rate") > limit, "block").otherwise("allow")).alias("verdict"), "bad_rate")
