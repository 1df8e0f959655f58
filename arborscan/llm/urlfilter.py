"""URL verdicts: rules by host and path, else the host's reputation by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD, Z, STRONGEST = 0.5, 1.645, 10_000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first: ``a.b.c`` gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registered(host: Column) -> Column:
    """The registered domain: the last two labels (the host itself if it has fewer)."""
    return F.substring_index(host, ".", -2)


def _levels(judged: DataFrame) -> DataFrame:
    """One row of (n, bad, mean, strength) sums for groups with (n, bad): the moments of a beta-binomial.

    The variance between groups is the weighted variance of their rates less what drawing alone
    would give; the prior's strength is the number of outcomes that variance is worth, between 1
    and ``STRONGEST`` (no variance left: the strongest).
    """
    n, bad = F.sum("n").cast("double"), F.sum("bad").cast("double")
    sums = judged.agg(n.alias("n"), bad.alias("bad"), F.count("*").cast("double").alias("k"),
                      F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"))
    mean = F.col("bad") / F.col("n")
    drawn = mean * (1 - mean)
    between = (F.col("sq") / F.col("n") - mean * mean) - drawn * F.col("k") / F.col("n")
    strength = F.when(between <= 0, STRONGEST).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(STRONGEST), drawn / between - 1)))
    return sums.select(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(strength, F.lit(STRONGEST)).alias("strength"))


def reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, a, b): the posterior beta of each host's share of bad pages.

    ``outcomes`` has (host, bad boolean) per labelled page; rows with a null bad are unlabelled.
    Rates shrink top-down: all pages, suffix (last label), registered domain, host, each the prior
    mean of the next with a strength estimated at its own level. A host without outcomes has its
    domain's prior. Outcomes are summed per host before anything else is done with them.
    """
    per_host = (outcomes.where("bad IS NOT NULL").groupBy("host")
                .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    keyed = per_host.withColumns({"domain": registered(F.col("host")), "suffix": F.substring_index("host", ".", -1)})
    per_domain = keyed.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole, by_suffix, by_domain, by_host = (
        _levels(x).select(F.struct("mean", "strength").alias("level")) for x in (per_suffix, per_suffix, per_domain, per_host))
    m0, m1, m2, m3 = (x.scalar() for x in (whole, by_suffix, by_domain, by_host))

    def shrunk(n: str, bad: str, prior: Column, strength: Column) -> Column:
        return (F.coalesce(bad, F.lit(0)) + strength * prior) / (F.coalesce(n, F.lit(0)) + strength)

    def renamed(df: DataFrame, key: list[str], tag: str) -> DataFrame:
        return df.select(*key, F.col("n").alias(f"n_{tag}"), F.col("bad").alias(f"bad_{tag}"))

    known = hosts.select("host").distinct().withColumns(
        {"domain": registered(F.col("host")), "suffix": F.substring_index("host", ".", -1)})
    joined = (known.join(renamed(per_suffix, ["suffix"], "s"), "suffix", "left")
              .join(renamed(per_domain, ["domain"], "d"), "domain", "left").join(renamed(per_host, ["host"], "h"), "host", "left"))
    top = joined.withColumns({"l0": m0, "l1": m1, "l2": m2, "l3": m3})
    p1 = top.withColumn("p1", shrunk(F.col("n_s"), F.col("bad_s"), F.col("l0.mean"), F.col("l1.strength")))
    p2 = p1.withColumn("p2", shrunk(F.col("n_d"), F.col("bad_d"), F.col("p1"), F.col("l2.strength")))
    good = F.coalesce(F.col("n_h") - F.col("bad_h"), F.lit(0))
    return p2.select(
        "host", (F.col("l3.strength") * F.col("p2") + F.coalesce("bad_h", F.lit(0))).alias("a"),
        (F.col("l3.strength") * (1 - F.col("p2")) + good).alias("b"))


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Lower posterior bound of a beta's mean, by its standard deviation."""
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url; more columns are left out).

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest host and path together wins, then the longest host, then
    allow before block. Without a rule, ``rule`` is null and the page is blocked if the lower
    posterior bound of its host's bad share lies above ``threshold``.

    ``outcomes`` has (url, bad), one row per labelled page row, which are counted as they are; or
    (page_id, bad), one row per id, counted once for every page row of that id. An outcome without
    a page, and pages without an outcome, only miss in the reputation. Null and malformed urls have an empty host, which is a host like any
    other. Rules and reputations are found once per host; pages then look up one row, and repeated
    pages come out repeated. Empty rules or outcomes mean no rule, or allow.
    """
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if "url" in outcomes.columns:
        labelled = outcomes.select(host(F.col("url")).alias("host"), "bad")
    else:
        labelled = split.join(outcomes.where("bad IS NOT NULL").select("page_id", "bad"), "page_id")
    hosts = split.select("host").distinct()
    fit = rules.select(F.col("host").alias("top"), F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "allow").alias("allows"),
        F.col("path").alias("prefix"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    by_host = (hosts.select("host", F.explode(suffixes(F.col("host"))).alias("top")).join(fit, "top")
               .groupBy("host").agg(F.collect_list("r").alias("rules")))
    known = reputation(hosts, labelled.select("host", "bad")).join(by_host, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.expr("path").startswith(r["prefix"])))
    blocked = lower_bound(F.col("a"), F.col("b"), z) > threshold
    return split.join(known, "host").withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"))
