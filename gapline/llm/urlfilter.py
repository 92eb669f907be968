"""URL filter: rules first, then empirical-Bayes host reputation.

Outcomes of labelled pages (good: quality 1 and not toxic) are counted for each host, registered domain and suffix. From the
suffix down, each level's good share is shrunk to its parent's by a beta prior whose strength comes from the spread of the
level's groups around their parents (moments of the beta-binomial). A host passes if the lower bound of its posterior reaches
``least``: if its share is at least ``least`` with a probability of ``level``, the beta distribution's integral taken by the midpoint rule over the
share's logit, with ``NODES`` on either side of ``least``. A host without labelled pages has its domain's or suffix's prior. All of it is
DataFrame operations: counts are aggregated before they are shuffled, and the join back to the pages is on the host, where adaptive
execution splits hot hosts.

The registered domain is a suffix and one label more. Suffixes are those of a table (``suffixes``: suffix), the longest that fits; without one, and for
hosts that none fits, the last label, or the last two if they are a name of ``SECOND`` under a country's two letters.

A url that is null or has no ``://`` has an empty host and path, fits no rule and is blocked. Repeated page rows each count and
are each judged. Repeated labels of one id count once (lowest quality, highest toxicity); null labels don't count. Urls of any length are
handled alike. An empty table of pages gives an empty result; without labels all hosts have the same prior. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: names under which a country's registry hands out domains; fixed values
SECOND = ("ac", "co", "com", "ed", "edu", "gob", "gouv", "gov", "go", "gv", "mil", "ne", "net", "nom", "or", "org", "sch")
NODES = 256
PORT = "(:[0-9]*)?$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path prefix) that fits; null if none does."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(r: tuple[str, str, str]) -> Column:
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    none = F.lit(None).cast("string")
    rule = reduce(lambda acc, r: F.when(fits(r), F.lit(r[1] + r[2])).otherwise(acc), reversed(order), none)
    verdict = reduce(lambda acc, r: F.when(fits(r), F.lit(r[0])).otherwise(acc), reversed(order), none)
    return rule, verdict


def last_labels(host: Column, n: int) -> Column:
    """The last ``n`` labels of a host, without its port; empty if it has fewer."""
    return F.regexp_extract(host, "([^.:]+" + "[.][^.:]+" * (n - 1) + ")" + PORT, 1)


def suffix_of(host: Column) -> Column:
    """By the names alone."""
    two = last_labels(host, 2)
    listed = two.rlike("^(" + "|".join(SECOND) + ")[.][a-z]{2}$")
    return F.when(listed, two).otherwise(F.regexp_extract(host, "([^.:]*)" + PORT, 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host itself if it has none. A suffix of one or two labels."""
    found = F.when(F.contains(suffix, F.lit(".")), last_labels(host, 3)).otherwise(last_labels(host, 2))
    return F.when(found != "", found).when(F.contains(suffix, F.lit(".")), suffix).otherwise(host)


def with_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds suffix and domain to ``hosts`` (host and others) by the longest of ``suffixes`` (suffix) that its name ends with."""
    labels = F.split(F.regexp_replace("host", PORT, ""), "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = hosts.select("host", F.posexplode(tails).alias("at", "tail"), tails.alias("tails"))
    fit = each.join(
        suffixes.select(F.col("suffix").alias("tail")).distinct(),
        "tail",
    ).groupBy("host").agg(F.min(F.struct("at", "tail", "tails")).alias("f"))
    fit = fit.select(
        F.col("host").alias("h"),
        F.col("f.tail").alias("listed"),
        F.get("f.tails", F.greatest(F.col("f.at") - 1, F.lit(0))).alias("own"),
    )
    out = hosts.join(fit, F.col("host") == F.col("h"), "left").withColumn("suffix", F.coalesce("listed", suffix_of(F.col("host"))))
    return out.withColumn("domain", F.coalesce("own", domain_of(F.col("host"), F.col("suffix")))).drop("h", "listed", "own")


def host_counts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, s: labelled pages and good ones, of every host."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        ((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).cast("int").alias("good")
    )
    own = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host <> ''")
    return own.join(one, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s"))


def strength(groups: DataFrame) -> DataFrame:
    """One row, m: the prior's strength from groups with n, s and the parent's share p; between 1 and 1000, 10 where there's nothing to tell."""
    g = groups.where("n > 0 and p > 0 and p < 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("p"), 2) / (F.col("p") * (1 - F.col("p")))).alias("v"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("t"),
        F.sum(F.col("n") * F.col("n")).alias("t2"),
    )
    rho = F.expr("(v - k) / nullif(t - cast(t2 as double) / t, 0)")
    return g.select(
        F.when(rho.isNull(), 10.0).otherwise(
            F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / F.greatest(rho, F.lit(1e-3)) - 1))
        ).alias("m")
    )


def mass_above(a: Column, b: Column, least: float) -> Column:
    """Probability that a share with the distribution beta(a, b) is at least ``least``."""

    def softplus(t: Column) -> Column:
        return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))

    def density(t: Column) -> Column:
        return -a * softplus(-t) - b * softplus(t)

    middle, wide = F.log(a / b), 8.0 * F.sqrt(1.0 / a + 1.0 / b)
    low, high = middle - wide - 12.0 / a, middle + wide + 12.0 / b
    cut = F.greatest(low, F.least(high, F.lit(math.log(least / (1 - least)))))

    def integral(x: Column, y: Column) -> Column:
        step = (y - x) / float(NODES)
        return step * F.aggregate(
            F.sequence(F.lit(0), F.lit(NODES - 1)),
            F.lit(0.0),
            lambda s, k: s + F.exp(density(x + (k + 0.5) * step) - density(middle)),
        )

    above, below = integral(cut, high), integral(low, cut)
    return above / (above + below)


def reputation(counts: DataFrame, least: float, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, s, mean, mass (probability of a share of ``least`` or more) from :func:`host_counts`."""
    if suffixes is None:
        base = counts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    else:
        base = with_suffixes(counts, suffixes)
    base = materialise(base.select("host", "domain", "suffix", "n", "s"), "hosts")

    def shrunk(level: DataFrame, *key: str) -> DataFrame:
        with_m = level.withColumn("m", strength(level).scalar())
        return materialise(with_m.select(*key, ((F.col("s") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m"))).alias("p")), "level")

    total = base.agg(((F.sum("s") + 1.0) / (F.sum("n") + 2.0)).alias("p"))
    suffixes = base.groupBy("suffix").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
    ).withColumn("p", F.coalesce(total.scalar(), F.lit(0.5)))
    above = shrunk(suffixes, "suffix")
    domains = base.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(above, "suffix")
    hosts = base.join(shrunk(domains, "domain", "suffix"), ["domain", "suffix"])
    m = strength(hosts).scalar()
    hosts = hosts.withColumn("m", m).withColumns(
        {"a": F.col("s") + F.col("m") * F.col("p"), "b": F.col("n") - F.col("s") + F.col("m") * (1 - F.col("p"))}
    )
    mean = F.col("a") / (F.col("a") + F.col("b"))
    posterior = materialise(hosts.select("host", "n", "s", mean.alias("mean"), "a", "b"), "posterior")
    # hosts with the same posterior share its integral
    mass = posterior.select("a", "b").distinct().withColumn("mass", mass_above(F.col("a"), F.col("b"), least))
    return posterior.join(mass, ["a", "b"]).select("host", "n", "s", "mean", "mass")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    least: float = 0.5,
    level: float = 0.95,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mean, mass for each row of ``pages`` (page_id, url), with ``labels`` (doc_id, quality, toxic)."""
    pages = pages.select("page_id", "url")
    labels = labels.select("doc_id", "quality", "toxic")
    known = reputation(host_counts(pages, labels), least, suffixes).select("host", "mean", "mass")
    own = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = own.withColumns({"rule": rule, "ruled": verdict}).join(known, "host", "left")
    method = F.when(F.col("mass") >= level, "allow").otherwise("block")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "mean", "mass")
