"""Operator 3: empirical-Bayes host reputation for page addresses, with explicit rules on top. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Bad rates are shrunk through
beta-binomial priors from the top down: the overall rate is the prior of a suffix, a suffix's posterior mean that of its
domains, a domain's that of its hosts. How strong each level's prior is, is estimated from the labels by the method of
moments (the over-dispersion of rates among the groups of that level). A host's pages are blocked when the lower bound
of its posterior bad rate, the ``TAIL`` quantile of its beta distribution, is at least ``limit``. Rules (host, path) come first: one fits its host and all subdomains if
the page's path starts with the rule's; the longest wins.

A host without labelled pages takes part with n = 0: it has the mean of its registered domain, a domain without labels
that of its suffix, and a suffix without labels the overall rate. Its beta distribution has the variance that adds the
spread of every level that has no label of its own. A null address, or one without ``://``, has an empty host and path: no rule fits and no outcome
is known of it, so the overall rate decides. Pages without labels and null labels count no outcome. Repeated rows
are judged alike, and each counts as an outcome of its own; extra columns are ignored; empty tables give the overall
rate 0. Only rates by level (four numbers each) come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LIMIT = 0.25
TAIL = 0.05
#: Points of the quadrature of a beta distribution, and deviations that it reaches to either side.
POINTS, REACH = 401, 8

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")

#: Hosts that are addresses, and the suffix that they share.
ADDRESS, ADDRESSES = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*)$", "[address]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url")))
    host = F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix (last label, or two) and the label before it with it; of the host without a port. An IP address is a
    domain of its own below the suffix ``ADDRESSES``."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    address = bare.rlike(ADDRESS)
    suffix = F.when(address, F.lit(ADDRESSES)).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))
    return suffix, F.when(address, bare).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def prior_strength(groups: DataFrame) -> float:
    """How many observations the prior of a level is worth, by moments over its groups (n, bad, mean: the prior's mean).

    Among groups of beta-binomial rates, sum n (rate - mean)^2 / (mean (1 - mean)) has the expectation
    (K - 1) + rho (N - sum n^2 / N - (K - 1)); the strength is 1 / rho - 1.
    """
    v = F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(1e-6))
    spread = F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("mean")) ** 2 / v)
    s, k, n, n2 = groups.where("n > 0").agg(spread, F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    free = (n - n2 / n - (k - 1)) if n else 0.0
    rho = (s - (k - 1)) / free if free > 0 else 0.0
    return 1 / min(0.9, max(1e-3, rho)) - 1


def beta_quantile(rate: Column, weight: Column, tail: float = TAIL) -> Column:
    """The ``tail`` quantile of the beta distribution with mean ``rate`` and ``weight`` observations.

    The density of the log-odds u, sigmoid(u)^a * (1 - sigmoid(u))^b, has one hill, at log(a / b). It is summed over a grid
    around that (a bar reaches half a step to either side) until it holds ``tail`` of the whole sum; within the last step the sum is taken as linear.
    """
    a, b = F.greatest(rate * weight, F.lit(1e-6)), F.greatest((1 - rate) * weight, F.lit(1e-6))
    shape = F.struct(a.alias("a"), b.alias("b"), F.log(a / b).alias("mode"), (F.sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b)) * (2 * REACH / (POINTS - 1))).alias("step"))
    log1p_exp = lambda u: F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
    height = lambda s, u: -s["a"] * log1p_exp(-u) - s["b"] * log1p_exp(u)
    at = lambda s, i: s["mode"] + (i - (POINTS - 1) // 2) * s["step"]
    grid = F.sequence(F.lit(0), F.lit(POINTS - 1))
    bars = lambda s: F.transform(grid, lambda i: F.exp(height(s, at(s, i)) - height(s, s["mode"])))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("u"))

    def crossed(s: Column, d: Column) -> Column:
        goal = tail * F.aggregate(d, F.lit(0.0), lambda t, x: t + x)

        def step(t: Column, x: Column) -> Column:
            here = t["sum"] + x["d"]
            u = F.when(t["u"].isNull() & (here >= x["goal"]), at(s, x["i"]) + (0.5 - (here - x["goal"]) / x["d"]) * s["step"]).otherwise(t["u"])
            return F.struct(here.alias("sum"), u.alias("u"))

        rows = F.transform(F.array(F.struct(d.alias("d"), goal.alias("goal"))), lambda w: F.transform(w["d"], lambda x, i: F.struct(x.alias("d"), i.alias("i"), w["goal"].alias("goal"))))[0]
        return F.aggregate(rows, none, step)["u"]

    shaped = F.transform(F.array(shape), lambda s: F.struct(s.alias("s"), bars(s).alias("d")))
    u = F.transform(shaped, lambda x: crossed(x["s"], x["d"]))[0]
    return 1 / (1 + F.exp(-u))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad_rate, lower) of every host in (host, bad) outcomes; a null ``bad`` names a host and counts nothing."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    total, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = bad / total if total else 0.0

    def shrink(groups: DataFrame) -> DataFrame:
        """With the posterior rate, and ``loose``: the variance of an unlabelled group's rate as a share of rate (1 - rate)."""
        m = prior_strength(groups)
        loose = F.when(F.col("n") > 0, F.lit(0.0)).otherwise(1 - (1 - F.col("above")) * (m / (m + 1)))
        return groups.withColumns({"strength": F.lit(m), "rate": (F.col("bad") + m * F.col("mean")) / (F.col("n") + m), "loose": loose})

    up = (F.col("rate").alias("mean"), F.col("loose").alias("above"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = shrink(suffixes.withColumns({"mean": F.lit(overall), "above": F.lit(0.0)}))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = shrink(domains.join(suffixes.select("suffix", *up), "suffix"))
    known = shrink(hosts.join(domains.select("domain", "suffix", *up), ["suffix", "domain"]))
    share = F.when(F.col("n") > 0, 1 / (F.col("n") + F.col("strength") + 1)).otherwise(F.col("loose"))
    known = known.select("host", "rate", (1 / share - 1).alias("weight"))
    return known.select("host", F.col("rate").alias("bad_rate"), beta_quantile(F.col("rate"), F.col("weight")).alias("lower"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page is labelled through the document number in its path; bad means low quality or toxic."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    host, path = host_and_path(F.col("url"))
    # Hosts and numbers are few against pages: count before the join.
    seen = pages.select(host.alias("host"), F.regexp_extract(path, "^/[^/]*/([0-9]{1,18})", 1).alias("number")).where("number <> ''")
    return seen.withColumn("doc_id", F.col("number").cast("long")).join(marked, "doc_id").select("host", "bad")


def judge_pages(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower) for each page."""
    host, path = host_and_path(F.col("url"))
    every = pages.select(host.alias("host"), F.lit(None).cast("int").alias("bad"))
    known = host_reputation(labelled_outcomes(pages, labels).unionByName(every))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).join(known, "host", "left")
    rate, lower = F.col("bad_rate"), F.col("lower")
    own = F.when(lower >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round(rate, 6).alias("bad_rate"), F.round(lower, 6).alias("lower_bound"))
