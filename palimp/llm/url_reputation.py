"""Empirical-Bayes host reputation, by DataFrame operations only.

Labelled page outcomes (good or not) are beta-binomial counts of hosts. Each level is shrunk to the one above it: a suffix to the rate of all pages, a
registered domain to its suffix, a host to its domain. The strength of each prior comes from the data, by the method of moments: with q_i the mean that
group i inherits, p_i its own rate and n_i its size, rho = (sum n_i (p_i-q_i)^2 / sum q_i(1-q_i) - 1) / (mean n - 1), clamped to [0.001, 0.999], and the
prior weighs (1-rho)/rho pages. A host is allowed if the lower bound of its posterior, mean - z * deviation of the beta, reaches the threshold. Hosts
without labelled pages have the posterior of the lowest level that has some. Rules go before the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Public suffixes of two labels below which names are registered.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "asn.au", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my",
    "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.uk", "go.jp", "ne.jp", "net.au", "net.br", "or.jp", "org.au", "org.br", "org.uk",
)
#: Smallest and largest intra-group correlation.
RHO = 0.001, 0.999


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and dots at its end; the method's own view, rules and results have the host itself."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def suffix_of(name: Column) -> Column:
    """The last two labels where they are one of SUFFIXES, else the last; an address is its own."""
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    """The label before the suffix, and the suffix."""
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and its path is a prefix of the path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith(prefix), F.lit(rule)).otherwise(out)
    return out


def _level(stats: DataFrame, parents: DataFrame | None, key: str, parent: str | None, top: float) -> DataFrame:
    """key, posterior mean and weight of each group of a level, and what it inherits; stats: key, n, x [, parent]."""
    df = stats.withColumn("q", F.lit(top)) if parents is None else stats.join(parents.select(F.col("key").alias(parent), F.col("mean").alias("q")), parent)
    df = written(df, f"level-{key}")
    p = F.col("x") / F.col("n")
    row = df.agg(F.sum(F.col("n") * (p - F.col("q")) * (p - F.col("q"))).alias("s"), F.sum(F.col("q") * (1 - F.col("q"))).alias("v"), F.avg("n").alias("n")).first()
    rho = (row["s"] / row["v"] - 1) / (row["n"] - 1) if row["v"] and row["n"] > 1 else RHO[0]
    rho = min(max(rho, RHO[0]), RHO[1])
    m = (1 - rho) / rho
    return df.select(F.col(key).alias("key"), ((F.col("x") + m * F.col("q")) / (F.col("n") + m)).alias("mean"), (F.col("n") + m).alias("weight"))


def host_posteriors(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, mean and weight of the beta posterior of every host of `hosts` (host); outcomes: host, n, x (labelled pages and good ones)."""
    outcomes = written(outcomes.withColumn("domain", domain_of(name_of(F.col("host")))).withColumn("suffix", suffix_of(name_of(F.col("host")))), "outcomes")
    total = outcomes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")).first()
    top, weight = (total["x"] + 1) / (total["n"] + 2), float(total["n"] + 2)
    suffixes = _level(outcomes.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), None, "suffix", None, top)
    domains = _level(outcomes.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), suffixes, "domain", "suffix", top)
    own = _level(outcomes.select("host", "domain", "n", "x"), domains, "host", "domain", top)
    out = hosts.select("host").distinct().withColumn("domain", domain_of(name_of(F.col("host")))).withColumn("suffix", suffix_of(name_of(F.col("host"))))
    for name, level in (("host", own), ("domain", domains), ("suffix", suffixes)):
        out = out.join(level.select(F.col("key").alias(name), F.struct("mean", "weight").alias(f"{name}_post")), name, "left")
    best = F.coalesce("host_post", "domain_post", "suffix_post", F.struct(F.lit(top).alias("mean"), F.lit(weight).alias("weight")))
    return out.select("host", best.alias("b")).select("host", "b.mean", "b.weight")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], threshold: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of each row of pages.

    outcomes: host, good (boolean or 0/1) for each labelled page; rows with a null in either are ignored. rules: rule -> allow or block. A null url, or one without
    ://, has an empty host and path and is judged as the host ''. Without any outcome all hosts have the prior mean 1/2. Repeated rows are judged each; other columns are ignored.
    The hosts' table is joined to the pages by host; a hot host is split by adaptive execution, or its table is broadcast below Spark's own threshold.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = outcomes.where("host is not null and good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("x"))
    post = host_posteriors(base.select("host"), counts)
    low = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    verdicts = written(post.select("host", F.when(low >= threshold, "allow").otherwise("block").alias("by_host")), "verdicts")
    rule = rule_column(F.col("host"), F.col("path"), rules)
    of_rule = F.lit(None).cast("string")
    for name, verdict in rules.items():
        of_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(of_rule)
    return base.join(verdicts, "host").withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(of_rule, "by_host").alias("verdict"))
