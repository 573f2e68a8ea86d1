"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages are counted per host. A beta-binomial prior is fitted at each level from
the spread of the units below it, and the rates are shrunk from suffix to registered domain to host.
A host is blocked when the lower bound of its posterior rate of bad pages reaches ``block_at``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.session import staged

#: Suffixes of two labels below which domains are registered (extend by parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za")
Z = 1.645
BLOCK_AT = 0.5
#: Bounds of the fitted correlation within a unit: strengths from 9999 down to 1.
RHO = (0.0001, 0.5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # with A-Z lower-cased; then up to ? or #."""
    rest = F.when(url.contains("://"), F.expr("substring(_u, locate('://', _u) + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path; both empty where the url is null or has no ``://``."""
    host, path = url_parts(F.col("_u"))
    return pages.withColumn("_u", F.col(url_col)).withColumns({"host": host, "path": path}).drop("_u")


def registered_domain(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(domain, suffix) of a host without user and port; a host of one label is both."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last2 = F.substring_index(name, ".", -2)
    long = last2.isin(*two_label) & name.contains(".")
    domain = F.when(long, F.substring_index(name, ".", -3)).otherwise(last2)
    suffix = F.when(long, last2).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def _strength(units: DataFrame, mean: str) -> float:
    """Strength of the beta prior whose mean each unit takes from its parent, by moments.

    One number for a whole level comes to the driver.
    """
    p = F.col(mean)
    misfit = F.sum(F.pow(F.col("k") - F.col("n") * p, 2) / (F.col("n") * p * (1 - p)))
    row = units.filter("n > 0").agg(misfit.alias("misfit"), F.sum("n").alias("n"), F.count("*").alias("units")).first()
    spare = (row["n"] or 0) - row["units"]
    rho = (row["misfit"] - row["units"]) / spare if spare > 0 else RHO[1]
    rho = min(max(rho, RHO[0]), RHO[1])
    return (1 - rho) / rho


def _shrunk(units: DataFrame, parent_mean: str, out: str) -> DataFrame:
    """Adds alpha, beta and their mean as ``out``."""
    strength = _strength(units, parent_mean)
    alpha = F.lit(strength) * F.col(parent_mean) + F.col("k")
    beta = F.lit(strength) * (1 - F.col(parent_mean)) + F.col("n") - F.col("k")
    return units.withColumns({"alpha": alpha, "beta": beta}).withColumn(
        out, F.col("alpha") / (F.col("alpha") + F.col("beta"))
    )


def host_reputation(
    outcomes: DataFrame, z: float = Z, block_at: float = BLOCK_AT,
    two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """One row per host: pages labelled (n), bad ones (k), posterior mean, bounds and ``blocked``.

    ``outcomes`` has host and bad (1, 0, or null for an unlabelled page). A host without labelled
    pages takes its domain's mean. Without any label the mean is one half at every level, with the
    widest prior, and nothing is blocked unless ``block_at`` is below the lower bound of that.
    """
    counts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")
    )
    domain, suffix = registered_domain(F.col("host"), two_label)
    hosts = staged(counts.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    seen = hosts.agg(*sums).first()
    overall = ((seen["k"] or 0) + 0.5) / ((seen["n"] or 0) + 1.0)
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("overall", F.lit(overall))
    suffixes = staged(_shrunk(suffixes, "overall", "suffix_mean").select("suffix", "suffix_mean"), "url-suffixes")
    domains = staged(hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix"), "url-domain-counts")
    domains = staged(
        _shrunk(domains, "suffix_mean", "domain_mean").select("domain", "domain_mean"), "url-domains"
    )
    hosts = staged(hosts.join(domains, "domain"), "url-host-priors")
    hosts = _shrunk(hosts, "domain_mean", "mean")
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return hosts.select(
        "host", "n", "k", "mean", (F.col("mean") - z * deviation).alias("lower"),
        (F.col("mean") + z * deviation).alias("upper"),
    ).withColumn("blocked", F.col("lower") >= block_at)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; both null where none fits.

    A rule like ``example.net/en/`` fits its host and all subdomains if the path starts with its
    path. The rules are a parameter of fixed length, tested from the longest to the shortest.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def url_filter(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]],
    id_col: str = "page_id", url_col: str = "url", z: float = Z, block_at: float = BLOCK_AT,
    two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """All rows of ``pages`` with host, path, rule and verdict (allow or block) added.

    ``outcomes`` has ``id_col`` and bad (1 or 0); rows that repeat an id with different outcomes
    count as bad, null ids or outcomes label nothing. Urls that are null or have no ``://`` have an
    empty host, which is judged like any other. Repeated pages count one by one. An empty table
    gives an empty result; columns of ``pages`` named like the added ones are replaced.
    """
    parted = with_parts(pages, url_col)
    labelled = outcomes.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("bad").alias("bad"))
    seen = parted.select(id_col, "host").join(labelled, id_col, "left")
    reputation = staged(
        host_reputation(seen, z, block_at, two_label).select(F.col("host").alias("_host"), "blocked"),
        "url-reputation",
    ).select("_host", F.col("blocked").alias("_blocked"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        parted.join(reputation, F.col("host") == F.col("_host"), "left")
        .withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)})
        .drop("_host", "_blocked")
    )
