"""URL verdicts: explicit rules first, else the host's reputation by empirical Bayes.

Labelled pages give each host good and bad outcomes. A host's rate has a beta prior about its registered domain's, that
one's about its suffix's, and that one's about the mean of all. How strong the prior of a level is follows from the data:
by how much more the outcomes of its groups scatter about what is above them than those of alike groups would (moments of
the beta-binomial law). A host is blocked when even the lower bound of its posterior, a quantile of the beta law, is above
the limit, a multiple of the mean rate of all. Where outcomes say that hosts are alike, none is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import discard, materialize

#: (verdict, host, path): the longest host and path that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The posterior's quantile that is held against the limit, and the limit as a multiple of the mean rate of bad pages.
QUANTILE, LIMIT = 0.1, 1.25
#: Share of the variance that lies between groups, at least and at most: priors of 9,999 pages down to 1.
LEAST_BETWEEN, MOST_BETWEEN = 1e-4, 0.5
#: Steps of the numeric integral of a posterior.
STEPS = 400
#: Second-level names that registries of countries sell names below: fixed values.
REGISTRY = ("ac", "co", "com", "edu", "gob", "gov", "go", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #. Else both empty."""
    rest = F.when(url.contains("://"), F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and a prefix of the path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, its port aside. The suffix is the last label, or the last two where a country's
    registry sells names below the second (co.uk); the domain has one label more. A host of one label, or of numbers, is both."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = bare.rlike(rf"\.(?:{'|'.join(REGISTRY)})\.[a-z]{{2}}$")
    whole = bare.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(whole, bare).otherwise(domain), F.when(whole, bare).otherwise(suffix)


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row (strength): pages that the prior about `mean` counts for, from groups (n, bad, mean)."""
    spread = F.col(mean) * (1 - F.col(mean))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col(mean), F.lit(2.0)) - F.col("n") * spread)
    between = F.coalesce(over / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * spread), F.lit(0.0)), F.lit(0.0))
    return groups.agg((1 / F.least(F.greatest(between, F.lit(LEAST_BETWEEN)), F.lit(MOST_BETWEEN)) - 1).alias("strength"))


def beta_quantile(a: Column, b: Column, q: float, steps: int = STEPS) -> Column:
    """The q-quantile of the beta law (a, b), by the trapezoid rule over the log odds, where its density is smooth."""
    middle, reach = F.log(a / b), 12 * F.sqrt(1 / a + 1 / b)
    low, high = middle - F.greatest(reach, 30 / a), middle + F.greatest(reach, 30 / b)
    odds = lambda i: low + (high - low) * i / steps
    height = lambda x: F.exp(-a * F.log1p(F.exp(-x)) - b * F.log1p(F.exp(x)) + a * F.log1p(F.exp(-middle)) + b * F.log1p(F.exp(middle)))
    heights = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: height(odds(i)))

    def find(h):
        cell = lambda i: (F.get(h, i - 1) + F.get(h, i)) / 2
        cells = F.sequence(F.lit(1), F.lit(steps))
        whole = F.aggregate(cells, F.lit(0.0), lambda s, i: s + cell(i))
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        step = lambda want: lambda d, i: F.struct((d["sum"] + cell(i)).alias("sum"), F.when(d["at"].isNotNull(), d["at"]).when(d["sum"] + cell(i) >= want, i - 1 + (want - d["sum"]) / cell(i)).alias("at"))
        return F.transform(F.array(whole * q), lambda want: F.aggregate(cells, zero, step(want))["at"])

    at = F.flatten(F.transform(F.array(heights), find))
    return F.get(F.transform(at, lambda i: 1 / (1 + F.exp(-odds(i)))), 0)


def reputation(outcomes: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(host, n, bad) -> (host, n, mean, bound, overall): posterior mean and lower bound of the rate of bad pages, and the mean rate of all; nulls if no n is above 0.

    Hosts of n = 0 take their domain's posterior mean as prior, which is that of its suffix or of all where nothing is
    labelled. The three strengths and the overall rate are one row.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    # Each level is written once: the strengths and means of the next are made of it several times.
    named = materialize(outcomes.withColumn("domain", domain).withColumn("suffix", suffix), "url-hosts")
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(domains, "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg((F.sum("bad") / F.nullif(F.sum("n"), F.lit(0))).alias("overall"))
    smooth = (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))

    def level(groups: DataFrame) -> DataFrame:
        # One row of strength for all groups.
        return groups.crossJoin(F.broadcast(_strength(groups, "prior")))

    by_suffix = level(suffixes.crossJoin(F.broadcast(total)).withColumn("prior", F.col("overall"))).select("suffix", "overall", smooth.alias("prior"))
    by_suffix = materialize(by_suffix, "url-suffixes")
    by_domain = materialize(level(domains.join(by_suffix, "suffix")).select("domain", "overall", smooth.alias("prior")), "url-priors")
    hosts = level(named.select("host", "domain", "n", "bad").join(by_domain, "domain"))
    a, b = F.col("bad") + F.col("strength") * F.col("prior"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    bound = F.when(F.col("prior") <= 0, 0.0).when(F.col("prior") >= 1, 1.0).otherwise(beta_quantile(F.col("a"), F.col("b"), quantile))
    out = materialize(hosts.withColumn("a", a).withColumn("b", b).select("host", "n", smooth.alias("mean"), F.when(F.col("overall").isNotNull(), bound).alias("bound"), "overall"), "url-reputation")
    for x in (named, domains, by_suffix, by_domain):
        discard(x)
    return out


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", outcome: str = "toxic", rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """One row for each row of pages: key, host, path, rule, verdict, bound.

    verdict is that of the longest rule that fits, else block when the lower bound of the host's posterior rate of bad
    pages (outcome = 1 among its labelled pages, found by label_key = key) is above `limit` times the rate of all, else
    allow; hosts without labelled pages are judged by their domain, suffix or all. Bounds are null, and pages allowed,
    where the host is empty or no page is labelled at all. A url that is null or has no :// has an empty host and path.
    Null keys and null outcomes carry no outcome; repeated labels count once, a key labelled both ways is bad; rows of one
    key and host count once. Other columns play no part.
    """
    host, path = host_and_path(F.col("__url"))
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("__url")).select("page", host.alias("host"), path.alias("path"))
    marked = labels.where(F.col(label_key).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(label_key).alias("page")).agg(F.max(outcome).alias("bad"))
    seen = rows.where("host <> ''").select("page", "host").distinct().join(marked, "page", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    known = reputation(seen).select("host", "bound", "overall")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("rule", rule).withColumn("ruled", verdict).join(known, "host", "left")
    method = F.when(F.col("bound") > limit * F.col("overall"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("page").alias(key), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "bound")
