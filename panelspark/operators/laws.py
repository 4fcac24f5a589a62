"""An inventory of rules from claims about them: what is verified, what follows from a pattern, and from when each counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a law says from when it counts: by a note on its history, at once, by a published list, or as a section of a code.
NOTED, AT_ONCE, LISTED, CODE = "noted", "at_once", "listed", "code"
DATES = ("enacted", "effective", "operative", "sunset")


def checked(claims: DataFrame, sources: DataFrame, source: str, quote: str, text: str, at_least: int = 12) -> DataFrame:
    """claims with `verified`: whether the quote, white space folded, stands in the text of its source.

    Quotes of fewer characters than `at_least`, null ones and those whose source is not there are not verified. Sources are
    joined by key; a source that stands there twice verifies a quote if either text holds it.
    """
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    asked = claims.select(F.col(source).alias("__s"), F.col(quote).alias("__q")).distinct()
    texts = sources.select(F.col(source).alias("__s"), fold(F.col(text)).alias("__t"))
    held = asked.join(texts, "__s").groupBy("__s", "__q").agg(F.bool_or((F.length(fold(F.col("__q"))) >= at_least) & F.contains("__t", fold(F.col("__q")))).alias("verified"))
    on = (F.col(source) == F.col("__s")) & F.col(quote).eqNullSafe(F.col("__q"))
    return claims.join(held, on, "left").drop("__s", "__q").withColumn("verified", F.coalesce("verified", F.lit(False)))


def inventory(laws: DataFrame, claims: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """laws with enacted, effective, operative, sunset, basis, inferred_rule, n_claims and verified.

    laws: (law, family, kind, ...), kinds as above. claims: (law, field, value date, verified), any number a field, of which
    the earliest verified value counts. rule gives the effective date that an enactment would have. It stands in for a
    `noted` law without a verified effective date only if its family has at least one noted law with both dates verified and
    every such law follows the rule: one that does not, and nothing is inferred in that family. Basis says which way a date
    was found; null dates have none. verified is `yes` if all of a law's claims are, `partial` if some, else `unverified`.
    Null families are one family of their own. Claims of laws that are not listed are left out.
    """
    ok = F.coalesce(F.col("verified"), F.lit(False))
    of = lambda f: F.min(F.when((F.col("field") == f) & ok, F.col("value")))
    said = claims.groupBy("law").agg(*[of(f).alias(f"__{f}") for f in DATES], F.coalesce(F.bool_or((F.col("field") == "at_once") & ok), F.lit(False)).alias("__now"), F.count("*").alias("n_claims"), F.count_if(ok).alias("__ok"))
    known = laws.join(said, "law", "left")
    noted = known.where((F.col("kind") == NOTED) & F.col("__effective").isNotNull() & F.col("__enacted").isNotNull())
    pattern = noted.groupBy("family").agg(F.bool_and(F.col("__effective") == rule(F.col("__enacted"))).alias("__rule")).select(F.col("family").alias("__family"), "__rule")
    j = known.join(pattern, F.col("family").eqNullSafe(F.col("__family")), "left").drop("__family")
    follows = F.coalesce(F.col("__rule"), F.lit(False))
    by_note = F.col("kind").isin(NOTED, LISTED) & F.col("__effective").isNotNull()
    by_rule = (F.col("kind") == NOTED) & follows & rule(F.col("__enacted")).isNotNull()
    now = (F.col("kind") == AT_ONCE) & F.col("__now") & F.col("__enacted").isNotNull()
    effective = F.when(by_note, F.col("__effective")).when(by_rule, rule(F.col("__enacted"))).when(now, F.col("__enacted"))
    basis = F.when(by_note & (F.col("kind") == NOTED), "history note").when(by_note, "published list").when(by_rule, "inferred").when(now, "takes effect at once").when(F.col("kind") == CODE, "code in force")
    n, n_ok = F.coalesce("n_claims", F.lit(0)), F.coalesce("__ok", F.lit(0))
    state = F.when(n_ok == 0, "unverified").when(n_ok == n, "yes").otherwise("partial")
    return j.select(*laws.columns, F.col("__enacted").alias("enacted"), effective.alias("effective"), F.col("__operative").alias("operative"), F.col("__sunset").alias("sunset"), basis.alias("basis"), follows.alias("inferred_rule"), n.alias("n_claims"), state.alias("verified"))


def counts_on(day: Column) -> Column:
    """Whether a row of an inventory counts on a day: from the later of its effective and operative dates until its sunset; one without an effective date never does."""
    start = F.greatest("effective", "operative")
    return F.coalesce(F.col("effective").isNotNull() & (day >= start) & (F.col("sunset").isNull() | (day < F.col("sunset"))), F.lit(False))
