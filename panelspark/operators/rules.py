"""Rules as rows: a schedule of regimes by date, tiers by size, escalators with caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.quantiles import quantile_table


def in_force(df: DataFrame, regimes: DataFrame, at: str) -> DataFrame:
    """df with the columns of the regime whose [start, end) holds its date, the one of the smallest priority; regimes are a handful of rows."""
    joined = df.join(F.broadcast(regimes), (F.col(at) >= F.col("start")) & (F.col("end").isNull() | (F.col(at) < F.col("end"))), "left")
    terms = [c for c in regimes.columns if c not in ("start", "end")]
    best = joined.groupBy(*df.columns).agg(F.min_by(F.struct(*terms), "priority").alias("__r"))
    return best.select(*df.columns, *[F.col(f"__r.{c}").alias(c) for c in terms if c != "priority"])


def tiered(n: Column, edge: float, low: Column, high: Column) -> Column:
    """The first `edge` units at one rate, the rest at the other."""
    return F.least(n, F.lit(edge)) * low + F.greatest(n - edge, F.lit(0.0)) * high


def escalated(base: Column, step: float, year: Column, first: int, cap: float) -> Column:
    """base plus a step for every year after the first, up to a cap."""
    return F.least(base + step * F.greatest(year - first, F.lit(0)), F.lit(cap))


def first_regime(ladder: list[tuple[str, Column, dict[str, Column | float]]], terms: list[str]) -> Column:
    """struct<regime, terms...> of the first regime of a ladder whose condition holds; all null where none does."""
    out = F.struct(F.lit(None).cast("string").alias("regime"), *[F.lit(None).cast("double").alias(t) for t in terms])
    for name, condition, values in reversed(ladder):
        one = F.struct(F.lit(name).alias("regime"), *[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(t) for t in terms for v in [values.get(t, F.lit(None))]])
        out = F.when(F.coalesce(condition, F.lit(False)), one).otherwise(out)
    return out


def register_rate(df: DataFrame, register: DataFrame, year: str, section: str, out: str) -> DataFrame:
    """df with `out` and `out`_clamped: the rate of its section in its year, years after a section's last register year taking that one's; null before the first."""
    last = register.groupBy(section).agg(F.max(year).alias("__last"))
    clamped = df.join(last, section, "left").withColumn("__year", F.least(F.col(year), F.col("__last")))
    rates = register.select(section, F.col(year).alias("__year"), F.col("rate").alias(out))
    return clamped.join(rates, [section, "__year"], "left").withColumn(f"{out}_clamped", F.coalesce(F.col(year) > F.col("__last"), F.lit(False))).drop("__year", "__last")


def whole_total(parts: list[Column]) -> Column:
    """The sum of all parts, null where one of them is unknown."""
    known = parts[0].isNotNull()
    total = parts[0]
    for p in parts[1:]:
        known, total = known & p.isNotNull(), total + p
    return F.when(known, total)


def verified(claims: DataFrame, key: str, field: str, value: str, flag: str = "verified") -> DataFrame:
    """(key, field, value) of the claims that are verified; a claim that is asked for and not verified is an error where the plan runs."""
    checked = F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not verified: "), F.col(key).cast("string"), F.lit("."), F.col(field).cast("string"))).cast(claims.schema[value].dataType))
    return claims.select(key, field, checked.alias(value))


def universe(df: DataFrame, rules: dict[str, Column], dear: str, of: Column, cost: str, period: str, share: float = 0.95, nominal: float | None = None) -> DataFrame:
    """df with a flag for every rule and one, `dear`, for rows of a kind whose cost reaches the period's quantile, and in_universe, whether any holds.

    The quantile is exact and taken among rows of that kind (`of`) alone, so it means the same in every period; `nominal`
    takes a fixed amount instead. A null condition, cost or period is no member.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    if nominal is None:
        cuts = quantile_table(df.where(holds(of) & F.col(period).isNotNull()), [period], cost, (share,), ["__cut"]).select(period, "__cut")
        # A row a period.
        out = df.join(cuts, period, "left")
    else:
        out = df.withColumn("__cut", F.lit(nominal))
    flagged = out.select(*df.columns, *[holds(c).alias(n) for n, c in rules.items()], holds(of & (F.col(cost) >= F.col("__cut"))).alias(dear))
    any_of = F.lit(False)
    for n in (*rules, dear):
        any_of = any_of | F.col(f"`{n}`")
    return flagged.withColumn("in_universe", any_of)
