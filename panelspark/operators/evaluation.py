"""Evaluation: field comparators, boundary scores, forecasts, calibration, quality sentinels and deficits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelspark.functions import keys as K
from panelspark.functions import textops as T

#: Texts that share so many of their words are the same.
OVERLAP = 0.85


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+", "")


def same_field(kind: str, predicted: Column, gold: Column) -> Column:
    """Whether a predicted text says what the gold one says, by kind: enum, identifier, date, names, digits or text.

    Identifiers and digits are the same only where the gold one is set; a text also where one begins with the other, the
    gold one stands in the predicted one, or they share most words; blank texts are the same.
    """
    p, g = F.coalesce(predicted, F.lit("")), F.coalesce(gold, F.lit(""))
    if kind == "identifier":
        return (alnum(g) != "") & (alnum(p) == alnum(g))
    if kind == "date":
        dp, dg = K.iso_date(p), K.iso_date(g)
        return F.when((dp != "") & (dg != ""), dp == dg).otherwise(alnum(p) == alnum(g))
    if kind == "digits":
        found = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))))
        return (F.size(found(g)) > 0) & (found(p) == found(g))
    if kind == "names":
        names = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(x, r"[,;]"), K.surname), lambda n: n != "")))
        return names(p) == names(g)
    if kind == "text":
        a, b = alnum(p), alnum(g)
        near = (a != "") & (b != "") & (a.startswith(b) | b.startswith(a) | a.contains(b))
        words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+"), F.lit(0)))
        return ((a == "") & (b == "")) | near | F.coalesce(T.jaccard(words(p), words(g)) >= OVERLAP, F.lit(False))
    return F.lower(F.trim(p)) == F.lower(F.trim(g))


def set_scores(predicted: DataFrame, gold: DataFrame, key: list[str], element: list[str]) -> DataFrame:
    """(key, n_predicted, n_gold, n_both, precision, recall) of distinct elements; precision is null where nothing is predicted, recall where nothing is true."""
    p = predicted.select(*key, *element).distinct().withColumn("__p", F.lit(1))
    g = gold.select(*key, *element).distinct().withColumn("__g", F.lit(1))
    both = p.join(g, [*key, *element], "full_outer").groupBy(*key).agg(F.count("__p").alias("n_predicted"), F.count("__g").alias("n_gold"), F.count_if(F.col("__p").isNotNull() & F.col("__g").isNotNull()).alias("n_both"))
    return both.withColumn("precision", F.col("n_both") / F.nullif("n_predicted", F.lit(0))).withColumn("recall", F.col("n_both") / F.nullif("n_gold", F.lit(0)))


def cell_forecast(train: DataFrame, test: DataFrame, cells: list[str], y: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """One row: forecasts of test from the training means of its cell. n_train, n_test, n_dropped (cells unseen in training), r2_in, r2_out against the mean of training, and the mean outcome."""
    means = train.groupBy(*cells).agg(F.avg(y).alias("__p"))
    whole = train.agg(F.avg(y).alias("__mean"))  # one row
    known = lambda d: d.join(means, cells, "left").crossJoin(F.broadcast(whole))
    p = F.least(F.greatest(F.col("__p"), F.lit(clip[0])), F.lit(clip[1])) if clip else F.col("__p")
    error, spread = F.pow(F.col(y) - p, F.lit(2)), F.pow(F.col(y) - F.col("__mean"), F.lit(2))
    fits = F.col("__p").isNotNull()
    inside = known(train).agg(F.count("*").alias("n_train"), (1 - F.sum(error) / F.sum(spread)).alias("r2_in"))
    outside = known(test).agg(F.count_if(fits).alias("n_test"), F.count_if(~fits).alias("n_dropped"), (1 - F.sum(F.when(fits, error)) / F.sum(F.when(fits, spread))).alias("r2_out"), F.avg(F.when(fits, F.col(y))).alias("mean_out"))
    return inside.crossJoin(F.broadcast(outside))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> tuple[list[float], dict]:
    """(coefficients with the constant first, fit) by normal equations: one aggregation of products; the driver solves as many equations as there are columns."""
    import numpy as np

    names = ["__one", *xs]
    rows = df.withColumn("__one", F.lit(1.0)).where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    one = rows.agg(*products, *[F.sum(F.col(a) * F.col(y)).alias(f"y_{i}") for i, a in enumerate(names)], F.sum(F.col(y) * F.col(y)).alias("yy")).first()
    if one["0_0"] is None:
        return [0.0] * len(names), {"n": 0, "r2": None, "r2_adj": None, "sd": None}
    m = np.array([[one[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    v = np.array([one[f"y_{i}"] for i in range(len(names))], float)
    beta, *_ = np.linalg.lstsq(m, v, rcond=None)
    n, sse, sst = m[0, 0], one["yy"] - beta @ v, one["yy"] - v[0] ** 2 / m[0, 0]
    df_left = n - np.linalg.matrix_rank(m)
    return beta.tolist(), {"n": int(n), "r2": float(1 - sse / sst), "r2_adj": float(1 - (sse / df_left) / (sst / (n - 1))), "sd": float(np.sqrt(sse / df_left))}


def deficits(df: DataFrame, field: str, target: int) -> DataFrame:
    """(field, have, deficit): how many more labels each class wants."""
    return df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("have")).withColumn("deficit", F.greatest(F.lit(target) - F.col("have"), F.lit(0)))


def issues(*checks: tuple[str, str, Column]) -> Column:
    """array<struct<check, severity>> of the checks (name, severity, condition) that hold."""
    listed = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"))) for n, s, c in checks]
    return F.array_compact(F.array(*listed))


def backfilled(label: Column, derived: Column) -> Column:
    """The label, or what is derived where the label is blank or other."""
    blank = label.isNull() | F.lower(F.trim(label)).isin("", "other")
    return F.when(blank & derived.isNotNull() & (F.trim(derived) != ""), derived).otherwise(label)


def nested_prefixes(df: DataFrame, group: str, order: list, sizes: list[int]) -> DataFrame:
    """A row for each size that a row is in: prefixes of one order that takes one of each class in turn, each within the next."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    placed = df.withColumn("__turn", turn)
    # The place in the whole order: rows of earlier turns, then classes of the same turn that come before.
    per_turn = placed.groupBy("__turn").agg(F.array_sort(F.collect_list(group)).alias("__classes"))
    before = per_turn.withColumn("__before", F.coalesce(F.sum(F.size("__classes")).over(W.orderBy("__turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = placed.join(before, "__turn").withColumn("place", F.col("__before") + F.array_position("__classes", F.col(group)))
    return place.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("place <= size").drop("__turn", "__classes", "__before")
