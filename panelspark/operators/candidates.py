"""Keys under which a record may be found: printed forms, siblings' suffixes, numbers of years around; and places built from them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Year and serial of a case number, and what stands behind them.
STEM = r"^(\d{2,4}[.-]\d+)"

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def case_forms(items: DataFrame, case: str, printed: str) -> DataFrame:
    """(case, stem, variants, together): a row a case with every form it may be filed under, without repeats; a stem's first case also has those of all its cases.

    These are the number itself, each way it was printed, its stem, and the stem with every suffix that a case of the same
    stem has. Repeats go before stems meet, so a case with many rows costs no more than one; an array holds the printed
    forms and the suffixes of one stem. Numbers that do not read as a case are their own stem, and null or blank
    ones have no rows.
    """
    said = items.select(F.col(case).alias("case"), F.col(printed).alias("printed")).where(F.coalesce(F.col("case") != "", F.lit(False))).distinct()
    stem = F.coalesce(F.nullif(F.regexp_extract("case", STEM, 1), F.lit("")), F.col("case"))
    # One deal by stem and one order of its rows serve all that follows.
    own, near = Window.partitionBy("stem", "case"), Window.partitionBy("stem")
    suffix = F.substring(F.col("case"), F.length("stem") + 1, F.length("case"))
    rows = said.withColumn("stem", stem).repartition("stem").withColumn("n", F.row_number().over(own.orderBy("printed"))).withColumn("first", F.row_number().over(near.orderBy("case", "printed")) == 1)
    met = rows.withColumns({"own": F.collect_set("printed").over(own), "near": F.collect_set("printed").over(near), "ends": F.collect_set(suffix).over(near)}).where("n = 1")
    forms = lambda *a: F.filter(F.array_distinct(F.concat(*a, F.transform("ends", lambda e: F.concat("stem", e)))), lambda v: v != "")
    return met.select("case", "stem", forms(F.array("case", "stem"), F.col("own")).alias("variants"), F.when(F.col("first"), forms(F.array("stem"), F.col("near"))).alias("together"))


def case_keys(items: DataFrame, case: str, printed: str) -> DataFrame:
    """(case, variant): the forms of case_forms, a row each."""
    return case_forms(items, case, printed).select("case", F.explode("variants").alias("variant"))


def instrument_forms(items: DataFrame, number: str, instrument: str, year: str, resolution: str = "resolution", prefix: str = "R", around: int = 1) -> DataFrame:
    """(number, year, forms): each number of 3 to 6 digits, without leading zeros, a row for every year that an item with it has and the years around; of a resolution also with a prefix. Rows of one number lie together."""
    n = F.trim(F.col(number).cast("string"))
    kept = items.where(n.rlike(r"^\d{3,6}$")).select(F.regexp_replace(n, "^0+", "").alias("number"), F.coalesce(F.col(instrument) == resolution, F.lit(False)).alias("r"), F.col(year).cast("int").alias("y")).where("number <> '' and y is not null").distinct()
    years = kept.groupBy("number").agg(F.collect_set("y").alias("all"), F.collect_set(F.when(F.col("r"), F.col("y"))).alias("resolved"))
    wide = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda y: F.sequence(y - around, y + around))))
    each = years.select("number", wide("resolved").alias("resolved"), F.explode(wide("all")).alias("year"))
    forms = F.when(F.array_contains("resolved", F.col("year")), F.array("number", F.concat(F.lit(prefix), "number"))).otherwise(F.array("number"))
    return each.select("number", "year", forms.alias("forms"))


def instrument_keys(items: DataFrame, number: str, instrument: str, year: str, resolution: str = "resolution", prefix: str = "R", around: int = 1) -> DataFrame:
    """(number, form, year): the forms of instrument_forms, a row each."""
    return instrument_forms(items, number, instrument, year, resolution, prefix, around).select("number", F.explode("forms").alias("form"), "year")


def candidates(keys: DataFrame, key: str, variant: str, families: dict[str, tuple[str, bool]], by: str | None = None) -> DataFrame:
    """(key, family, variant, place): keys put into each family's template, whose {x} are columns of keys.

    A family that says so also takes the variant with its last capitals in lower case. Places are given once a key. variant
    may be an array of distinct forms: then keys have one row for a key and the other columns that every template names,
    and nothing is shuffled. by is a column that a key decides and that comes along, before the others.
    """
    many = isinstance(keys.schema[variant].dataType, ArrayType)
    names = r"\{(" + "|".join(map(re.escape, keys.columns)) + r")\}"

    def low(v: Column) -> Column:
        rest = F.rtrim(v, F.lit(CAPITALS))
        return F.concat(rest, F.lower(F.substring(v, F.length(rest) + 1, F.length(v))))

    def filled(family: str, template: str) -> Callable[[Column], Column]:
        # Odd pieces of a template are names of columns.
        pieces = [(i % 2, s) for i, s in enumerate(re.split(names, template)) if s]

        def place(v: Column) -> Column:
            said = [F.lit(s) if not named else v if s == variant else F.coalesce(F.col(s).cast("string"), F.lit("")) for named, s in pieces]
            return F.struct(F.lit(family).alias("family"), v.alias("variant"), F.concat(*said).alias("place"))

        return place

    forms = F.col(variant) if many else F.array(variant)
    lower = F.array_distinct(F.concat(forms, F.transform(forms, low)))
    # One pass over the keys, whatever the number of families.
    each = F.concat(*[F.transform(lower if also else forms, filled(family, template)) for family, (template, also) in families.items()])
    kept = [by] if by else []
    rows = keys.select(*kept, F.col(key).alias("key"), F.explode(each).alias("c")).select(*kept, "key", "c.*")
    return rows if many else rows.distinct()
