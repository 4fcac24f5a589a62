"""Scores of found boundaries against marked ones: dates as sets, positions one to one, and the dates that blocks come to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def islands(gold: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """(doc, date, island, gold, found): sorted places of both sides, cut where a gap is wider than the tolerance.

    Nothing can be matched across such a gap, so islands are independent. Rows with a null in doc, date or place are left out.
    """
    sides = gold.select("doc", "date", "place", F.lit(True).alias("g")).unionByName(found.select("doc", "date", "place", F.lit(False).alias("g"))).where("doc is not null and date is not null and place is not null")
    order = W.partitionBy("doc", "date").orderBy("place", F.desc("g"))
    gap = F.coalesce(F.col("place") - F.lag("place").over(order) > tolerance, F.lit(False)).cast("int")
    cut = sides.withColumn("__gap", gap).withColumn("island", F.sum("__gap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # collect_list leaves nulls out.
    side = lambda is_gold: F.array_sort(F.collect_list(F.when(F.col("g") == is_gold, F.col("place"))))
    return cut.groupBy("doc", "date", "island").agg(side(True).alias("gold"), side(False).alias("found"))


def greedy(gold: Column, found: Column, tolerance: float) -> Column:
    """How many marks of a sorted array, each in turn, find the nearest place not yet taken within the tolerance; of two as near the smaller."""
    start = F.struct(F.lit(0).alias("n"), F.transform(found, lambda p, i: F.struct(p.alias("p"), i.alias("i"))).alias("left"))

    def step(s: Column, g: Column) -> Column:
        best = F.array_min(F.transform(s["left"], lambda x: F.struct(F.abs(x["p"] - g).alias("d"), x["i"].alias("i"))))
        hit = F.coalesce(best["d"] <= tolerance, F.lit(False))
        return F.struct((s["n"] + hit.cast("int")).alias("n"), F.when(hit, F.filter(s["left"], lambda x: x["i"] != best["i"])).otherwise(s["left"]).alias("left"))

    return F.aggregate(gold, start, step)["n"]


def boundary_scores(gold: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """(level, hits, n_gold, n_found, precision, recall) for `date` and `position`.

    gold and found: (doc, date, place). Dates are compared as sets within a document, positions one to one within document
    and date, so that two meetings of one day need two boundaries. Only documents with a mark are scored. Ratios of nothing are null.
    """
    marked = gold.where("doc is not null and date is not null and place is not null")
    seen = found.join(marked.select("doc").distinct(), "doc", "left_semi")
    isl = islands(marked, seen, tolerance)
    per = isl.groupBy("doc", "date").agg(
        F.sum(greedy(F.col("gold"), F.col("found"), tolerance)).alias("hits"), F.sum(F.size("gold")).alias("n_gold"), F.sum(F.size("found")).alias("n_found"),
    )
    both = F.array(
        F.struct(F.lit("date").alias("level"), ((F.col("n_gold") > 0) & (F.col("n_found") > 0)).cast("long").alias("hits"), (F.col("n_gold") > 0).cast("long").alias("g"), (F.col("n_found") > 0).cast("long").alias("f")),
        F.struct(F.lit("position").alias("level"), F.col("hits").cast("long").alias("hits"), F.col("n_gold").cast("long").alias("g"), F.col("n_found").cast("long").alias("f")),
    )
    t = per.select(F.explode(both).alias("x")).groupBy("x.level").agg(F.sum("x.hits").alias("hits"), F.sum("x.g").alias("n_gold"), F.sum("x.f").alias("n_found"))
    return t.withColumn("precision", F.try_divide("hits", "n_found")).withColumn("recall", F.try_divide("hits", "n_gold"))


def block_dates(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (doc, block, place, date) with `want`: the date of the last mark at or before the block, before all marks the first one's.

    Blocks stand in the order of `block`; one without a place has the date wanted of the block before it. Blocks of documents
    without marks want none. One sort of marks and blocks together, no join of pairs.
    """
    g = gold.where("doc is not null and date is not null and place is not null").select("doc", "place", F.col("date").alias("mark"), F.lit(0).alias("b"), F.lit(None).cast(blocks.schema["block"].dataType).alias("block"), F.lit(None).cast(blocks.schema["date"].dataType).alias("date"))
    rows = g.unionByName(blocks.select("doc", "place", F.lit(None).cast(gold.schema["date"].dataType).alias("mark"), F.lit(1).alias("b"), "block", "date"))
    by_place = W.partitionBy("doc").orderBy(F.asc_nulls_first("place"), "b", "mark")
    # The first mark of a document: a frame that goes on to the end would be read anew for every row.
    first = F.min(F.when(F.col("b") == 0, F.struct("place", "mark"))).over(W.partitionBy("doc"))["mark"]
    latest = F.last("mark", ignorenulls=True).over(by_place.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = rows.withColumn("__w", F.when(F.col("place").isNotNull(), F.coalesce(latest, first))).where("b = 1")
    by_block = W.partitionBy("doc").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.select("doc", "block", "place", "date", F.coalesce("__w", F.last("__w", ignorenulls=True).over(by_block)).alias("want"))
