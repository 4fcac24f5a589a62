"""Mixing sources to target weights by the cube method.

Every document of a source is to be taken target / source size times on average. The whole part of that is taken as it
is; the fractional part is an inclusion probability, and the cube method rounds all of them to 0 or 1 while it holds the
total of words and the number of documents: it moves the probabilities of three undecided documents along the one
direction that changes neither total, until one of the three is decided. It moves either way, as often as keeps every
document's probability, by a number hashed from its key: reruns agree. A block of documents ends with two undecided ones
at most. Those of all blocks meet again in as many blocks as they need until a source has one, which lands: its small
documents make up for what its large ones leave over, and end nearest to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import discard, materialize, mix64, word_counts

#: Weights of the sources in order, repeated, and how often a document may be taken.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: Documents of a block, about: a hot source is dealt to as many blocks as it needs.
BLOCK = 4_000
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(word_counts(batch.column(0)))], names=["doc", "source", "said", "size"])


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, words, ...) with target: all words shared by weight, none above `most` times its own, the excess shared again.

    Sources stop in the order of what they can take for their weight, so the share of a weight follows from sums over those
    that have stopped before: the first source that does not stop at its share tells that of all others. One row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))).withColumn("limit", F.col("words") * float(most))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = lambda total, stopped: total - F.coalesce(F.sum(stopped).over(before), F.lit(0.0))
    every = weighed.agg(F.sum("words").cast("double").alias("all_words"), F.sum("weight").alias("all_weight"))
    shared = weighed.crossJoin(F.broadcast(every)).withColumn("share", left(F.col("all_words"), F.col("limit")) / left(F.col("all_weight"), F.col("weight")))
    level = shared.where(F.col("limit") >= F.col("share") * F.col("weight")).agg(F.min_by("share", F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")).alias("level"))
    out = shared.crossJoin(F.broadcast(level))
    return out.withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))).select(*sizes.columns, "target")


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray, documents: bool = True) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for two at most, sum(p) and sum(p * size) held; units are taken in their order.

    Of the two moves that end at a decision, the one that `draw` (even in 0 to 1, a number a unit) picks: each as likely as
    the other is long, so every unit is taken as often as its probability says. Without `documents` only sum(p * size) is
    held, and one unit is left at most.
    """
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    held: list[int] = []
    for unit in range(len(p)):
        if not 0.0 < p[unit] < 1.0:
            continue
        held.append(unit)
        if len(held) < 2 + documents:
            continue
        if documents:
            i, j, k = held
            u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)  # equal sizes: any exchange holds both totals
        else:
            i, j = held
            u = (size[j], -size[i])
        up = down = np.inf
        for x, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, -p[x] / d), min(down, -(1 - p[x]) / d)
        step = up if draw[unit] * (up + down) < down else -down
        for x, d in zip(held, u, strict=True):
            p[x] = min(1.0, max(0.0, p[x] + step * d))
            if p[x] < 1e-12:
                p[x] = 0.0
            elif p[x] > 1 - 1e-12:
                p[x] = 1.0
        held = [x for x in held if 0.0 < p[x] < 1.0]
    return np.array(p)


def _land(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The last block, sizes descending. What the large units leave undecided is drawn; what that takes too many or too few
    in words is taken from the probabilities of the small ones, which hold eight times the largest size or half of all;
    these fly for the words alone, and the last one is rounded to what is nearest. Where large units took too much or too
    little for the small ones to mend, units are exchanged while that brings the words nearer."""
    p = p.astype(float)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    up = np.cumsum(size[open_][::-1])
    small = open_[len(open_) - 1 - int(np.searchsorted(up, min(8 * size[open_].max(), up[-1] / 2))) :]
    large = np.setdiff1d(open_, small)
    want = (p * size).sum()
    p[large] = flight(p[large], size[large], draw[large])
    rest = large[(p[large] > 0) & (p[large] < 1)]
    p[rest] = (draw[rest] < p[rest]).astype(float)
    for _ in range(50):
        free = small[(p[small] > 0) & (p[small] < 1)]
        over = (p * size).sum() - want
        if abs(over) < 1e-6 or not len(free):
            break
        p[free] = (p[free] - over / size[free].sum()).clip(0, 1)
    p[small] = flight(p[small], size[small], draw[small], documents=False)
    for x in np.flatnonzero((p > 0) & (p < 1)):
        others = (p * size).sum() - p[x] * size[x]
        p[x] = float(abs(others + size[x] - want) < abs(others - want))
    while _exchange(p, size, open_, (p * size).sum() - want):
        pass
    return p


def _exchange(p: np.ndarray, size: np.ndarray, among: np.ndarray, over: float) -> bool:
    """Of the units that landed, one that is taken for one that is not, or for none, or one more, whichever brings the words
    nearest to what was wanted. False where that is nearer by less than a word."""
    # Place -1 is no unit, of size 0.
    taken, left = np.append(among[p[among] == 1], -1), np.append(among[p[among] == 0], -1)
    words = np.append(size, 0.0)
    left = left[np.argsort(words[left], kind="stable")]
    at = np.searchsorted(words[left], words[taken] - over)
    best = (abs(over) - 1, -1, -1)
    for near in (np.clip(at - 1, 0, len(left) - 1), np.clip(at, 0, len(left) - 1)):
        rest = np.abs(over - words[taken] + words[left[near]])
        i = int(rest.argmin())
        best = min(best, (float(rest[i]), int(taken[i]), int(left[near[i]])))
    for unit, to in ((best[1], 0.0), (best[2], 1.0)):
        if unit >= 0:
            p[unit] = to
    return best[1:] != (-1, -1)


def _round(number: int):
    """A block of (doc, source, size, p, mark, blocks) -> the same with p moved. The largest documents come first; a source's only block lands."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("size", "descending"), ("mark", "ascending"), ("doc", "ascending")]))
        size, mark = table.column("size").to_numpy(), table.column("mark").to_numpy()
        draw = (mix64(mark.view(np.uint64) + np.uint64(number)) >> np.uint64(11)).astype(float) / 2.0**53
        p = table.column("p").to_numpy()
        p = _land(p, size, draw) if table.num_rows and table.column("blocks")[0].as_py() <= 1 else flight(p, size, draw)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS) -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target, times, taken.

    size is the number of words (null text: 0), target the words wanted of the row's source, times how often the row is
    taken, taken = times * size. Rows of size 0 and of sources without words are not taken. A null source is a source,
    the last; a null key is a key; repeated rows are rows of their own, decided in the order of a hash of their
    key and text; rows of one key and text are drawn alike.
    Reruns agree. Empty tables give empty results; other columns play no part.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("said"))
    sized = materialize(rows.mapInArrow(_sizes, f"doc {kind}, source string, said long, size long"), "mix-sizes")
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), weights)
    # Whole times and the number of documents, one row a source.
    sources = materialize(totals.select("source", F.col("words").alias("source_size"), "target", F.coalesce(F.floor(F.col("target") / F.nullif("words", F.lit(0))), F.lit(0)).cast("long").alias("whole"), "docs"), "mix-sources")

    def of(df: DataFrame, per_source: DataFrame) -> DataFrame:
        return df.join(per_source.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    joined = of(sized, sources)
    counts = (F.col("size") > 0) & (F.col("source_size") > 0)
    marked = joined.withColumn("p", F.when(counts, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0)).withColumn("mark", F.xxhash64("doc", "size", "said"))
    state, left = marked.select("doc", "source", "size", "p", "mark"), sources.select("source", F.col("docs").alias("left"))
    schema = f"doc {kind}, source string, size long, p double, mark long, blocks long, block long"
    decided, made, number = [], [sized, sources], 0
    while True:
        dealt = of(state, left.select("source", F.greatest(F.ceil(F.col("left") / F.lit(BLOCK)), F.lit(1)).cast("long").alias("blocks")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(number)), "blocks"))
        moved = materialize(dealt.select("doc", "source", "size", "p", "mark", "blocks", "block").groupBy("source", "block").applyInArrow(_round(number), schema), "mix-round")
        made.append(moved)
        still = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(moved.where(~still))
        state = moved.where(still).select("doc", "source", "size", "p", "mark")
        if state.isEmpty():
            break
        # Two of each block at most are left; they meet in as many blocks as they now need.
        left = state.groupBy("source").agg(F.count("*").alias("left"))
        number += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = of(out, sources)
    times = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.least(F.col("whole") + F.round("p").cast("long"), F.lit(MOST_TIMES))).otherwise(0).cast("long")
    result = out.select(F.col("doc").alias(key), F.col("source"), "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
    result = materialize(result, "mix-out")
    for x in made:
        discard(x)
    return result
