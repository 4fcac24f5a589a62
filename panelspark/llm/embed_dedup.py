"""Exact near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned so that the leading coordinates hold most of the variance. Two unit vectors of cosine t lie within
sqrt(2 - 2t) of each other, so each pair that links lies in the same or neighbouring cells of a grid of that width over
the three leading coordinates; a vector goes to its own cell and to those of half of the neighbours that it is that near
to. Vectors of one label and length meet alone. A cell is compared in tiles of bounded size. A tile pair adds up products of the leading
coordinates block by block, bounds the rest by the norms of what is left, and drops every pair that cannot reach the
threshold; it stops when none is left. Survivors are measured on the original vectors.

Equal vectors are one vector with a weight. A tile pair returns counts and a spanning forest of its links, never the
links themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import connected_components, discard, materialize

#: Rows of a tile, about, and leading coordinates added before pairs are dropped again.
TILE, STEP = 1500, 8
#: Doubt left to rounding where sums of turned coordinates are compared with the threshold.
SLACK = 1e-9


def unit_rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows that hold vectors: not null, empty or zero, without null or non-finite components, of `width` components (that of most rows where it isn't given)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    valid = np.array(column.is_valid()) & (lengths > 0)
    flat = column.values.cast(pa.float64())
    flat = (flat.fill_null(np.nan) if flat.null_count else flat).to_numpy()
    if width is not None:
        valid &= lengths == width
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros((0, width or 0))
    starts = column.offsets.to_numpy()[:-1]
    places = np.flatnonzero(valid)
    width = width or np.bincount(lengths[places]).argmax()
    places = places[lengths[places] == width]
    rows = flat[starts[places][:, None] + np.arange(width)]
    good = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return places[good], rows[good]


def normalised(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def lengths_of(column: pa.Array) -> list[int]:
    """The different lengths of a column's vectors, 0 aside."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = np.unique(np.diff(column.offsets.to_numpy())[np.array(column.is_valid())])
    return found[found > 0].tolist()


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of coordinates over the partition, as rows (width, cell, value), for each length of vectors."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for width in lengths_of(batch.column(0)):
            _, rows = unit_rows(batch.column(0), width)
            u = normalised(rows)
            total[width] = total.get(width, 0) + (u.T @ u).ravel()
    for width, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), width)), pa.array(np.arange(len(sums))), pa.array(sums)], names=["width", "cell", "value"])


def principal_axes(df: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """For each length of vectors, columns: directions of the most variance first. What reaches the driver is one number for each pair of coordinates of a length."""
    sums = df.select(vector).mapInArrow(_moments, "width long, cell long, value double").groupBy("width", "cell").agg(F.sum("value").alias("value")).toArrow()
    width, cell, value = (sums.column(c).to_numpy() for c in ("width", "cell", "value"))
    axes = {}
    for w in np.unique(width).tolist():
        moments = np.zeros(w * w)
        moments[cell[width == w]] = value[width == w]
        axes[w] = np.linalg.eigh(moments.reshape(w, w))[1][:, ::-1]
    return axes


#: Leading coordinates that make the grid.
DIMENSIONS = 3
#: Half of the neighbours of a cell: each pair of cells once.
NEAR = [c for c in itertools.product((-1, 0, 1), repeat=DIMENSIONS) if c > (0,) * DIMENSIONS]


def _place(axes: dict[int, np.ndarray], width: float):
    """(group, id, weight, vector) -> a row for its own cell, named by the vectors' length and place, and one for each cell it must be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in lengths_of(batch.column(3)):
                at, rows = unit_rows(batch.column(3), size)
                if not len(at):
                    continue
                turned = np.zeros((len(at), DIMENSIONS))
                led = normalised(rows) @ axes[size][:, :DIMENSIONS]
                turned[:, : led.shape[1]] = led
                cell = np.floor(turned / width).astype(np.int64)
                take = batch.take(pa.array(at))
                # Only neighbours that a vector is near enough to: within the width of the border that they share.
                inner = turned / width - cell
                for step in ((0,) * DIMENSIONS, *NEAR):
                    gap = np.where(np.array(step) > 0, 1 - inner, np.where(np.array(step) < 0, inner, 0))
                    near = np.flatnonzero((gap * gap).sum(1) <= 1 + 1e-9)
                    x = cell[near] + np.array(step)
                    name = x @ (np.int64(1) << np.arange(0, 20 * DIMENSIONS, 20))
                    some = take.take(pa.array(near))
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(np.full(len(near), size, np.int32)), pa.array(name), pa.array(np.full(len(near), not any(step))), some.column(3)], names=["grp", "id", "weight", "size", "cell", "home", "vector"])

    return run


def reaching(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of turned unit vectors whose product may reach the threshold, leading coordinates first."""
    width = a.shape[1]
    rest = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], 1)[:, ::-1]))
    rest_a, rest_b = rest(a), rest(b)
    step = min(STEP, width)
    sums = a[:, :step] @ b[:, :step].T
    bound = sums + (np.outer(rest_a[:, step], rest_b[:, step]) if step < width else 0)
    i, j = np.nonzero(bound >= threshold - SLACK)
    sums = sums[i, j]
    while len(i) and step < width:
        upto = min(step + STEP, width)
        sums = sums + np.einsum("ij,ij->i", a[i, step:upto], b[j, step:upto])
        left = sums + (rest_a[i, upto] * rest_b[j, upto] if upto < width else 0) >= threshold - SLACK
        i, j, sums, step = i[left], j[left], sums[left], upto
    return i, j


def _cosine_links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs link, by the original vectors."""
    dot = np.einsum("ij,ij->i", a[i], b[j])
    norms = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    return dot / (norms[0][i] * norms[1][j]) >= threshold


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(axes: dict[int, np.ndarray], threshold: float):
    """A tile pair -> rows (0, id, n) links of a vector and (1, id, other) edges of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        side = table.column("left").to_numpy()
        same = bool(table.column("same")[0].as_py())
        ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
        _, rows = unit_rows(table.column("vector"))
        turned = normalised(rows) @ axes[rows.shape[1]]
        a = np.flatnonzero(side)
        b = a if same else np.flatnonzero(~side)
        i, j = [], []
        for lo in range(0, len(a), TILE):  # a tile is of this size about, and compared piece by piece where it is larger
            for low in range(lo if same else 0, len(b), TILE):
                x, y = reaching(turned[a[lo : lo + TILE]], turned[b[low : low + TILE]], threshold)
                x, y = a[x + lo], b[y + low]
                good = x < y if same else np.ones(len(x), bool)
                x, y = x[good], y[good]
                good = _cosine_links(rows, rows, x, y, threshold)
                i.append(x[good])
                j.append(y[good])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
        n = np.bincount(i, weights[j], len(ids)).astype(np.int64) + np.bincount(j, weights[i], len(ids)).astype(np.int64)
        label = _forest(len(ids), i, j)
        counted, joined = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"kind": np.r_[np.zeros(len(counted), np.int32), np.ones(len(joined), np.int32)], "a": np.r_[ids[counted], ids[joined]], "b": np.r_[n[counted], ids[label[joined]]]})

    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row for each row of df: key, n_links, component_id, kept.

    Rows link when their groups are equal and not null and their cosine, in double precision, is at least the threshold.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows of null key or group, link with
    nothing. Repeated rows of one key are rows of their own that link with each other; ties go to the smallest key.
    Vectors of different lengths do not link. Other columns play no part. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(group).alias("grp"), F.col(vector).alias("vector"))
    valid = rows.where("id is not null and grp is not null and vector is not null")
    axes = principal_axes(valid, "vector")
    if not axes:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    heads = materialize(valid.groupBy("grp", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "embed-heads")
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    kind = df.schema[group].dataType.simpleString()
    placed = materialize(heads.select("grp", "id", "weight", "vector").mapInArrow(_place(axes, width), f"grp {kind}, id long, weight long, size int, cell long, home boolean, vector {df.schema[vector].dataType.simpleString()}"), "embed-placed")
    sizes = placed.groupBy("grp", "size", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0 and homes + guests > 1")
    tiles = sizes.select("grp", "size", "cell", F.ceil(F.col("homes") / TILE).cast("int").alias("th"), F.ceil(F.col("guests") / TILE).cast("int").alias("tg"))
    dealt = placed.join(tiles, ["grp", "size", "cell"]).withColumn("tile", F.when(F.col("home"), F.pmod(F.xxhash64("id"), "th")).otherwise(F.pmod(F.xxhash64("id"), "tg")).cast("int"))
    # A home tile meets itself and every later home tile, and every guest tile of its cell.
    as_left = F.concat(
        F.transform(F.sequence(F.col("tile"), F.col("th") - 1), lambda t: F.struct(F.col("tile").alias("i"), t.alias("j"), F.lit(False).alias("guest"), F.lit(True).alias("left"))),
        F.when(F.col("tg") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("tg") - 1, F.lit(0))), lambda t: F.struct(F.col("tile").alias("i"), t.alias("j"), F.lit(True).alias("guest"), F.lit(True).alias("left")))).otherwise(F.expr("array()")),
    )
    as_right = F.when(F.col("tile") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("tile") - 1, F.lit(0))), lambda t: F.struct(t.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("guest"), F.lit(False).alias("left")))).otherwise(F.expr("array()"))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("th") - 1), lambda t: F.struct(t.alias("i"), F.col("tile").alias("j"), F.lit(True).alias("guest"), F.lit(False).alias("left")))
    blocks = dealt.select("grp", "size", "cell", "id", "weight", "vector", F.explode(F.when(F.col("home"), F.concat(as_left, as_right)).otherwise(as_guest)).alias("at"))
    blocks = blocks.select("grp", "size", "cell", "at.*", "id", "weight", "vector").withColumn("same", F.expr("not guest and i = j"))
    found = materialize(blocks.groupBy("grp", "size", "cell", "i", "j", "guest").applyInArrow(_compare(axes, threshold), "kind int, a long, b long"), "embed-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("head")).agg(F.sum("b").alias("others"))
    comps = connected_components(found.where("kind = 1").select("a", "b"), "embed-cc")
    classes = heads.join(counts, heads["id"] == counts["head"], "left").join(comps, heads["id"] == comps["node"], "left")
    classes = classes.select("grp", "vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), F.lit(True).alias("usable"))
    good = _usable(F.col("vector"))
    out = rows.withColumn("good", F.coalesce(good, F.lit(False)) & F.col("id").isNotNull()).join(classes, ["grp", "vector"], "left")
    linked = F.col("good") & F.col("usable")
    component = F.when(linked, F.col("component")).otherwise(F.col("id"))
    result = materialize(out.select(F.col("id").alias(key), F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")), "embed-out")
    for x in (heads, placed, found):
        discard(x)
    return result


def _usable(vector):
    """Not zero and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
