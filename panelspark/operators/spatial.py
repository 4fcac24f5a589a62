"""Points, distances and polygons on plane coordinates; a grid of cells turns distance joins into equi joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import spread

#: Ellipsoid and parallels of the equal-area projection of California (EPSG:3310): semi-major axis, eccentricity squared, parallels, origin and false northing.
ALBERS = {"a": 6378137.0, "e2": 0.00669438002290, "lat1": 34.0, "lat2": 40.5, "lat0": 0.0, "lon0": -120.0, "y0": -4000000.0}


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of a position in degrees."""
    e = math.sqrt(ALBERS["e2"])

    def q_of(s: float) -> float:
        return (1 - ALBERS["e2"]) * (s / (1 - ALBERS["e2"] * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    m2 = lambda lat: math.cos(lat) ** 2 / (1 - ALBERS["e2"] * math.sin(lat) ** 2)
    r1, r2, r0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (m2(r1) - m2(r2)) / (q_of(math.sin(r2)) - q_of(math.sin(r1)))
    c = m2(r1) + n * q_of(math.sin(r1))
    rho0 = ALBERS["a"] * math.sqrt(c - n * q_of(math.sin(r0))) / n
    s = F.sin(F.radians(lat))
    q = (1 - ALBERS["e2"]) * (s / (1 - ALBERS["e2"] * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = ALBERS["a"] * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - ALBERS["lon0"])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta) + ALBERS["y0"]


def in_cells(df: DataFrame, x: str, y: str, size: float, around: bool = False) -> DataFrame:
    """df with `cx`, `cy`: its grid cell, or with `around` a row for each of the nine cells about it."""
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumn("cx", cx).withColumn("cy", cy)
    near = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    return df.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).withColumn("cx", cx + F.col("__dx")).withColumn("cy", cy + F.col("__dy")).drop("__dx", "__dy")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (lid, lx, ly) and right (rid, rx, ry) at most `radius` apart, with `dist`: an equi join on cells of that size.

    A merge join: rows for nine cells about a point look as small as the point's file, and a broadcast of them goes through the driver.
    """
    joined = in_cells(left, "lx", "ly", radius, around=True).join(in_cells(right, "rx", "ry", radius).hint("merge"), ["cx", "cy"])
    dist = F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2)
    return joined.withColumn("dist", dist).where(F.col("dist") <= radius).drop("cx", "cy")


def cell_size(points: DataFrame, x: str, y: str, start: float, most: float, halvings: int) -> float:
    """start, halved until the cell of a mean point holds at most so many points, or as often as that."""
    k = points.select(F.col(x).alias("x"), F.col(y).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(halvings))).alias("k"))
    size = F.lit(float(start)) / F.pow(F.lit(2.0), F.col("k"))
    cells = k.groupBy("k", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.count("*").alias("n"))
    # A row for each halving.
    held = dict(cells.groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).collect())
    return start / 2 ** next((i for i in range(halvings) if held.get(i, 0) <= most), halvings)


def nearest(left: DataFrame, right: DataFrame, start: float, doublings: int = 20) -> DataFrame:
    """(lid, rid, dist): each left point's nearest right point, ties to the smaller rid. Rings of doubling radius; those found drop out.

    Points of one position are one. The first ring is `start` or as much less as the right points stand closer, so that what
    is compared grows with the points; the last is `start` doubled so often.
    """
    spots = right.groupBy("rx", "ry").agg(F.min("rid").alias("rid")).persist()
    asked = spread(left.select("lx", "ly").distinct())
    radius, last = cell_size(spots, "rx", "ry", start, 4, 16), start * 2**doublings
    open_, found = asked, None
    while True:
        met = within(open_, spots, radius).groupBy("lx", "ly").agg(F.min(F.struct("dist", "rid")).alias("b"))
        best = met.select("lx", "ly", "b.rid", "b.dist").persist()
        found = best if found is None else found.unionByName(best)
        if radius >= last:
            break
        open_ = open_.join(best.select("lx", "ly").hint("merge"), ["lx", "ly"], "left_anti")
        if open_.isEmpty():
            break
        radius = min(radius * 2, last)
    return left.join(found.hint("merge"), ["lx", "ly"]).groupBy("lid").agg(F.min(F.struct("dist", "rid")).alias("b")).select("lid", "b.rid", "b.dist")


def counted_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(lid, n, least): how many right points are at most `radius` from each left one, and how far the nearest is; left points without any have no row.

    Points of one position are one with a count. Cells whose boxes lie wholly within the radius of each other give their
    counts, and only cells on the border of it compare points; the closer points stand, the smaller the cells. All joins are
    merge joins: a cell has hundreds of rows about it, and none of them may be broadcast through the driver.
    """
    spots = right.groupBy("rx", "ry").agg(F.count("*").alias("k")).persist()
    size = cell_size(spots, "rx", "ry", radius, 32, 3)
    steps = round(radius / size) + 1
    asked = left.select("lx", "ly").distinct()
    l, r = in_cells(asked, "lx", "ly", size), in_cells(spots, "rx", "ry", size).withColumnsRenamed({"cx": "rcx", "cy": "rcy"})
    box = lambda df, side: [f(f"{side}{c}").alias(f"{side}{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
    around = lambda c: F.explode(F.sequence(F.col(c) - steps, F.col(c) + steps))
    left_boxes = spread(l.groupBy("cx", "cy").agg(*box(l, "l"))).withColumn("rcx", around("cx")).withColumn("rcy", around("cy"))
    pairs = left_boxes.join(r.groupBy("rcx", "rcy").agg(*box(r, "r"), F.sum("k").alias("k")).hint("merge"), ["rcx", "rcy"])
    gap = lambda c: F.greatest(F.col(f"r{c}0") - F.col(f"l{c}1"), F.col(f"l{c}0") - F.col(f"r{c}1"), F.lit(0.0))
    span = lambda c: F.greatest(F.col(f"r{c}1") - F.col(f"l{c}0"), F.col(f"l{c}1") - F.col(f"r{c}0"))
    # A margin far above rounding: cells in doubt compare their points.
    whole = F.sqrt(span("x") ** 2 + span("y") ** 2) <= radius * (1 - 1e-9)
    pairs = pairs.where(F.sqrt(gap("x") ** 2 + gap("y") ** 2) <= radius * (1 + 1e-9)).select("cx", "cy", "rcx", "rcy", "k", whole.alias("whole"))
    inner = l.join(pairs.where("whole").groupBy("cx", "cy").agg(F.sum("k").alias("k")).hint("merge"), ["cx", "cy"]).select("lx", "ly", "k")
    border = l.join(pairs.where("not whole").drop("k").hint("merge"), ["cx", "cy"]).select("lx", "ly", "rcx", "rcy")
    n = border.sparkSession.sparkContext.defaultParallelism * 8
    met = border.repartition(n, "rcx", "rcy").join(r.repartition(n, "rcx", "rcy").hint("merge"), ["rcx", "rcy"])
    met = met.where(F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2) <= radius).groupBy("lx", "ly").agg(F.sum("k").alias("k"))
    counts = inner.unionByName(met).groupBy("lx", "ly").agg(F.sum("k").alias("n"))
    least = nearest(asked.select(F.struct("lx", "ly").alias("lid"), "lx", "ly"), spots.select(F.lit(0).alias("rid"), "rx", "ry"), radius, 0)
    return left.join(counts.hint("merge"), ["lx", "ly"]).join(least.select("lid.*", F.col("dist").alias("least")).hint("merge"), ["lx", "ly"]).groupBy("lid").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point is in a ring, array<struct<x,y>> without a closing point."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossing = F.zip_with(ring, after, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.aggregate(crossing, F.lit(False), lambda acc, c: acc != c)


def ring_area(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, c: s + c)) / 2


def parse_ring(wkt: Column) -> Column:
    """The outer ring of a POLYGON text, closing point left out."""
    body = F.split(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1), r"\s*,\s*")
    points = F.transform(body, lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))
    return F.slice(points, 1, F.size(points) - 1)


def rings_of_wkt(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON text, closing points left out: array<array<struct<x,y>>>."""
    listed = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring(body: Column) -> Column:
        points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))
        return F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(1)))

    return F.transform(listed, ring)


def rings_of_geojson(text: Column) -> Column:
    """All rings of a GeoJSON geometry, Polygon or MultiPolygon, closing points left out."""
    polygon = F.from_json(text, "struct<coordinates:array<array<array<double>>>>")["coordinates"]
    multi = F.flatten(F.from_json(text, "struct<coordinates:array<array<array<array<double>>>>>")["coordinates"])
    rings = F.when(F.get_json_object(text, "$.type") == "MultiPolygon", multi).otherwise(polygon)
    return F.transform(rings, lambda r: F.slice(F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))), 1, F.greatest(F.size(r) - 1, F.lit(1))))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """One ring, counter-clockwise, as rings."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is in a polygon by the even-odd rule: holes and several parts are rings too."""
    return F.aggregate(rings, F.lit(False), lambda acc, r: acc != inside(x, y, r))


def polygon_cells(layer: DataFrame, rings: str, size: float) -> DataFrame:
    """A row for each grid cell that the polygon's bounding box touches: cx, cy."""
    points = F.flatten(F.col(rings))
    span = lambda axis: F.sequence(F.floor(F.array_min(F.transform(points, lambda p: p[axis])) / size), F.floor(F.array_max(F.transform(points, lambda p: p[axis])) / size))
    return layer.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def layer_join(points: DataFrame, layer: DataFrame, size: float) -> DataFrame:
    """Points (pid, px, py) with every polygon (gid, rings) they lie in: an equi join on cells, then ray casting; unmatched points keep a null gid."""
    cells = polygon_cells(layer.select("gid", "rings"), "rings", size)
    met = in_cells(points, "px", "py", size).join(cells, ["cx", "cy"]).where(inside_rings(F.col("px"), F.col("py"), F.col("rings"))).select("pid", "gid")
    return points.join(met, "pid", "left")


def clipped(subject: Column, convex: Column) -> Column:
    """The part of a ring within a convex counter-clockwise ring: each of its edges cuts off what lies to its right."""
    after = F.concat(F.slice(convex, 2, F.size(convex)), F.slice(convex, 1, 1))
    edges = F.zip_with(convex, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    side = lambda p, e: (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])

    def cut(ring: Column, e: Column) -> Column:
        before = F.concat(F.slice(ring, F.greatest(F.size(ring), F.lit(1)), 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))

        def step(p: Column, q: Column) -> Column:
            sp, sq = side(p, e), side(q, e)
            t = sp / (sp - sq)
            crossing = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            return F.when((sp >= 0) & (sq >= 0), F.array(q)).when((sp >= 0) & (sq < 0), F.array(crossing)).when((sp < 0) & (sq >= 0), F.array(crossing, q)).otherwise(F.slice(F.array(q), 1, 0))

        return F.flatten(F.zip_with(before, ring, step))

    return F.aggregate(edges, subject, cut)


def ring_weights(rings: Column) -> Column:
    """1 for each ring that bounds ground from outside, -1 for each hole: a ring within an odd number of the others is a hole."""
    # A place near the middle of the first edge: corners of a hole may touch the ring about it.
    probe = lambda r: F.struct((r[0]["x"] * 0.5371 + r[1]["x"] * 0.4629).alias("x"), (r[0]["y"] * 0.5371 + r[1]["y"] * 0.4629).alias("y"))
    about = lambda r, i: F.aggregate(F.transform(rings, lambda o, j: (i != j) & inside(probe(r)["x"], probe(r)["y"], o)), F.lit(0), lambda n, c: n + c.cast("int"))
    return F.transform(rings, lambda r, i: F.when(F.size(r) < 3, 0).when(about(r, i) % 2 == 0, 1).otherwise(-1))


def rings_area(rings: Column) -> Column:
    """Area of a polygon of several parts with holes."""
    signed = F.zip_with(F.transform(rings, ring_area), ring_weights(rings), lambda area, w: area * w)
    return F.aggregate(signed, F.lit(0.0), lambda s, a: s + a)


def edges(layer: DataFrame, key: str, rings: str, width: float) -> DataFrame:
    """(key, slab, x0, y0, x1, y1, sign): the edges of all rings from left to right, cut at the slabs of so wide a strip.

    The ground under an edge counts with its sign: over all edges of a polygon, what is inside counts once and all else 0
    times, whichever way its rings run. Edges that stand upright have no ground under them.
    """
    after = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    turn = lambda r: F.signum(F.aggregate(F.zip_with(r, after(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, c: s + c))
    signed = F.zip_with(F.col(rings), ring_weights(F.col(rings)), lambda r, w: F.struct(r.alias("r"), (w * turn(r)).alias("s")))
    each = layer.withColumn("__r", F.explode(signed))
    each = each.select(key, F.col("__r.s").alias("__s"), F.explode(F.zip_with(F.col("__r.r"), after(F.col("__r.r")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    left, right = F.when(a["x"] < b["x"], a).otherwise(b), F.when(a["x"] < b["x"], b).otherwise(a)
    # Over the ground, a ring that runs counter-clockwise goes from right to left.
    line = each.where("e.a.x <> e.b.x").select(key, left.alias("l"), right.alias("r"), F.when(a["x"] > b["x"], F.col("__s")).otherwise(-F.col("__s")).alias("sign"))
    cut = line.withColumn("slab", F.explode(F.sequence(F.floor(F.col("l.x") / width), F.floor(F.col("r.x") / width))))
    x0, x1 = F.greatest("l.x", F.col("slab") * F.lit(width)), F.least("r.x", (F.col("slab") + 1) * F.lit(width))
    at = lambda x: F.col("l.y") + (F.col("r.y") - F.col("l.y")) * (x - F.col("l.x")) / (F.col("r.x") - F.col("l.x"))
    return cut.select(key, "slab", x0.alias("x0"), at(x0).alias("y0"), x1.alias("x1"), at(x1).alias("y1"), "sign").where("x1 > x0")


def overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(lid, rid, area) of polygons (lid, rings) and (rid, rings) that share ground, whatever their rings: concave, in parts, with holes.

    Pairs meet in grid cells of their bounding boxes, each once. The ground of both is the sum, over an edge of either, of
    the ground under both edges with their signs: an equi join on pair and slab and one aggregation, so a polygon of many
    corners is many rows and never one value. Shared ground below a billionth of the smaller box is rounding.
    """
    axis = lambda rings, c: F.transform(F.flatten(rings), lambda p: p[c])
    box = lambda rings: F.struct(*[f(axis(rings, c)).alias(n) for n, f, c in (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))])
    a = polygon_cells(left.select("lid", F.col("rings").alias("lr")), "lr", size).select("lid", "cx", "cy", box(F.col("lr")).alias("a"))
    b = polygon_cells(right.select("rid", F.col("rings").alias("rr")), "rr", size).select("rid", "cx", "cy", box(F.col("rr")).alias("b"))
    # The pair belongs to the first cell of the boxes' common ground, so none has to be told from another.
    home = (F.col("cx") == F.floor(F.greatest("a.x0", "b.x0") / size)) & (F.col("cy") == F.floor(F.greatest("a.y0", "b.y0") / size))
    met = a.join(b, ["cx", "cy"]).where(home & (F.least("a.x1", "b.x1") > F.greatest("a.x0", "b.x0")) & (F.least("a.y1", "b.y1") > F.greatest("a.y0", "b.y0")))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    pairs = met.select("lid", "rid", F.least("a.y0", "b.y0").alias("base"), (F.least(area(F.col("a")), area(F.col("b"))) * 1e-9).alias("least"))
    of_left = edges(left.select("lid", "rings"), "lid", "rings", size)
    of_right = edges(right.select("rid", "rings"), "rid", "rings", size).select("rid", "slab", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1", "sign")])
    both = pairs.join(of_left, "lid").join(of_right, ["rid", "slab"]).where("x1 > r_x0 and r_x1 > x0")
    found = both.groupBy("lid", "rid", "least").agg(F.sum(F.col("sign") * F.col("r_sign") * _under_both()).alias("area"))
    return found.where("area > least").select("lid", "rid", "area")


def _under_both() -> Column:
    """Ground between base and the lower of two edges over the stretch that they share: one trapezoid, or two where they cross."""
    a, b = F.greatest("x0", "r_x0"), F.least("x1", "r_x1")
    at = lambda x, p: F.col(f"{p}y0") + (F.col(f"{p}y1") - F.col(f"{p}y0")) * (x - F.col(f"{p}x0")) / (F.col(f"{p}x1") - F.col(f"{p}x0"))
    la, lb, ra, rb = at(a, ""), at(b, ""), at(a, "r_"), at(b, "r_")
    low_a, low_b = F.least(la, ra) - F.col("base"), F.least(lb, rb) - F.col("base")
    # Where they cross, the lower of both bulges above the straight line between its ends.
    da, db = la - ra, lb - rb
    t = da / (da - db)
    middle = la + t * (lb - la) - F.col("base")
    crossed = (low_a + middle) / 2 * t + (middle + low_b) / 2 * (1 - t)
    return (b - a) * F.when(da * db < 0, crossed).otherwise((low_a + low_b) / 2)


def crosswalk(parts: DataFrame, layer: DataFrame, size: float) -> DataFrame:
    """(lid, rid, area, weight): how each polygon of parts is shared among a layer's, weights being parts of its own area; a row of null rid
    takes what no polygon of the layer covers, so weights sum to 1 where the layer does not overlap itself, and to more where it does."""
    whole = parts.select("lid", rings_area(F.col("rings")).alias("whole"))
    shared = overlaps(parts, layer, size)
    rest = whole.join(shared.groupBy("lid").agg(F.sum("area").alias("taken")), "lid", "left").select("lid", F.lit(None).cast(layer.schema["rid"].dataType).alias("rid"), F.greatest(F.col("whole") - F.coalesce("taken", F.lit(0.0)), F.lit(0.0)).alias("area"), "whole")
    return shared.join(whole, "lid").unionByName(rest.where("area > whole * 1e-9")).withColumn("weight", F.col("area") / F.nullif("whole", F.lit(0.0))).drop("whole")


def largest_overlap(shares: DataFrame) -> DataFrame:
    """(lid, rid): of each left polygon the right one that it shares most area with, ties to the smaller rid."""
    return shares.groupBy("lid").agg(F.min_by("rid", F.struct(-F.round("area", 9), "rid")).alias("rid"))
