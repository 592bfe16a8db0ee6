"""Planar geometry on rings and lines as arrays of structs (x, y), with higher-order functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.operators.ranges import written


def area(ring: Column) -> Column:
    """Shoelace area; a closing vertex changes nothing; 0 below three vertices."""
    cross = F.aggregate(F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(ring) >= 3, F.abs(cross) / 2).otherwise(0.0)


def centroid(ring: Column) -> Column:
    """Mean of the vertices, a closing one included."""
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    return F.when(F.size(ring) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def length(line: Column) -> Column:
    rest = F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    d = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), rest, lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def midpoint(line: Column) -> Column:
    """The vertex in the middle of a line's vertices (of two the later)."""
    return F.when(F.size(line) > 0, F.get(line, F.floor(F.size(line) / 2).cast("int")))


def endpoints(line: Column) -> Column:
    return F.when(F.size(line) > 0, F.struct(F.get(line, F.lit(0)).alias("first"), F.element_at(line, -1).alias("last")))


#: The GRS80 ellipsoid, scale and false origin of a transverse Mercator zone.
_A, _F, _K0, _EAST = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0


def utm_to_degrees(x: Column, y: Column, central: float = -3.0) -> Column:
    """(lon, lat) in degrees of a point of a northern transverse Mercator zone (30N: ``central`` -3), by Krueger's series."""
    n = _F / (2 - _F)
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (_K0 * a), (x - _EAST) / (_K0 * a)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + central).alias("lon"), F.degrees(lat).alias("lat"))


def to_geojson(ring: Column, central: float = -3.0) -> Column:
    """A ring of a transverse Mercator zone as the text of a GeoJSON polygon in degrees."""
    points = F.transform(ring, lambda p: utm_to_degrees(p["x"], p["y"], central))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(points, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")))


def geojson_centroid(text: Column) -> Column:
    """Mean of the vertices of a GeoJSON polygon's first ring, as x and y."""
    ring = F.from_json(text, "type string, coordinates array<array<array<double>>>")["coordinates"][0]
    return centroid(F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether a ray to the right crosses an odd number of edges."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, turned, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Each point with the first polygon (lowest ordinal) that holds it, or null.

    Polygons are listed in the grid cells of their bounding boxes, so that the join is on a cell, not on
    all pairs. points: pid, x, y; polygons: poly, ordinal, ring.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    c = lambda v: F.floor(v / cell)
    listed = polygons.withColumn("cx", F.explode(F.sequence(c(F.array_min(xs)), c(F.array_max(xs))))).withColumn("cy", F.explode(F.sequence(c(F.array_min(ys)), c(F.array_max(ys)))))
    hits = points.withColumns({"cx": c(F.col("x")), "cy": c(F.col("y"))}).join(listed, ["cx", "cy"]).filter(contains(F.col("ring"), F.col("x"), F.col("y")))
    first = hits.groupBy("pid").agg(F.min_by("poly", "ordinal").alias("poly"))
    return points.join(first, "pid", "left")


#: Targets that share a target's cell, on average, in which a search may start, and how often cells are halved for it at most.
ROOM, HALVINGS = 8, 30


def _cell(v: Column, width: float) -> Column:
    """The number of a cell; cells are a little wider than the distance that they stand for, so that rounding puts no pair too far apart."""
    return F.floor(v / (width * (1 + 2**-20)))


def _nearest_within(spots: DataFrame, marks: DataFrame, width: float) -> DataFrame:
    """x, y, d, tid of the spots with a mark within ``width``.

    Each pair is looked at twice, once for the least distance and once for the least id there, as both are sums of fixed size that are
    kept while pairs pass by; the least pair of both would have all pairs sorted first.
    """
    at = spots.withColumns({"cx": _cell(F.col("x"), width), "cy": _cell(F.col("y"), width)})
    around = marks
    for c, v in (("cx", _cell(F.col("tx"), width)), ("cy", _cell(F.col("ty"), width))):
        around = around.withColumn(c, F.explode(F.sequence(v - 1, v + 1)))
    d = F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))
    least = at.join(around, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= width).groupBy("x", "y").agg(F.min("d").alias("d"))
    again = least.withColumns({"cx": _cell(F.col("x"), width), "cy": _cell(F.col("y"), width)}).join(around, ["cx", "cy"]).filter(d == F.col("d"))
    return again.groupBy("x", "y").agg(F.min("d").alias("d"), F.min("tid").alias("tid"))


def nearest(points: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Each point with its nearest target within ``most`` (ties: least id), by joins on grid cells.

    points: pid, x, y; targets: tid, tx, ty. A place is looked up once for all points there, and the least id stands for all targets at a place.
    The search starts in cells that few targets share; places without a target within the width of a cell go on to cells twice as wide, up to
    ``most``. So the pairs looked at grow with the points, not with their product with the targets, unless many places lie far from any target
    but beside a crowd of them.
    """
    marks = written(targets.groupBy("tx", "ty").agg(F.min("tid").alias("tid")))
    widths = [most]
    while len(widths) <= HALVINGS:
        cells = marks.groupBy(_cell(F.col("tx"), widths[0]), _cell(F.col("ty"), widths[0])).agg(F.count("*").cast("double").alias("n"))
        if (cells.agg(F.sum(F.col("n") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0.0))).first()[0] or 0) <= ROOM:
            break
        widths.insert(0, widths[0] / 2)
    left = points.select("x", "y").filter("x IS NOT NULL AND y IS NOT NULL").distinct()
    found = []
    for width in widths:
        found.append(_nearest_within(left, marks, width))
        if width < most:
            found[-1] = written(found[-1])
            left = written(left.join(found[-1], ["x", "y"], "left_anti"))
            if left.isEmpty():
                break
    best = reduce(DataFrame.unionAll, found)
    return points.join(best, ["x", "y"], "left").select(*points.columns, "tid", F.col("d").alias("distance"))


def within_distance(areas: DataFrame, most: float) -> DataFrame:
    """Pairs of groups whose members come closer than ``most``: group_a < group_b, least distance.

    areas: grp, x, y. Members meet on grid cells of size ``most``.
    """
    c = lambda v: F.floor(v / most)
    a = areas.select(F.col("grp").alias("group_a"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumns({"cx": c(F.col("ax")), "cy": c(F.col("ay"))})
    b = areas.select(F.col("grp").alias("group_b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    b = b.withColumn("cx", F.explode(F.sequence(c(F.col("bx")) - 1, c(F.col("bx")) + 1))).withColumn("cy", F.explode(F.sequence(c(F.col("by")) - 1, c(F.col("by")) + 1)))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return a.join(b, ["cx", "cy"]).filter("group_a < group_b").withColumn("d", d).filter(F.col("d") < most).groupBy("group_a", "group_b").agg(F.min("d").alias("distance"))


def pipe_capacity(diameter: Column, slope: Column) -> Column:
    """Hazen-Williams with C = 120."""
    return 0.2785 * 120 * F.pow(diameter, F.lit(2.63)) * F.pow(F.greatest(slope, F.lit(1e-4)), F.lit(0.54))
