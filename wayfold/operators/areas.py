"""Areas: which polygon holds a point or the parts of a line, and what was ridden in each.

Polygons come as edges (area, ax, ay, bx, by), outer rings and holes alike. They are dealt to grid cells once: a cell of
an area knows whether its lower right corner is inside and which edges touch it. A point then meets the edges of its own
cell only: it goes along the row to the cell's right side and down to the corner, and every edge it crosses on the way
turns the corner's answer round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo


def _across(a: str, b: str, at: Column) -> Column:
    """An edge goes from one side of a row or column to the other (an end on it counts as below)."""
    return (F.col(a) > at) != (F.col(b) > at)


def _x_at(y: Column) -> Column:
    return F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.when(F.col("by") != F.col("ay"), F.col("by") - F.col("ay"))


def _y_at(x: Column) -> Column:
    return F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / F.when(F.col("bx") != F.col("ax"), F.col("bx") - F.col("ax"))


def _cell(c, size) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def _span(low: Column, high: Column, size) -> Column:
    return F.explode(F.sequence(_cell(low, size), _cell(high, size)))


def edge_cells(rings: DataFrame, size) -> DataFrame:
    """The edges with the cells (cx, cy) of their bounding boxes; a border between two cells belongs to the left one as well."""
    left = F.ceil(F.least("ax", "bx") / size) - 1
    wide = rings.withColumn("cx", F.explode(F.sequence(left, F.greatest(left, _cell(F.greatest("ax", "bx"), size)))))
    return wide.withColumn("cy", _span(F.least("ay", "by"), F.greatest("ay", "by"), size))


def area_cells(rings: DataFrame, size) -> DataFrame:
    """area, cx, cy, corner: the cells of each area's box, and whether the lower right corner of the cell is inside.

    Each row of cells is crossed once: an edge that crosses the row's lower border turns round the corners left of it.
    """
    box = rings.groupBy("area").agg(*[f(F.least(f"a{c}", f"b{c}") if f is F.min else F.greatest(f"a{c}", f"b{c}")).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))])
    rows = box.withColumn("cy", _span(F.col("lowy"), F.col("highy"), size)).withColumn("low", _cell("lowx", size)).withColumn("high", _cell("highx", size)).select("area", "cy", "low", "high")
    borders = rings.withColumn("cy", _span(F.least("ay", "by"), F.greatest("ay", "by"), size)).withColumn("y", F.col("cy") * F.lit(float(size)))
    hits = borders.filter(_across("ay", "by", F.col("y"))).select("area", "cy", _x_at(F.col("y")).alias("hit")).groupBy("area", "cy").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    cells = rows.join(hits, ["area", "cy"], "left").withColumn("cx", F.explode(F.sequence("low", "high")))
    right = F.expr(f"size(filter(coalesce(hits, array()), h -> h > (cx + 1) * {float(size)}D))")
    return cells.select("area", "cx", "cy", (right % 2 == 1).alias("corner"))


def inside(points: DataFrame, rings: DataFrame, size, id_col: str = "point") -> DataFrame:
    """id, area of all points (id, x, y) in polygons, borders included."""
    at = points.select(F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("cx", _cell("x", size)).withColumn("cy", _cell("y", size))
    held = at.join(area_cells(rings, size), ["cx", "cy"])
    right, low = (F.col("cx") + 1) * F.lit(float(size)), F.col("cy") * F.lit(float(size))
    x, y = F.col("x"), F.col("y")
    row_hit = _across("ay", "by", y) & (x < _x_at(y)) & (_x_at(y) <= right)
    fall_hit = _across("ax", "bx", right) & (low < _y_at(right)) & (_y_at(right) <= y)
    along = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) == (F.col("by") - F.col("ay")) * (x - F.col("ax"))
    on = along & x.between(F.least("ax", "bx"), F.greatest("ax", "bx")) & y.between(F.least("ay", "by"), F.greatest("ay", "by"))
    turned = held.join(edge_cells(rings, size).select("area", "cx", "cy", "ax", "ay", "bx", "by"), ["area", "cx", "cy"], "left")
    count = F.coalesce(row_hit, F.lit(False)).cast("int") + F.coalesce(fall_hit, F.lit(False)).cast("int")
    met = turned.groupBy("id", "area").agg(F.sum(count).alias("turns"), F.max(F.coalesce(on, F.lit(False))).alias("on"), F.first("corner").alias("corner"))
    return met.filter(F.col("on") | ((F.col("turns") % 2 == 1) != F.col("corner"))).select(F.col("id").alias(id_col), "area")


def locate(points: DataFrame, rings: DataFrame, size, tolerance: float = 0.0, id_col: str = "point") -> DataFrame:
    """id, area: the least area that holds a point, else the nearest within ``tolerance`` (ties: the least); null for none."""
    held = inside(points, rings, size, id_col).groupBy(id_col).agg(F.min("area").alias("area"))
    if not tolerance:
        return points.select(id_col).join(held, id_col, "left")
    stray = points.join(held, id_col, "left_anti").select(F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    around = stray.withColumn("cx", _span(F.col("x") - tolerance, F.col("x") + tolerance, size)).withColumn("cy", _span(F.col("y") - tolerance, F.col("y") + tolerance, size))
    near = around.join(edge_cells(rings, size), ["cx", "cy"]).withColumn("d", geo.point_segment("x", "y", "ax", "ay", "bx", "by")).filter(F.col("d") <= tolerance)
    nearest = near.groupBy("id").agg(F.min(F.struct("d", "area"))["area"].alias("area")).select(F.col("id").alias(id_col), "area")
    return points.select(id_col).join(held.unionByName(nearest), id_col, "left")


def placed_lines(lines: DataFrame, rings: DataFrame, size, tolerance: float = 0.0, key: str = "edge") -> DataFrame:
    """key, area of lines (key, points) by their middle vertex."""
    mid = lines.select(key, geo.middle("points").alias("m")).select(key, F.col("m.x").alias("x"), F.col("m.y").alias("y"))
    return locate(mid, rings, size, tolerance, key)


def shares(lines: DataFrame, rings: DataFrame, size, key: str = "edge") -> DataFrame:
    """key, area, metres: lines cut at the borders they cross, each part where its middle lies (area null: nowhere)."""
    parts = lines.select(key, F.posexplode(F.expr("transform(sequence(1, size(points) - 1), i -> struct(double(points[i - 1].x) as x0, double(points[i - 1].y) as y0, double(points[i].x) as x1, double(points[i].y) as y1))")).alias("i", "s")).select(key, "i", "s.*")
    wide = parts.withColumn("cx", _span(F.least("x0", "x1"), F.greatest("x0", "x1"), size)).withColumn("cy", _span(F.least("y0", "y1"), F.greatest("y0", "y1"), size))
    met = wide.join(edge_cells(rings, size).select("cx", "cy", "ax", "ay", "bx", "by"), ["cx", "cy"])
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    cross = dx * ey - dy * ex
    gone = F.when(cross != 0, cross)
    t = ((F.col("ax") - F.col("x0")) * ey - (F.col("ay") - F.col("y0")) * ex) / gone
    u = ((F.col("ax") - F.col("x0")) * dy - (F.col("ay") - F.col("y0")) * dx) / gone
    cuts = met.withColumn("t", t).withColumn("u", u).filter("t > 0 and t < 1 and u >= 0 and u <= 1").groupBy(key, "i").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    bounds = parts.join(cuts, [key, "i"], "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.expr("cast(array() as array<double>)")), F.array(F.lit(1.0))))
    pieces = bounds.withColumn("p", F.explode(F.expr("zip_with(slice(ts, 1, size(ts) - 1), slice(ts, 2, size(ts) - 1), (a, b) -> struct(a, b))")))
    mid = (F.col("p.a") + F.col("p.b")) / 2
    at = pieces.select(key, "i", F.hypot(dx, dy).alias("len"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), (F.col("x0") + mid * dx).alias("x"), (F.col("y0") + mid * dy).alias("y")).withColumn("point", F.struct(key, "i", "a"))
    where = locate(at.select("point", "x", "y"), rings, size)
    return at.join(where, "point").groupBy(key, "area").agg(F.sum(F.col("len") * (F.col("b") - F.col("a"))).alias("metres"))


def measure(areas: DataFrame, placed: DataFrame, edges: DataFrame, edge_rides: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: area, name, boro, net_m, ridden_m, dist_m, time_s, rides; first: area, day, metres).

    areas: area, name, boro; placed: edge, area; edges: edge, metres, rideable; edge_rides: edge, ride, day; measured:
    edge, metres, seconds. Network and ridden metres are of rideable edges; distance and time of every measured one.
    """
    known = edges.join(placed.filter("area is not null"), "edge")
    seen = edge_rides.groupBy("edge").agg(F.min("day").alias("first_day"))
    rideable = known.filter("rideable").join(seen, "edge", "left")
    ridden = F.when(F.col("first_day").isNotNull(), F.col("metres")).otherwise(0)
    net = rideable.groupBy("area").agg(F.sum("metres").alias("net_m"), F.sum(ridden).alias("ridden_m"))
    spent = known.select("edge", "area").join(measured, "edge").groupBy("area").agg(F.sum("metres").alias("dist_m"), F.sum("seconds").alias("time_s"))
    rides = edge_rides.select("edge", "ride").distinct().join(rideable.select("edge", "area"), "edge").select("area", "ride").distinct().groupBy("area").agg(F.count("*").alias("rides"))
    rows = areas.join(net, "area", "left").join(spent, "area", "left").join(rides, "area", "left").fillna(0, ["net_m", "ridden_m", "dist_m", "time_s", "rides"])
    first = rideable.filter("first_day is not null").groupBy("area", F.col("first_day").alias("day")).agg(F.sum("metres").alias("metres"))
    return rows, first


def summary(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rank, name, boro, net_m, ridden_m, dist_m, time_s, new (days and metres in order) of areas with a network.

    The most ridden come first, ties by name; one row an area, so the ranking is one small task.
    """
    new = first.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", F.round("metres").cast("long").alias("metres")))), lambda r: r).alias("new"))
    whole = [F.round(c).cast("long").alias(c) for c in ("net_m", "ridden_m", "dist_m", "time_s")]
    rank = F.row_number().over(Window.orderBy(F.desc("ridden_m"), "name")) - 1
    ranked = rows.filter("net_m > 0").withColumn("rank", rank).join(new, "area", "left")
    return ranked.select("area", "rank", "name", "boro", *whole, "new")


def totals(summarised: DataFrame) -> DataFrame:
    """Sums of the areas' rounded figures."""
    return summarised.agg(*[F.sum(c).alias(c) for c in ("net_m", "ridden_m", "dist_m", "time_s")])


def tag(features: DataFrame, summarised: DataFrame, rings: DataFrame, size, tolerance: float = 0.0) -> DataFrame:
    """fid, n: the rank of the area of each feature's middle vertex; -1 outside all that are listed."""
    at = placed_lines(features, rings, size, tolerance, "fid")
    return at.join(summarised.select("area", "rank"), "area", "left").select("fid", F.coalesce("rank", F.lit(-1)).alias("n"))


def outline(rings: DataFrame, tolerance: float, places: int = 5) -> DataFrame:
    """area, polygons: rings (area, polygon, ring, points; ring 0 outside, others holes) simplified and rounded, nested by polygon."""
    thin = rings.withColumn("points", geo.simplify("points", tolerance)).withColumn("points", F.transform("points", lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places))))
    polygons = thin.groupBy("area", "polygon").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    return polygons.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("polygon", "rings"))), lambda p: p["rings"]).alias("polygons"))


def unplaced(names: DataFrame, placed: DataFrame, ridden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(area, ends of docks there that no ride reached; docks without an area): names: dock, ends; placed: dock, area; ridden: area."""
    at = names.join(placed, "dock", "left")
    quiet = at.filter("area is not null").groupBy("area").agg(F.sum("ends").alias("ends")).join(ridden, "area", "left_anti")
    return quiet, at.filter("area is null").select("dock", "ends")
