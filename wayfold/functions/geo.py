"""Geometry as column expressions. Coordinates are degrees (lon, lat) or planar metres (x, y).

Four metrics are kept apart on purpose: the sphere (R = 6,371,000 m), the plane at a fixed latitude, the plane at the
mid-latitude of a pair, and the sphere in kilometres.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius, metres a degree of latitude, and a degree of longitude at 40.73 degrees north.
EARTH_M, EARTH_KM, M_PER_LAT, M_PER_DEGREE = 6_371_000.0, 6371.0, 110_540.0, 111_320.0
M_PER_LON = M_PER_DEGREE * math.cos(math.radians(40.73))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would take null for 1


def planar(lat1, lon1, lat2, lon2) -> Column:
    return F.hypot((_c(lon2) - _c(lon1)) * M_PER_LON, (_c(lat2) - _c(lat1)) * M_PER_LAT)


def planar_mid(lat1, lon1, lat2, lon2) -> Column:
    shrink = F.cos(F.radians((_c(lat1) + _c(lat2)) / 2))
    return M_PER_DEGREE * F.hypot((_c(lon2) - _c(lon1)) * shrink, _c(lat2) - _c(lat1))


def compass(dx, dy) -> Column:
    """Degrees clockwise from north, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(_c(dx), _c(dy))), F.lit(360.0))


def math_angle(dx, dy) -> Column:
    """Degrees anticlockwise from east, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(_c(dy), _c(dx))), F.lit(360.0))


def turn(a, b, full: float = 360.0) -> Column:
    """Least difference of two directions; of two undirected bearings with full = 180."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(full))
    return F.least(d, full - d)


def octant(bearing) -> Column:
    names = F.array(*map(F.lit, "N NE E SE S SW W NW".split()))
    return F.element_at(names, (F.pmod(_c(bearing) + 22.5, F.lit(360.0)) / 45).cast("int") + 1)


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, ((_c(px) - _c(ax)) * dx + (_c(py) - _c(ay)) * dy) / squared).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(_c(px) - _c(ax) - t * dx, _c(py) - _c(ay) - t * dy)


def path_length(points: str) -> Column:
    """Length of an array of (x, y) structs."""
    pairs = f"zip_with(slice({points}, 1, greatest(size({points}) - 1, 0)), slice({points}, 2, greatest(size({points}) - 1, 0)), (a, b) -> hypot(b.x - a.x, b.y - a.y))"
    return F.expr(f"aggregate({pairs}, 0D, (s, d) -> s + d)")


def middle(points: str) -> Column:
    """The middle vertex."""
    return F.expr(f"element_at({points}, int(size({points}) div 2) + 1)")


def opposed(dx1, dy1, dx2, dy2) -> Column:
    return _c(dx1) * _c(dx2) + _c(dy1) * _c(dy2) < 0


def simplify(points: str, tolerance: float) -> Column:
    """Lines (array of x, y) without the vertices that lie within tolerance of what is kept (Douglas-Peucker)."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def thinned(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else [line[i] for i in _corners(np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2), tolerance)])

    return thinned(points)


def _corners(line: np.ndarray, tolerance: float) -> list[int]:
    """Indexes of the vertices to keep: the ends, and the farthest of each span that is off by more than tolerance."""
    kept, spans = {0, len(line) - 1} if len(line) else set(), [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        way, off = line[b] - line[a], line[a + 1 : b] - line[a]
        square = float(way @ way)
        t = np.clip(off @ way / square, 0, 1) if square else np.zeros(len(off))
        far = np.hypot(*(off - t[:, None] * way).T)
        if far.max() > tolerance:
            middle = a + 1 + int(far.argmax())
            kept.add(middle)
            spans += [(a, middle), (middle, b)]
    return sorted(kept)


def rotated(x, y, degrees: float = 29.0, stretch: float = 1.0) -> tuple[Column, Column]:
    """A plane point turned clockwise, and stretched along the new y: a street grid drawn upright."""
    a = math.radians(degrees)
    return _c(x) * math.cos(a) + _c(y) * math.sin(a), (_c(y) * math.cos(a) - _c(x) * math.sin(a)) * stretch


def gridded(value, cell: float) -> Column:
    """The nearest multiple of a cell's size."""
    return F.round(_c(value) / cell) * cell


def bounding_box(rows, box: tuple[float, float, float, float], margin: float = 0.005):
    """west, south, east, north of points (lon, lat) inside a box, with a margin: one row."""
    west, south, east, north = box
    return rows.agg(
        (F.greatest(F.min("lon"), F.lit(west)) - margin).alias("west"), (F.greatest(F.min("lat"), F.lit(south)) - margin).alias("south"), (F.least(F.max("lon"), F.lit(east)) + margin).alias("east"), (F.least(F.max("lat"), F.lit(north)) + margin).alias("north")
    )
