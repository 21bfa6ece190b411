"""Polygon and line kernels. A ring or line is ARRAY<STRUCT<x, y>>; rings are closed by repeating the first vertex or not.

Areas, lengths, centroids and points in polygons are built-in expressions; hulls, clipping and rotated rectangles run in
Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def _steps(ring: Column, close: bool) -> Column:
    """Each vertex with the one after it."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1))) if close else F.slice(ring, F.lit(2), F.size(ring))
    return F.filter(F.arrays_zip(ring.alias("p"), nxt.alias("q")), lambda s: s["q"].isNotNull())


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise."""
    return F.aggregate(_steps(ring, True), F.lit(0.0), lambda a, s: a + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]) / 2


def length(line: Column, close: bool = False) -> Column:
    return F.aggregate(_steps(line, close), F.lit(0.0), lambda a, s: a + F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]))


def centroid(ring: Column) -> Column:
    """Struct x, y; null for a ring without area."""
    a6 = signed_area(ring) * 6
    axis = lambda k: F.try_divide(F.aggregate(_steps(ring, True), F.lit(0.0), lambda a, s: a + (s["p"][k] + s["q"][k]) * (s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])), a6)
    return F.struct(axis("x").alias("x"), axis("y").alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Point in ring by crossing number; lower and left edges count as inside, upper and right ones as outside."""
    crosses = F.filter(_steps(ring, True), lambda s: ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & (x < (s["q"]["x"] - s["p"]["x"]) * (y - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"]) + s["p"]["x"]))
    return F.size(crosses) % 2 == 1


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter squared."""
    p = length(ring, True)
    return F.try_divide(4 * math.pi * F.abs(signed_area(ring)), p * p)


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(pt(xmin, ymin), pt(xmax, ymin), pt(xmax, ymax), pt(xmin, ymax))


def locate(line: Column, measure: Column) -> Column:
    """The point at a distance along a line; null beyond its ends."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(None).cast("struct<x:double,y:double>").alias("p"))

    def step(acc: Column, s: Column) -> Column:
        d = F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])
        t = F.try_divide(measure - acc["m"], d)
        here = F.struct((s["p"]["x"] + t * (s["q"]["x"] - s["p"]["x"])).alias("x"), (s["p"]["y"] + t * (s["q"]["y"] - s["p"]["y"])).alias("y"))
        return F.struct((acc["m"] + d).alias("m"), F.when(acc["p"].isNull() & (t >= 0) & (t <= 1), here).otherwise(acc["p"]).alias("p"))

    return F.aggregate(_steps(line, False), start, step, lambda a: a["p"])


def measures(total: Column, step: float) -> Column:
    """0, step, 2 step, ... and the end."""
    n = F.floor(total / step).cast("int")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), n), lambda k: k * F.lit(float(step))), F.array(total)))


def offset(line: Column, distance: float) -> Column:
    """A single segment moved to its left (right if negative)."""
    s = F.get(_steps(line, False), F.lit(0))
    dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
    n = F.hypot(dx, dy)
    pt = lambda p: F.struct((p["x"] - dy / n * distance).alias("x"), (p["y"] + dx / n * distance).alias("y"))
    return F.array(pt(s["p"]), pt(s["q"]))


# --- Arrow kernels ---------------------------------------------------------------------------------------------------


def hull_of(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the lowest leftmost point (monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def rotated_rectangle(p: np.ndarray) -> tuple[float, float, float | None]:
    """long, short, direction (degrees, modulo 180; None for a square) of the least rectangle."""
    h = hull_of(p)
    if len(h) < 2:
        return 0.0, 0.0, None
    if len(h) == 2:
        d = h[1] - h[0]
        return float(np.hypot(*d)), 0.0, math.degrees(math.atan2(d[1], d[0])) % 180
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        d = (b - a) / np.hypot(*(b - a))
        u, v = h @ d, h @ np.array([-d[1], d[0]])
        w, t = np.ptp(u), np.ptp(v)
        if best is None or w * t < best[0] - 1e-12 * max(1.0, best[0]):
            best = (w * t, w, t, d)
    _, w, t, d = best
    axis = d if w >= t else np.array([-d[1], d[0]])
    square = math.isclose(w, t, rel_tol=1e-12)
    return float(max(w, t)), float(min(w, t)), None if square else math.degrees(math.atan2(axis[1], axis[0])) % 180


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex counter-clockwise one (Sutherland and Hodgman)."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, after = np.roll(out, -1, axis=0), np.roll(side, -1)
        kept = []
        for p, q, s, t in zip(out, nxt, side, after):
            if s >= 0:
                kept.append(p)
            if (s >= 0) != (t >= 0):
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept)
    return out


def buffer_convex(p: np.ndarray, distance: float, segments: int = 8) -> np.ndarray:
    """Points within a distance of the convex hull: the hull of circles round its corners."""
    angles = np.arange(4 * segments) * (math.pi / 2 / segments)
    circle = distance * np.column_stack([np.cos(angles), np.sin(angles)])
    return hull_of((hull_of(p)[:, None, :] + circle[None, :, :]).reshape(-1, 2))


def _array(ring) -> np.ndarray:
    return np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2)


def _ring(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def hull_udf():
    @F.pandas_udf(RING)
    def hull(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rings in batches:
            yield rings.map(lambda r: _ring(hull_of(_array(r))) if r is not None else None)

    return hull


def clip_udf():
    @F.pandas_udf(RING)
    def clip(subject: pd.Series, window: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _ring(clip_convex(_array(a), hull_of(_array(b)))) for a, b in zip(subject, window)])

    return clip


def buffer_udf(distance: float, segments: int = 8):
    @F.pandas_udf(RING)
    def buffer(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: _ring(buffer_convex(_array(r), distance, segments)) if r is not None else None)

    return buffer


def rectangle_udf():
    @F.pandas_udf("long_m double, short_m double, direction_deg double")
    def rectangle(rings: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rotated_rectangle(_array(r)) if r is not None else (None, None, None) for r in rings], columns=["long_m", "short_m", "direction_deg"]).astype(float)

    return rectangle
