"""Polygons as arrays of (x, y): folds where Catalyst can express them, Arrow functions for hull, ellipse and simplification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def _next(points: Column) -> Column:
    """Each vertex's successor around the polygon."""
    n = F.size(points)
    return F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _coordinate(points: Column, name: str) -> Column:
    return F.transform(points, lambda v: v[name])


def _moment(points: Column, name: str) -> Column:
    return _sum(F.zip_with(points, _next(points), lambda a, b: (a[name] + b[name]) * _cross(a, b)))


def polygon_area(points: Column | str) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return F.abs(_sum(F.zip_with(p, _next(p), _cross))) / 2


def polygon_perimeter(points: Column | str) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return _sum(F.zip_with(p, _next(p), lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))))


def polygon_bbox(points: Column | str) -> Column:
    """Integer bounds that include both ends: w = max - min + 1."""
    p = F.col(points) if isinstance(points, str) else points
    low = {c: F.floor(F.array_min(_coordinate(p, c))).cast("int") for c in "xy"}
    high = {c: F.floor(F.array_max(_coordinate(p, c))).cast("int") for c in "xy"}
    return F.struct(low["x"].alias("x"), low["y"].alias("y"), (high["x"] - low["x"] + 1).alias("w"), (high["y"] - low["y"] + 1).alias("h"))


def polygon_centroid(points: Column | str) -> Column:
    """First moments over area; null for a polygon without area."""
    p = F.col(points) if isinstance(points, str) else points
    twice = _sum(F.zip_with(p, _next(p), _cross))
    moment = {c: _moment(p, c) for c in "xy"}
    at = {c: F.when(twice != 0, moment[c] / (F.lit(3.0) * twice)) for c in "xy"}
    return F.when(twice != 0, F.struct(at["x"].alias("x"), at["y"].alias("y")))


def polygon_json(points: Column | str) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return F.to_json(F.transform(p, lambda v: F.array(v["x"], v["y"])))


class Rings:
    """Many point rings as flat arrays: the points of ring i lie from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        self.points, self.offsets = points, offsets

    @classmethod
    def of(cls, rings: Sequence[np.ndarray]) -> Rings:
        sizes = [len(r) for r in rings]
        return cls(np.concatenate([np.zeros((0, 2)), *(np.reshape(r, (-1, 2)) for r in rings)]).astype(float), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    @classmethod
    def of_arrow(cls, lists: pa.Array) -> Rings:
        """From list<struct<x, y>>; a null list is empty."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        return cls(np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"]) if len(flat) else np.zeros((0, 2)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def after(self) -> np.ndarray:
        """Each point's successor around its ring."""
        at = np.arange(1, len(self.points) + 1)
        full = self.sizes > 0
        at[self.offsets[1:][full] - 1] = self.offsets[:-1][full]
        return self.points[at]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the points' values by ring."""
        out = np.zeros((len(self.sizes), *values.shape[1:]))
        full = self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(values, self.offsets[:-1][full], axis=0)
        return out

    def measures(self) -> tuple[np.ndarray, np.ndarray]:
        """(area, perimeter) of each closed ring."""
        p, q = self.points, self.after()
        return np.abs(self.sums(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1])) / 2, self.sums(np.hypot(*(q - p).T))

    def hulls(self) -> Rings:
        """Strict convex hulls, counter-clockwise: lower and upper chains over sorted points, all rings step by step together."""
        owner = self.owner
        order = np.lexsort((self.points[:, 1], self.points[:, 0], owner))
        p, o = self.points[order], owner[order]
        if len(p):
            new = np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1]).any(axis=1)])
            p, o = p[new], o[new]
        n = np.bincount(o, minlength=len(self.sizes)).astype(np.int64)
        first = np.cumsum(n) - n
        chains = []
        for backward in (False, True):
            stack = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.int64)
            size = np.zeros(len(n), np.int64)
            for t in range(int(n.max(initial=0))):
                ring = np.flatnonzero(n > t)
                at = first[ring] + (n[ring] - 1 - t if backward else t)
                deep, place = ring, at
                while len(keep := np.flatnonzero(size[deep] > 1)):
                    deep, place = deep[keep], place[keep]
                    a, b, c = p[stack[deep, size[deep] - 2]], p[stack[deep, size[deep] - 1]], p[place]
                    pop = (b[:, 0] - a[:, 0]) * (c[:, 1] - b[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - b[:, 0]) <= 0
                    deep, place = deep[pop], place[pop]
                    size[deep] -= 1
                stack[ring, size[ring]] = at
                size[ring] += 1
            chains.append((stack, np.where(n > 2, size - 1, 0 if backward else n)))
        (low, n_low), (high, n_high) = chains
        offsets = np.concatenate([[0], np.cumsum(n_low + n_high)])
        out = np.zeros((int(offsets[-1]), 2))
        for stack, size, start in ((low, n_low, offsets[:-1]), (high, n_high, offsets[:-1] + n_low)):
            row = np.repeat(np.arange(len(size)), size)
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[start[row] + k] = p[stack[row, k]]
        return Rings(out, offsets)

    def ellipses(self) -> tuple[np.ndarray, np.ndarray]:
        """(major, minor) full axes of the least-squares ellipses, 0 where none fits.

        The direct fit: minimise the algebraic distance under 4ac - b^2 = 1, solved by blocks.
        """
        major, minor = np.zeros(len(self.sizes)), np.zeros(len(self.sizes))
        n = np.maximum(self.sizes, 1)
        middle = self.sums(self.points) / n[:, None]
        centred = self.points - middle[self.owner]
        # the deviation of all coordinates together: within each axis, and of the axes' means
        scale = np.maximum(np.sqrt(self.sums((centred**2).sum(1)) / (2 * n) + ((middle - middle.mean(1, keepdims=True)) ** 2).mean(1)), 1e-12)
        x, y = (centred / scale[self.owner][:, None]).T
        d = np.stack([x * x, x * y, y * y, x, y, np.ones_like(x)], 1)
        s = self.sums((d[:, :, None] * d[:, None, :]).reshape(len(d), 36)).reshape(-1, 6, 6)
        s1, s2, s3 = s[:, :3, :3], s[:, :3, 3:], s[:, 3:, 3:]
        fit = np.flatnonzero((self.sizes >= 5) & (np.abs(np.linalg.det(s3)) > 1e-300))
        if not len(fit):
            return major, minor
        t = -np.linalg.solve(s3[fit], s2[fit].transpose(0, 2, 1))
        reduced = s1[fit] + s2[fit] @ t
        values, vectors = np.linalg.eig(np.stack([reduced[:, 2] / 2, -reduced[:, 1], reduced[:, 0] / 2], axis=1))
        vectors = vectors.real
        good = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2 > 0
        has = good.any(axis=1)
        fit, t = fit[has], t[has]
        own = vectors[has][np.arange(len(fit)), :, good[has].argmax(axis=1)]
        rest = (t @ own[:, :, None])[:, :, 0]
        a, b, c, e, f, g = *own.T, *rest.T
        conic = np.stack([np.stack([a, b / 2, e / 2], 1), np.stack([b / 2, c, f / 2], 1), np.stack([e / 2, f / 2, g], 1)], axis=1)
        quadratic = conic[:, :2, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            lengths = -(np.linalg.det(conic) / np.linalg.det(quadratic))[:, None] / np.linalg.eigvalsh(quadratic)
        real = (lengths > 0).all(axis=1)
        axes = 2 * scale[fit[real]][:, None] * np.sqrt(lengths[real])
        major[fit[real]], minor[fit[real]] = axes.max(axis=1), axes.min(axis=1)
        return major, minor

    def _farthest(self, ring: np.ndarray, away: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of runs of ``sizes`` values: the place of each run's greatest, the first of equals."""
        starts = np.cumsum(sizes) - sizes
        top = np.maximum.reduceat(away, starts)
        at = np.flatnonzero(away == np.repeat(top, sizes))
        run = np.repeat(ring, sizes)[at]
        new = np.concatenate([[True], run[1:] != run[:-1]])
        return at[new] - starts

    def simplified(self, tolerance: np.ndarray) -> np.ndarray:
        """Vertices that each closed outline keeps when split at the point farthest from each chord, all splits of a depth together."""
        n = self.sizes
        out = n.copy()
        ring = np.flatnonzero(n > 2)
        if not len(ring):
            return out
        base, size = self.offsets[ring], n[ring]

        def from_point(k: np.ndarray) -> np.ndarray:
            own = np.repeat(self.points[base + k], size, axis=0)
            at = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            return self._farthest(np.arange(len(ring)), ((self.points[at] - own) ** 2).sum(1), size)

        first = from_point(np.zeros(len(ring), np.int64))
        other = from_point(first)
        low, high = np.minimum(first, other), np.maximum(first, other)
        kept = np.where(high > low, 2, 1)
        # chords as (ring, from, to), in places from ``low`` around the ring
        who = np.concatenate([np.arange(len(ring))] * 2)
        a, b = np.concatenate([np.zeros(len(ring), np.int64), high - low]), np.concatenate([high - low, size])
        while len(who):
            wide = b - a > 1
            who, a, b = who[wide], a[wide], b[wide]
            if not len(who):
                break
            many = b - a - 1
            chord = np.repeat(np.arange(len(who)), many)
            k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
            spot = lambda w, i: self.points[base[w] + (low[w] + i) % size[w]]
            start, stop = spot(who, a), spot(who, b)
            line, inner = (stop - start)[chord], spot(who[chord], a[chord] + k) - start[chord]
            norm = np.hypot(*line.T)
            away = np.where(norm > 0, np.abs(line[:, 0] * inner[:, 1] - line[:, 1] * inner[:, 0]) / np.where(norm > 0, norm, 1), np.hypot(*inner.T))
            best = self._farthest(np.arange(len(who)), away, many)
            far = away[np.cumsum(many) - many + best] > tolerance[ring[who]]
            who, a, b, middle = who[far], a[far], b[far], (a + 1 + best)[far]
            kept += np.bincount(who, minlength=len(ring))
            who, a, b = np.concatenate([who, who]), np.concatenate([a, middle]), np.concatenate([middle, b])
        out[ring] = kept
        return out


def hull_points(points: np.ndarray) -> np.ndarray:
    return Rings.of([points]).hulls().points


def ring_measures(points: np.ndarray) -> tuple[float, float]:
    """(area, perimeter) of a closed ring."""
    area, perimeter = Rings.of([points]).measures()
    return float(area[0]), float(perimeter[0])


def ellipse_axes_of(points: np.ndarray) -> tuple[float, float]:
    major, minor = Rings.of([points]).ellipses()
    return float(major[0]), float(minor[0])


def simplified(points: np.ndarray, tolerance: float) -> int:
    return int(Rings.of([points]).simplified(np.array([tolerance]))[0])


_HULL = StructType([StructField("area", DoubleType()), StructField("perimeter", DoubleType()), StructField("points", IntegerType())])
_AXES = StructType([StructField("major", DoubleType()), StructField("minor", DoubleType())])


def _struct(**fields: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))


def _hull_fields(rings: Rings) -> dict[str, np.ndarray]:
    hulls = rings.hulls()
    area, perimeter = hulls.measures()
    return {"area": area, "perimeter": perimeter, "points": hulls.sizes.astype(np.int32)}


@F.arrow_udf(_HULL)
def convex_hull(contours: pa.Array) -> pa.Array:
    """Area, perimeter and vertex count of each contour's convex hull."""
    return _struct(**_hull_fields(Rings.of_arrow(contours)))


@F.arrow_udf(_AXES)
def ellipse_axes(contours: pa.Array) -> pa.Array:
    major, minor = Rings.of_arrow(contours).ellipses()
    return _struct(major=major, minor=minor)


@F.arrow_udf(IntegerType())
def simplified_count(contours: pa.Array, tolerance: pa.Array) -> pa.Array:
    return pa.array(Rings.of_arrow(contours).simplified(tolerance.to_numpy(zero_copy_only=False)).astype(np.int32))


@F.arrow_udf(StructType([*_HULL, *_AXES, StructField("kept", IntegerType())]))
def outline(contours: pa.Array, tolerance: pa.Array) -> pa.Array:
    """convex_hull, ellipse_axes and simplified_count of each contour, which goes to Python once."""
    rings = Rings.of_arrow(contours)
    major, minor = rings.ellipses()
    return _struct(**_hull_fields(rings), major=major, minor=minor, kept=rings.simplified(tolerance.to_numpy(zero_copy_only=False)).astype(np.int32))
