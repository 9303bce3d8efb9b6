"""Shape descriptors and the rule-based abnormality score, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.config import ShapeConfig


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def form_factor(area: Column | str, perimeter: Column | str) -> Column:
    """4 pi A / P^2, or 0 where either is not positive."""
    a, p = _col(area), _col(perimeter)
    return F.when((a > 0) & (p > 0), F.lit(4 * math.pi) * a / (p * p)).otherwise(F.lit(0.0))


def circularity(area: Column | str, perimeter: Column | str) -> Column:
    return F.least(form_factor(area, perimeter), F.lit(1.0))


def aspect_ratio(major: Column | str, minor: Column | str) -> Column:
    """1 where the minor axis is not positive."""
    return F.when(_col(minor) > 0, _col(major) / _col(minor)).otherwise(F.lit(1.0))


def eccentricity(major: Column | str, minor: Column | str) -> Column:
    a, b = _col(major), _col(minor)
    return F.when(a > 0, F.sqrt(F.greatest(F.lit(1.0) - (b / a) * (b / a), F.lit(0.0)))).otherwise(F.lit(0.0))


def roundness(area: Column | str, major: Column | str) -> Column:
    a, m = _col(area), _col(major)
    return F.when((m > 0) & (a > 0), F.lit(4.0) * a / (F.lit(math.pi) * m * m)).otherwise(F.lit(0.0))


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, or 0 where either is not positive: solidity of areas, convexity of perimeters."""
    x, y = _col(part), _col(whole)
    return F.when((x > 0) & (y > 0), x / y).otherwise(F.lit(0.0))


def edge_roughness(points: Column | str, kept: Column | str, perimeter: Column | str, hull_perimeter: Column | str) -> Column:
    """From the share of points that a simplified outline keeps and the outline's excess over its hull; 0 below six points."""
    n, k, p, h = map(_col, (points, kept, perimeter, hull_perimeter))
    raw = F.lit(0.6) * k / F.greatest(n, F.lit(1)) + F.lit(0.4) * F.greatest(F.lit(0.0), F.lit(1.0) - h / p)
    return F.when((n >= 6) & (p > 0) & (h > 0), F.least(raw, F.lit(1.0))).otherwise(F.lit(0.0))


def feature_vector(area, perimeter, circ, aspect, rough, solidity, convexity, ecc, form, round_) -> Column:
    """The ten descriptors of the store, narrowed to float."""
    parts = [F.log1p(_col(area)), F.log1p(_col(perimeter)), _col(circ), F.least(_col(aspect), F.lit(10.0)) / 10.0, *map(_col, (rough, solidity, convexity, ecc, form, round_))]
    return F.array(*[p.cast("double") for p in parts]).cast("array<float>")


def raw_score(circ, aspect, rough, solidity, config: ShapeConfig = ShapeConfig()) -> Column:
    """Weighted shortfalls, unclamped; every comparison is strict."""
    c, a, r, s = map(_col, (circ, aspect, rough, solidity))
    wc, wa, wr, ws = config.weights
    tc, ta, tr, ts = config.circularity, config.aspect_ratio, config.roughness, config.solidity
    zero = F.lit(0.0)
    return (
        F.when(c < tc, (F.lit(tc) - c) / tc * wc).otherwise(zero)
        + F.when(a > ta, F.least((a - ta) / ta, F.lit(1.0)) * wa).otherwise(zero)
        + F.when(r > tr, F.least((r - tr) / (1 - tr), F.lit(1.0)) * wr).otherwise(zero)
        + F.when(s < ts, (F.lit(ts) - s) / ts * ws).otherwise(zero)
    )


def reasons(circ, aspect, rough, solidity, config: ShapeConfig = ShapeConfig()) -> Column:
    """What speaks against an object, in a fixed order; the pattern form of format_number rounds half to even."""
    def reason(name: str, value: Column, pattern: str, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(name + "("), F.call_function("format_number", value, F.lit(pattern)), F.lit(")")))

    c, a, r, s = map(_col, (circ, aspect, rough, solidity))
    return F.array_compact(
        F.array(
            reason("low_circularity", c, "0.000", c < config.circularity),
            reason("high_aspect_ratio", a, "0.00", a > config.aspect_ratio),
            reason("high_edge_roughness", r, "0.000", r > config.roughness),
            reason("low_solidity", s, "0.000", s < config.solidity),
        )
    )


def gate(area, perimeter, points=None, config: ShapeConfig = ShapeConfig()) -> Column:
    """Objects worth describing: area in bounds, a perimeter, and enough points where they are known."""
    keep = _col(area).between(config.min_area, config.max_area) & (_col(perimeter) > 0)
    return keep if points is None else keep & (_col(points) >= config.min_points)
