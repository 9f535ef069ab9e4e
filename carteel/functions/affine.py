"""Affine and polynomial transforms between pixels and world coordinates.

A transform is six columns a..f: ``x = a*col + c*row + e``, ``y = b*col + d*row + f``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("a", "b", "c", "d", "e", "f")


def columns(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in NAMES}


def _of(t: dict[str, Column] | None) -> tuple[Column, ...]:
    t = t or columns()
    return tuple(t[n] for n in NAMES)


def pixel_to_map(px: Column, py: Column, t: dict[str, Column] | None = None) -> tuple[Column, Column]:
    a, b, c, d, e, f = _of(t)
    return a * px + c * py + e, b * px + d * py + f


def map_to_pixel(x: Column, y: Column, t: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """Null where the transform has no inverse."""
    a, b, c, d, e, f = _of(t)
    det = a * d - b * c
    return F.try_divide(d * (x - e) - c * (y - f), det), F.try_divide(a * (y - f) - b * (x - e), det)


def corners(width: Column, height: Column, t: dict[str, Column] | None = None) -> list[tuple[Column, Column]]:
    zero = F.lit(0.0)
    return [pixel_to_map(px, py, t) for px in (zero, width) for py in (zero, height)]


def extent(width: Column, height: Column, t: dict[str, Column] | None = None) -> dict[str, Column]:
    """min_x, max_x, min_y, max_y over the image's corners."""
    xs, ys = zip(*corners(width, height, t), strict=True)
    return {"min_x": F.least(*xs), "max_x": F.greatest(*xs), "min_y": F.least(*ys), "max_y": F.greatest(*ys)}


def rescaled(scale: Column, t: dict[str, Column] | None = None) -> dict[str, Column]:
    """The transform of an image enlarged by ``scale``: the origin stays."""
    t = t or columns()
    return {n: t[n] / scale if n in "abcd" else t[n] for n in NAMES}


def dpi_scale(dpi: Column, target: float = 600.0) -> Column:
    """Enlargement to ``target`` dots an inch, in halves (half to even); 1 if dpi is 0 or the change is under 0.01."""
    s = F.rint(F.lit(target) / F.nullif(dpi.cast("double"), F.lit(0.0)) * 2) / 2
    return F.coalesce(F.when(F.abs(s - 1) < 0.01, F.lit(1.0)).otherwise(s), F.lit(1.0))


def width_scale(width: Column, target: float = 14000.0) -> Column:
    """Enlargement to ``target`` pixels of width, at least 1, in halves."""
    return F.rint(F.greatest(F.lit(1.0), F.lit(target) / width) * 2) / 2


def polynomial(px: Column, py: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Order 2; coefficient arrays for 1, x, y, xy, x^2, y^2."""
    terms = [F.lit(1.0), px, py, px * py, px * px, py * py]

    def value(coefficients: Column) -> Column:
        return sum((coefficients[i] * t for i, t in enumerate(terms)), F.lit(0.0))

    return value(cx), value(cy)


def corner_drift(one: dict[str, Column], other: dict[str, Column], width: Column, height: Column) -> Column:
    """The largest distance between the two transforms' images of a corner."""
    pairs = zip(corners(width, height, one), corners(width, height, other), strict=True)
    return F.greatest(*[F.hypot(x - u, y - v) for (x, y), (u, v) in pairs])


def pixel_sizes(t: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """Singular values of the linear part, larger first."""
    a, b, c, d, _, _ = _of(t)
    q, r = F.hypot((a + d) / 2, (b - c) / 2), F.hypot((a - d) / 2, (b + c) / 2)
    return q + r, F.abs(q - r)


def size_change(one: dict[str, Column], other: dict[str, Column]) -> tuple[Column, Column]:
    """Relative difference of the pixel sizes on each axis."""
    return F.abs(F.abs(one["a"]) - F.abs(other["a"])) / F.abs(other["a"]), F.abs(F.abs(one["d"]) - F.abs(other["d"])) / F.abs(other["d"])


def inch_frames(x_in: Column, y_in: Column, dpi: Column, height: Column) -> Column:
    """Both readings of a point in scan inches as an array of (frame, px, py): y upwards, y downwards."""
    x, y = x_in * dpi, y_in * dpi
    return F.array(F.struct(F.lit("up").alias("frame"), x.alias("px"), (height - y).alias("py")), F.struct(F.lit("down").alias("frame"), x.alias("px"), y.alias("py")))
