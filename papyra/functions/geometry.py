"""Boxes, affine transforms and fingerprints as Column expressions.

A box is x0, y0, x1, y1 with the origin at the bottom left; a transform is an array [a, b, c, d, e, f] with
x' = a x + c y + e and y' = b x + d y + f.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grids of fingerprints, width and height of a line by its font size, and the tolerances of checks.
GRID_BOX, GRID_PAGE = 8, 4
LINE_WIDTH, LINE_HEIGHT = 0.5, 1.2
ANCHOR_TOLERANCE, REGION_MARGIN = 6.0, 4.0
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def quantize(value: Column, grid: int) -> Column:
    """The nearest multiple of grid, halves to the even one."""
    return (F.rint(value / F.lit(float(grid))) * grid).cast("int")


def line_box(text: Column, x0: Column, y0: Column, size: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.length(text) * size * LINE_WIDTH).alias("x1"), (y0 + size * LINE_HEIGHT).alias("y1"))


def lines_of(boxes: Column) -> Column:
    """Quantised boxes (an array of structs x0, y0, x1, y1) from top to bottom, left to right, as arrays of four."""
    q = F.transform(boxes, lambda b: F.struct(*[quantize(b[c], GRID_BOX).alias(c) for c in ("x0", "y0", "x1", "y1")]))
    ordered = F.array_sort(F.transform(q, lambda b: F.struct((-b["y0"]).alias("a"), b["x0"].alias("b"), (-b["y1"]).alias("c"), b["x1"].alias("d"))))
    return F.transform(ordered, lambda o: F.array(o["b"], -o["a"], o["d"], -o["c"]))


def features_1(page_count: Column, pages: Column) -> Column:
    """Features of version 1; pages: array of structs width, height, boxes in page order."""
    page = F.transform(pages, lambda p: F.struct(quantize(p["height"], GRID_PAGE).alias("h_bucket"), lines_of(p["boxes"]).alias("lines"), quantize(p["width"], GRID_PAGE).alias("w_bucket")))
    return F.struct(F.lit(1).alias("fpv"), page_count.alias("page_count"), page.alias("pages"))


_ALGORITHMS: dict[int, Callable[[Column, Column], Column]] = {1: features_1}


def register_algorithm(version: int, features: Callable[[Column, Column], Column]) -> None:
    """A version is never replaced."""
    if version in _ALGORITHMS:
        raise ValueError(f"version {version} is registered already")
    _ALGORITHMS[version] = features


def algorithm(version: int | None = None) -> Callable[[Column, Column], Column]:
    """The algorithm of a version, by default the newest."""
    version = max(_ALGORITHMS) if version is None else version
    if version not in _ALGORITHMS:
        raise KeyError(f"no algorithm of version {version}")
    return _ALGORITHMS[version]


def fingerprint_key(features: Column, version: int = 1) -> Column:
    """Name and sha256 of the features as JSON, whose keys are in alphabetical order; all values are whole numbers."""
    return F.concat(F.lit(f"fpv{version}:sha256:"), F.sha2(F.to_json(features), 256))


def transform_of(values: list[float]) -> Column:
    if len(values) != 6 or not all(math.isfinite(v) for v in values):
        raise ValueError("a transform has six finite numbers")
    return F.array(*[F.lit(float(v)) for v in values])


def apply_point(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t[0] * x + t[2] * y + t[4], t[1] * x + t[3] * y + t[5]


def apply_box(t: Column, box: list[Column]) -> Column:
    """The smallest box around the four mapped corners."""
    corners = [apply_point(t, box[i], box[j]) for i in (0, 2) for j in (1, 3)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def compose(second: Column, first: Column) -> Column:
    """The transform that applies first, then second."""
    s, f = second, first
    return F.array(
        s[0] * f[0] + s[2] * f[1], s[1] * f[0] + s[3] * f[1], s[0] * f[2] + s[2] * f[3], s[1] * f[2] + s[3] * f[3],
        s[0] * f[4] + s[2] * f[5] + s[4], s[1] * f[4] + s[3] * f[5] + s[5],
    )


def determinant(t: Column) -> Column:
    return t[0] * t[3] - t[1] * t[2]


def inverse(t: Column) -> Column:
    """A singular or infinite transform is an error."""
    d = determinant(t)
    bad = (d == 0) | ~F.forall(t, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = F.when(bad, F.raise_error(F.lit("the transform has no inverse")).cast("double")).otherwise(d)
    return F.array(t[3] / d, -t[1] / d, -t[2] / d, t[0] / d, (t[2] * t[5] - t[3] * t[4]) / d, (t[1] * t[4] - t[0] * t[5]) / d)


def rotation(degrees: Column) -> Column:
    a = F.radians(degrees)
    zero = F.lit(0.0)
    return F.array(F.cos(a), F.sin(a), -F.sin(a), F.cos(a), zero, zero)


def scaling(x: Column, y: Column) -> Column:
    whole = lambda v: F.when(v == 0, F.raise_error(F.lit("a scale is zero")).cast("double")).otherwise(v)
    return F.array(whole(x), F.lit(0.0), F.lit(0.0), whole(y), F.lit(0.0), F.lit(0.0))


def translation(x: Column, y: Column) -> Column:
    return F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), x, y)


def preprocessing(crop_x: Column, crop_y: Column, dpi: Column, deskew: Column, structural: Column) -> Column:
    """Structural rotation, deskewing, scaling from 72 points an inch, then the crop's corner at the origin."""
    fine = F.when((dpi > 0) & (dpi < float("inf")) & ~F.isnan(deskew) & (F.abs(deskew) < float("inf")), dpi).otherwise(F.raise_error(F.lit("dpi and deskewing must be finite, dpi above 0")).cast("double"))
    scale = scaling(fine / 72.0, fine / 72.0)
    return compose(translation(-crop_x, -crop_y), compose(scale, compose(rotation(deskew), rotation(structural))))


def same_row(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two vertical extents overlap by more than an edge."""
    return (a0 < b1) & (b0 < a1)


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """Common area over the smaller area; 0 if an extent is 0."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    least = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(least > 0, w * h / least).otherwise(0.0)


def region_hash(page: Column, box: list[Column]) -> Column:
    """16 digits of sha256 of the page and the box, in whole points."""
    whole = F.concat_ws(", ", *[F.concat(F.rint(c).cast("long").cast("string"), F.lit(".0")) for c in box])
    return F.substring(F.sha2(F.concat(F.lit("page="), page, F.lit(";bbox=["), whole, F.lit("]")), 256), 1, 16)


def contains_page(page: Column, page_count: Column) -> Column:
    return (page >= 1) & (page <= page_count)
