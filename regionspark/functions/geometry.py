"""Geometry as column expressions over array<struct<x:double,y:double>> and box structs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(quad: Column) -> Column:
    """Shoelace formula over four points."""
    return total(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: quad[i]["x"] * quad[(i + 1) % 4]["y"] - quad[(i + 1) % 4]["x"] * quad[i]["y"])) / 2


QUAD = "array<struct<x:double,y:double>>"
_CORNER = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _corners(quads: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which polygons have four points, or `most` at most, none of whose first four lacks a coordinate, and x and y of these four
    points of those polygons, a row each."""
    sizes = pc.fill_null(pc.list_value_length(quads), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    some = (sizes >= 4) & (sizes <= (most or sizes.max(initial=0)))
    points = quads.flatten()
    at = (np.cumsum(sizes) - sizes)[some][:, None] + np.arange(4)
    x, y = (pc.cast(pc.struct_field(points, c), pa.float64()) for c in "xy")
    known = np.ones(len(at), bool)
    for v in (x, y):
        if v.null_count:
            known &= v.is_valid().to_numpy(zero_copy_only=False)[at].all(axis=1)
    some[some] = known
    return some, *(v.to_numpy(zero_copy_only=False)[at[known]] for v in (x, y))


def _quads(some: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    """x and y, a row a polygon, as polygons at the places `some`, null elsewhere."""
    points = pa.StructArray.from_arrays([pa.array(x.ravel()), pa.array(y.ravel())], fields=list(_CORNER))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * some)]), pa.int32()), points, mask=pa.array(~some))


def _area(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)):
        out = out + (x[:, i] * y[:, j] - x[:, j] * y[:, i])
    return out / 2


def _ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which quads have four different points and an area, and x and y of all by order_quad's rule. NaN comes after all numbers
    and equals NaN, as in Spark."""
    same = lambda a, b: (a == b) | (np.isnan(a) & np.isnan(b))
    less = lambda a, b: (a < b) | (np.isnan(b) & ~np.isnan(a))
    good = np.ones(len(x), bool)
    for i in range(4):
        for j in range(i):
            good &= ~(same(x[:, i], x[:, j]) & same(y[:, i], y[:, j]))
    cx, cy = ((((v[:, 0] + v[:, 1]) + v[:, 2]) + v[:, 3]) / 4 for v in (x, y))
    order = np.argsort(np.arctan2(y - cy[:, None], x - cx[:, None]), axis=1, kind="stable")
    x, y = (np.take_along_axis(v, order, 1) for v in (x, y))
    start, row = np.zeros(len(x), np.int64), np.arange(len(x))
    total_ = x + y
    for i in range(1, 4):
        a, b = total_[:, i], total_[row, start]
        start[less(a, b) | (same(a, b) & less(y[:, i], y[row, start]))] = i
    turn = (start[:, None] + np.arange(4)) % 4
    x, y = (np.take_along_axis(v, turn, 1) for v in (x, y))
    area = _area(x, y)
    back = np.where(area[:, None] < 0, [0, 3, 2, 1], [0, 1, 2, 3])
    return good & ~(np.abs(area) < 1e-6), *(np.take_along_axis(v, back, 1) for v in (x, y))


def _in_order(some: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    with np.errstate(invalid="ignore", over="ignore"):
        good, x, y = _ordered(x, y)
    some = some.copy()
    some[some] = good
    return _quads(some, x[good], y[good])


def order_quad(points: Column) -> Column:
    """Points by angle about their centre, from the one with least x + y (then y), positive area; null if there are
    not four different points or no area, or if a coordinate is null."""

    @F.arrow_udf(QUAD)
    def ordered(quads: pa.Array) -> pa.Array:
        return _in_order(*_corners(quads, 4))

    return ordered(points)


def bbox(quad: Column) -> Column:
    """Struct of min_x, min_y, max_x, max_y."""
    xs, ys = quad["x"], quad["y"]
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def overlap_area(a: Column, b: Column) -> Column:
    """Overlap of two bounding boxes."""
    width = F.greatest(F.lit(0.0), F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"]))
    return width * F.greatest(F.lit(0.0), F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"]))


def bbox_area(a: Column) -> Column:
    return (a["max_x"] - a["min_x"]) * (a["max_y"] - a["min_y"])


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union of bounding boxes; 0 where the union is empty."""
    both = overlap_area(a, b)
    union = bbox_area(a) + bbox_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def quad_to_box(quad: Column) -> Column:
    """Sides at least 1, centre, rotation of the first side in degrees."""
    side = lambda a, b: F.greatest(F.lit(1.0), F.hypot(quad[b]["x"] - quad[a]["x"], quad[b]["y"] - quad[a]["y"]))
    return box(
        total(F.transform(quad, lambda p: p["x"])) / 4, total(F.transform(quad, lambda p: p["y"])) / 4, side(0, 1), side(0, 3),
        F.degrees(F.atan2(quad[1]["y"] - quad[0]["y"], quad[1]["x"] - quad[0]["x"])),
    )


def box(cx: Column, cy: Column, width: Column, height: Column, degrees: Column) -> Column:
    return F.struct(cx.alias("center_x"), cy.alias("center_y"), width.alias("width"), height.alias("height"), degrees.alias("rotation_degrees"))


def _on_box(b: Column, x: Column, y: Column) -> Column:
    angle = F.radians(b["rotation_degrees"])
    return point(b["center_x"] + x * F.cos(angle) - y * F.sin(angle), b["center_y"] + x * F.sin(angle) + y * F.cos(angle))


def box_corners(b: Column) -> Column:
    w, h = b["width"] / 2, b["height"] / 2
    return F.array(_on_box(b, -w, -h), _on_box(b, w, -h), _on_box(b, w, h), _on_box(b, -w, h))


def box_to_quad(b: Column) -> Column:
    """The rotated corners in the order of order_quad."""
    return order_quad(box_corners(b))


def box_inside(b: Column, width: Column, height: Column) -> Column:
    """Whether all corners lie in the image."""
    return F.forall(box_corners(b), lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= width) & (p["y"] <= height))


def extend_quad(quad: Column, prefix: Column, suffix: Column, characters: Column, width: Column, height: Column) -> Column:
    """The quad grown along its baseline by 1.1 character widths for each added character, inside the image (a side that is
    null is no bound); null if a point, or a number of characters, is null, or if there are no characters."""

    @F.arrow_udf(QUAD)
    def extended(quads: pa.Array, *numbers: pa.Array) -> pa.Array:
        some, x, y = _corners(quads)
        before, after, each, wide, high = (pc.cast(v, pa.float64()).to_numpy(zero_copy_only=False) for v in numbers)
        known = some & (each != 0)
        for v in numbers[:3]:
            known &= v.is_valid().to_numpy(zero_copy_only=False)
        x, y = (v[known[some]] for v in (x, y))
        before, after, each, wide, high = (v[known] for v in (before, after, each, wide, high))
        with np.errstate(invalid="ignore", over="ignore"):
            dx, dy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0]
            length = np.maximum(1.0, np.sqrt(dx * dx + dy * dy))
            left, right = -(length / each * before * 1.1), length / each * after * 1.1
            by = np.stack([left, right, right, left], axis=1)
            clamp = lambda v, most: np.fmin((most - 1)[:, None], np.maximum(0.0, v))
            x, y = clamp(x + (dx / length)[:, None] * by, wide), clamp(y + (dy / length)[:, None] * by, high)
        return _in_order(known, x, y)

    return extended(quad, prefix, suffix, characters, width, height)


def arc(start: Column, control: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), control.alias("control"), end.alias("end"))


def arc_point(a: Column, t: Column) -> Column:
    """Point of the quadratic curve at t from 0 to 1."""
    r = 1 - t
    at = lambda c: r * r * a["start"][c] + 2 * r * t * a["control"][c] + t * t * a["end"][c]
    return point(at("x"), at("y"))


def arc_tangent(a: Column, t: Column) -> Column:
    """Derivative at t."""
    at = lambda c: 2 * ((1 - t) * (a["control"][c] - a["start"][c]) + t * (a["end"][c] - a["control"][c]))
    return point(at("x"), at("y"))


#: Arcs whose pieces a task holds at a time.
ARCS = 2000


def _steps(arcs: pa.Array, n: int) -> np.ndarray:
    """Lengths of n straight pieces of each arc, a row an arc; NaN where a coordinate is null."""
    t = np.arange(n + 1) / n
    r = 1 - t

    def along(c: str) -> np.ndarray:
        s, k, e = (pc.cast(pc.struct_field(arcs, [p, c]), pa.float64()).to_numpy(zero_copy_only=False)[:, None] for p in ("start", "control", "end"))
        return r * r * s + 2 * r * t * k + t * t * e

    return np.hypot(np.diff(along("x"), axis=1), np.diff(along("y"), axis=1))


def _known(arcs: pa.Array) -> np.ndarray:
    out = np.ones(len(arcs), bool)
    for p in ("start", "control", "end"):
        for c in "xy":
            out &= pc.is_valid(pc.struct_field(arcs, [p, c])).to_numpy(zero_copy_only=False)
    return out


def arc_length(a: Column, n: int = 96) -> Column:
    """Length of the curve in n straight pieces."""

    @F.arrow_udf("double")
    def length(arcs: pa.Array) -> pa.Array:
        parts = [arcs.slice(i, ARCS) for i in range(0, len(arcs), ARCS)]
        out = [np.cumsum(_steps(p, n), axis=1)[:, -1] for p in parts]
        return pa.chunked_array([pa.array(x, mask=~_known(p)) for x, p in zip(out, parts)], pa.float64()).combine_chunks()

    return length(a)


def default_arc(b: Column, bend: Column) -> Column:
    """Arc through a box, its control point bent up by a share of the height."""
    return arc(_on_box(b, -b["width"] / 2, F.lit(0.0)), _on_box(b, F.lit(0.0), -b["height"] * bend), _on_box(b, b["width"] / 2, F.lit(0.0)))


def transform_arc(a: Column, old: Column, new: Column) -> Column:
    """The arc moved, scaled and turned from one box to another."""
    angle = F.radians(old["rotation_degrees"])

    def moved(p: Column) -> Column:
        dx, dy = p["x"] - old["center_x"], p["y"] - old["center_y"]
        return _on_box(new, (dx * F.cos(angle) + dy * F.sin(angle)) * new["width"] / old["width"], (-dx * F.sin(angle) + dy * F.cos(angle)) * new["height"] / old["height"])

    return arc(moved(a["start"]), moved(a["control"]), moved(a["end"]))


def arc_position_at(a: Column, distance: Column, n: int = 192) -> Column:
    """The t at which the curve has come so far: the first of n pieces that reaches the distance, then linear; 1 beyond."""

    def placed(arcs: pa.Array, goals: np.ndarray) -> np.ndarray:
        step = _steps(arcs, n)
        run = np.cumsum(step, axis=1)
        come = (goals[:, None] <= run) | np.isnan(run)
        first, row = come.argmax(axis=1), np.arange(len(goals))
        before = np.where(first > 0, run[row, first - 1], 0.0)
        piece = step[row, first]
        with np.errstate(invalid="ignore", divide="ignore"):
            t = (first + np.where(piece == 0, 0.0, (goals - before) / piece)) / n
        return np.where(come[row, first] & _known(arcs), t, 1.0)

    @F.arrow_udf("double")
    def position(arcs: pa.Array, goals: pa.Array) -> pa.Array:
        goals = pc.fill_null(pc.cast(goals, pa.float64()), float("inf")).to_numpy(zero_copy_only=False)
        out = [placed(arcs.slice(i, ARCS), goals[i : i + ARCS]) for i in range(0, len(arcs), ARCS)]
        return pa.array(np.concatenate([np.empty(0), *out]))

    return position(a, distance)


def clamp_crop(min_x: Column, min_y: Column, max_x: Column, max_y: Column, context: int, width: Column, height: Column) -> Column:
    """Pixel bounds (inclusive) grown by a margin inside the image; x1 and y1 are exclusive."""
    return F.struct(
        F.greatest(F.lit(0), min_x - context).alias("x0"), F.greatest(F.lit(0), min_y - context).alias("y0"),
        F.least(width, max_x + context + 1).alias("x1"), F.least(height, max_y + context + 1).alias("y1"),
    )


def square_crop(crop: Column, width: Column, height: Column) -> Column:
    """The smallest square about a crop that the image has room for."""
    half = lambda v: F.floor(v / 2).cast("int")
    side = F.greatest(crop["x1"] - crop["x0"], crop["y1"] - crop["y0"])
    start = lambda a, b, most: F.greatest(F.lit(0), F.least(most - side, half(crop[a] + crop[b]) - half(side)))
    x0, y0 = start("x0", "x1", width), start("y0", "y1", height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.least(width, x0 + side).alias("x1"), F.least(height, y0 + side).alias("y1"))


def manual_crop(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels of an upright box, its far edges rounded up by 0.999; null if nothing is left."""
    cut = lambda v: v.cast("int")
    crop = F.struct(
        F.greatest(F.lit(0), cut(b["center_x"] - b["width"] / 2)).alias("x0"), F.greatest(F.lit(0), cut(b["center_y"] - b["height"] / 2)).alias("y0"),
        F.least(width, cut(b["center_x"] + b["width"] / 2 + 0.999)).alias("x1"), F.least(height, cut(b["center_y"] + b["height"] / 2 + 0.999)).alias("y1"),
    )
    return let(crop, lambda c: F.when((c["x1"] > c["x0"]) & (c["y1"] > c["y0"]), c))


def luminance(rgb: Column) -> Column:
    """Relative luminance of an array of three values from 0 to 255."""
    linear = F.transform(rgb, lambda v: F.when(v / 255.0 <= 0.04045, v / 255.0 / 12.92).otherwise(F.pow((v / 255.0 + 0.055) / 1.055, F.lit(2.4))))
    return let(linear, lambda c: c[0] * 0.2126 + c[1] * 0.7152 + c[2] * 0.0722)


def contrast_ratio(a: Column, b: Column) -> Column:
    """A21."""
    return let(F.array(luminance(a), luminance(b)), lambda v: (F.array_max(v) + 0.05) / (F.array_min(v) + 0.05))


