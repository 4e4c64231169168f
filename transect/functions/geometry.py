"""Boxes as columns. Doubles throughout; the order of operands is part of the definition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def centre_box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def centre_to_corners(b: Column, width: Column, height: Column) -> Column:
    return box((b.cx - b.w / 2) * width, (b.cy - b.h / 2) * height, (b.cx + b.w / 2) * width, (b.cy + b.h / 2) * height)


def corners_to_centre(b: Column, width: Column, height: Column) -> Column:
    """Normalized and clamped; null shares for an image without width or height."""
    width, height = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    share = lambda v: F.when(v.isNotNull(), clamp01(v))
    return centre_box(share((b.x1 + b.x2) / 2 / width), share((b.y1 + b.y2) / 2 / height), share((b.x2 - b.x1) / width), share((b.y2 - b.y1) / height))


def percent_to_centre(x: Column, y: Column, w: Column, h: Column, clamped: bool = False) -> Column:
    """From percent and the top left corner. Clamped: boxes without extent become null."""
    parts = [(x + w / 2) / 100.0, (y + h / 2) / 100.0, w / 100.0, h / 100.0]
    if not clamped:
        return centre_box(*parts)
    return F.when((w > 0) & (h > 0), centre_box(*[clamp01(p) for p in parts]))


def centre_to_percent(b: Column) -> Column:
    """(x, y, width, height) from the top left, in percent."""
    return F.struct(((b.cx - b.w / 2) * 100).alias("x"), ((b.cy - b.h / 2) * 100).alias("y"), (b.w * 100).alias("width"), (b.h * 100).alias("height"))


def corners_to_percent(b: Column, width: Column, height: Column) -> Column:
    """Null for an image without width or height."""
    width, height = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    return F.struct((b.x1 / width * 100).alias("x"), (b.y1 / height * 100).alias("y"), ((b.x2 - b.x1) / width * 100).alias("width"), ((b.y2 - b.y1) / height * 100).alias("height"))


def coco_to_centre(bbox: Column, mode: Column, width: Column, height: Column) -> Column:
    """Mode 0: corners; else (and by default): corner and extent. Null for arrays of fewer than four numbers."""
    at = [F.get(bbox, F.lit(k)) for k in range(4)]
    corner = F.coalesce(mode, F.lit(1)) == 0
    x2, y2 = F.when(corner, at[2]).otherwise(at[0] + at[2]), F.when(corner, at[3]).otherwise(at[1] + at[3])
    return F.when(F.size(bbox) >= 4, corners_to_centre(box(at[0], at[1], x2, y2), width, height))


def shape_to_corners(s: Column) -> Column:
    """Of a shape's attributes: polygons and polylines by their points, rectangles, circles, points and ellipses; null for others."""

    def num(name: str) -> Column:
        return F.coalesce(s[name], F.lit(0.0))

    poly = F.when((F.size(s.all_points_x) > 0) & (F.size(s.all_points_y) > 0), box(F.array_min(s.all_points_x), F.array_min(s.all_points_y), F.array_max(s.all_points_x), F.array_max(s.all_points_y)))
    rect = box(num("x"), num("y"), num("x") + num("width"), num("y") + num("height"))
    round_ = box(num("cx") - num("r"), num("cy") - num("r"), num("cx") + num("r"), num("cy") + num("r"))
    oval = box(num("cx") - num("rx"), num("cy") - num("ry"), num("cx") + num("rx"), num("cy") + num("ry"))
    name = s["name"]
    return F.when(name.isin("polygon", "polyline"), poly).when(name == "rect", rect).when(name.isin("circle", "point"), round_).when(name == "ellipse", oval)


def oriented_point(x: Column, y: Column, orientation: Column) -> Column:
    """Normalized point of a stored image as it is shown, by the EXIF orientation tag; other values leave it as it is."""
    pairs = {2: (1 - x, y), 3: (1 - x, 1 - y), 4: (x, 1 - y), 5: (y, x), 6: (1 - y, x), 7: (1 - y, 1 - x), 8: (y, 1 - x)}
    out = F.lit(None)
    for k, (a, b) in pairs.items():
        p = F.struct(a.alias("x"), b.alias("y"))
        out = F.when(orientation == k, p) if k == 2 else out.when(orientation == k, p)
    return out.otherwise(F.struct(x.alias("x"), y.alias("y")))


def oriented_box(b: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Centre box, as shown, of pixel corners in the stored image; null without its width or height."""
    sized = (width != 0) & (height != 0)
    width, height = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    x = [b.x1 / width, b.x2 / width]
    y = [b.y1 / height, b.y2 / height]
    corners = F.array(*[oriented_point(p, q, orientation) for p in x for q in y])
    xs, ys = F.transform(corners, lambda p: p.x), F.transform(corners, lambda p: p.y)
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when(sized, centre_box(clamp01((x1 + x2) / 2), clamp01((y1 + y2) / 2), clamp01(x2 - x1), clamp01(y2 - y1)))


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """0 without overlap or area. Arguments are columns or their names."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = map(_c, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    w = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    h = F.least(ay2, by2) - F.greatest(ay1, by1)
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def centre_inside(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Whether the centre of a is in b, edges included."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = map(_c, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    cx, cy = (ax1 + ax2) / 2, (ay1 + ay2) / 2
    return (bx1 <= cx) & (cx <= bx2) & (by1 <= cy) & (cy <= by2)


def overlaps(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Strictly: touching edges don't."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = map(_c, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def ratio(part: Column, whole: Column) -> Column:
    """0 where whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(0.0)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp.cast("double"), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp.cast("double"), tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def sqrt_area(w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.sqrt(F.greatest(w * width, F.lit(0.0)) * F.greatest(h * height, F.lit(0.0)))


def apparent_size(native_px: Column, length_m: Column, gsd: Column, least: float | None = None) -> Column:
    """Pixels of an animal pasted at its size or smaller; null below ``least``, and without a GSD or native pixels."""
    share = (length_m / F.nullif(gsd, F.lit(0.0))) / F.nullif(native_px, F.lit(0.0))
    size = F.when(share.isNotNull(), native_px * F.least(share, F.lit(1.0)))
    return size if least is None else F.when(size >= least, size)


def edge_flush_origins(total: Column, tile: Column) -> Column:
    """0, tile, 2 tile, ... and the origin whose tile ends at the edge; only 0 if one tile covers everything."""
    grid = F.sequence(F.lit(0), total - tile, tile)
    return F.when(tile >= total, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(grid, F.array(total - tile))))


def grid_cells(n: Column, width: Column, height: Column) -> Column:
    """(row, column) of n things in a grid of about the image's proportions."""
    cols = F.greatest(F.ceil(F.sqrt(n * width / height)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.floor(i / cols).cast("int").alias("row"), (i % cols).cast("int").alias("column")))
