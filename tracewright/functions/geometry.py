"""Boxes, normalised coordinates and affine maps as Column expressions.

A box is a struct (x, y, w, h), origin top left. Rounding is half to even throughout (rint).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.config import NORM


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def norm_to_px(v: Column, dim: Column) -> Column:
    return v / F.lit(NORM) * dim


def px_to_norm(v: Column, dim: Column) -> Column:
    return v / dim * F.lit(NORM)


def point_to_px(v: Column, dim: Column) -> Column:
    """A normalised coordinate in pixels, kept within the page."""
    return F.least(F.greatest(norm_to_px(v, dim), F.lit(0.0)), dim.cast("double"))


def _span(a: Column, b: Column, dim: Column, least: int) -> tuple[Column, Column]:
    """Start and length on one axis: edges in order, rounded, within the page, and at least `least` long (grown onward, then back)."""
    lo = F.greatest(F.lit(0).cast("long"), F.rint(norm_to_px(F.least(a, b), dim)).cast("long"))
    hi = F.least(dim.cast("long"), F.rint(norm_to_px(F.greatest(a, b), dim)).cast("long"))
    short = hi - lo < least
    grown = F.when(short, F.least(dim.cast("long"), lo + least)).otherwise(hi)
    begin = F.when(short, F.greatest(F.lit(0).cast("long"), grown - least)).otherwise(lo)
    return begin, grown - begin


def box_from_norm(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, least: int = 10) -> Column:
    x, w = _span(x0, x1, width, least)
    y, h = _span(y0, y1, height, least)
    return box(x, y, w, h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    ix = F.greatest(F.lit(0).cast("long"), F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0).cast("long"), F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - ix * iy
    return F.when(union > 0, (ix * iy) / F.when(union > 0, union)).otherwise(0.0)


def expand(b: Column, mx: Column, my: Column, width: Column, height: Column) -> Column:
    """Grown by a margin on all sides, within the page."""
    x0, y0 = F.greatest(F.lit(0).cast("long"), b["x"] - mx), F.greatest(F.lit(0).cast("long"), b["y"] - my)
    return box(x0, y0, F.least(width, right(b) + mx) - x0, F.least(height, bottom(b) + my) - y0)


def crop_box(b: Column, width: Column, height: Column, margin: float = 0.12) -> Column:
    """The calibration crop: labels often stand outside a panel's box."""
    part = lambda v: (F.lit(margin) * v).cast("long")
    return expand(b, part(b["w"]), part(b["h"]), width, height)


def margin_crop_box(b: Column, width: Column, height: Column, edge: Column, margin: float = 0.12, inward: float = 0.05) -> Column:
    """The crop of an edge panel, out to the page's margin on its side ('left' or another)."""
    my, mx = (F.lit(margin) * b["h"]).cast("long"), (F.lit(inward) * b["w"]).cast("long")
    y0 = F.greatest(F.lit(0).cast("long"), b["y"] - my)
    h = F.least(height, bottom(b) + my) - y0
    x0 = F.greatest(F.lit(0).cast("long"), b["x"] - mx)
    left = box(F.lit(0), y0, F.least(width, right(b) + mx), h)
    return F.when(edge == "left", left).otherwise(box(x0, y0, width - x0, h))


def clamp_plot(plot: Column, b: Column, least_share: float = 0.25) -> Column:
    """The plot area within its panel; one that is too small a part of it gives way to the panel's box."""
    x0, y0 = F.least(F.greatest(plot["x"], b["x"]), right(b) - 1), F.least(F.greatest(plot["y"], b["y"]), bottom(b) - 1)
    x1, y1 = F.greatest(F.least(right(plot), right(b)), x0 + 1), F.greatest(F.least(bottom(plot), bottom(b)), y0 + 1)
    inside = box(x0, y0, x1 - x0, y1 - y0)
    return F.when((x1 - x0) * (y1 - y0) < least_share * b["w"] * b["h"], box(b["x"], b["y"], b["w"], b["h"])).otherwise(inside)


def page_to_tile(v: Column, crop: Column, scale: Column) -> Column:
    return (v - crop) * scale


def tile_to_page(v: Column, crop: Column, scale: Column) -> Column:
    return v / scale + crop


def plot_extent(area: Column, crop_x: Column, x_scale: Column, tile_width: Column) -> tuple[Column, Column]:
    """A plot area's left and right edge in its tile, within the tile."""
    a, b = page_to_tile(area["x"].cast("double"), crop_x, x_scale), page_to_tile(right(area).cast("double"), crop_x, x_scale)
    return F.greatest(F.lit(0.0), F.least(a, b)), F.least(tile_width.cast("double"), F.greatest(a, b))


def rotation(degrees: Column) -> Column:
    """To 0, 90, 180 or 270."""
    turn = F.pmod(degrees.cast("double"), F.lit(360.0))
    return F.pmod(F.rint(turn / 90) * 90, F.lit(360.0)).cast("int")


def centre_edges(centre: Column, size: Column, dim: Column) -> tuple[Column, Column]:
    """Both edges in pixels of a box given by its normalised centre and size."""
    return (centre - size / 2) * dim, (centre + size / 2) * dim


def days_off(edge: Column, truth: Column, width: Column, days: Column) -> Column:
    """An edge's error in days, where the width spans so many."""
    return (edge - truth) / (width / days)


def tile_box(plot: Column, page_w: Column, page_h: Column, margin: float) -> Column:
    """A tile's box on its page: the plot area with a padding of at least four pixels, within the page."""
    pad = lambda size: F.greatest(F.lit(4), F.floor(margin * size)).cast("long")
    return expand(plot, pad(plot["w"]), pad(plot["h"]), page_w, page_h) if margin > 0 else plot


def tile_transform(area: Column, stretch: float = 1.0) -> Column:
    """Where a tile begins on its page, its scales, and its size in pixels."""
    return F.struct(
        area["x"].cast("double").alias("crop_x"), area["y"].cast("double").alias("crop_y"), F.lit(
            float(stretch)
        ).alias("x_scale"), F.lit(1.0).alias("y_scale"),
        F.greatest(F.lit(1), F.rint(area["w"] * stretch)).cast("int").alias("width"), area["h"].cast("int").alias("height"),
    )


def crop_to_page(v: Column, start: Column, size: Column) -> Column:
    """A normalised position within a crop, in pixels of the page."""
    return start + v / 1000.0 * size
