"""Calendar months of a sheet's panels: assignment, width checks, and layout of pseudo pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates
from tracewright.functions.columns import let


def assign(panels: DataFrame, page: list[str], quorum: float = 0.66) -> DataFrame:
    """month of each panel: the hint, else the label's, else (too few, or out of order) its position.

    panels: page, place (reading order), hint_month, label_month. Adds positional and mismatch.
    """
    w = Window.partitionBy(*page)
    own = F.coalesce("hint_month", "label_month")
    out = panels.withColumn("own", own)
    before = F.last("own", ignorenulls=True).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("rising", F.coalesce(F.col("own") > before, F.lit(True)))
    n, known = F.count("*").over(w), F.count("own").over(w)
    least = F.greatest(F.lit(1.0), F.rint(quorum * n))
    by_place = (n > 1) & ((known < least) | ~F.bool_and("rising").over(w))
    out = out.withColumn("positional", by_place)
    mismatch = F.col("hint_month").isNotNull() & F.col("label_month").isNotNull() & (F.col("hint_month") != F.col("label_month"))
    return out.withColumn(
        "month", F.when(F.col("positional"), F.col("place")).otherwise(F.col("own")).cast("int")
    ).withColumn("mismatch", mismatch).drop("own", "rising")


def width_outliers(panels: DataFrame, page: list[str], tolerance: float = Gates.month_days) -> DataFrame:
    """panels (page, width, days) with days_est by the page's median pixels a day, and outlier; pages need three panels."""
    w = Window.partitionBy(*page)
    ppd = F.try_divide(F.col("width").cast("double"), F.col("days"))
    out = panels.withColumn("median_ppd", F.median(ppd).over(w)).withColumn("n", F.count(ppd).over(w))
    out = out.withColumn("days_est", F.try_divide(F.col("width"), F.col("median_ppd")))
    return out.withColumn("outlier", (F.col("n") >= 3) & (F.abs(F.col("days_est") - F.col("days")) > tolerance)).drop("n")


def layout(tiles: DataFrame, page: list[str]) -> DataFrame:
    """tiles (page, month, w, h) pasted side by side, bottom aligned: their x, y and the page's size."""
    w = Window.partitionBy(*page)
    x = F.coalesce(F.sum("w").over(w.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tiles.withColumn("x", x).withColumn("page_h", F.max("h").over(w)).withColumn(
        "y", F.col("page_h") - F.col("h")
    ).withColumn("page_w", F.sum("w").over(w))


def month_of(points: DataFrame, extents: DataFrame, page: list[str], px: str = "px") -> DataFrame:
    """points with the first month whose extent [x0, x1] holds them (left out where none does); extents: page, month, x0, x1.

    A page has twelve extents at most: they are one array, and every point, repeated ones too, looks its own up.
    """
    of_page = extents.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("month", "x0", "x1"))).alias("extents"))
    first = F.get(F.filter("extents", lambda e: (e["x0"] <= F.col(px)) & (F.col(px) <= e["x1"])), F.lit(0))
    return points.join(of_page, page).withColumn("e", first).where(F.col("e").isNotNull()).select(*points.columns, "e.*")


def nearest_peak(strength: DataFrame, by: list[str], edge: Column, window: Column, level: float = 0.5) -> DataFrame:
    """by, snapped: the strong local maximum nearest to the proposed edge within the window; the edge itself without one.

    strength: by, col, s. Maxima are at least `level` of the window's greatest value and inside the window; ties go left.
    """
    inside = strength.withColumn("edge", edge).where((F.col("col") >= F.col("edge") - window) & (F.col("col") <= F.col("edge") + window))
    w = Window.partitionBy(*by)
    o = w.orderBy("col")
    near = inside.withColumn("before", F.lag("s").over(o)).withColumn("after", F.lead("s").over(o)).withColumn("top", F.max("s").over(w))
    peak = (F.col("s") >= level * F.col("top")) & (F.col("s") >= F.col("before")) & (F.col("s") >= F.col("after"))
    best = F.min(F.when(peak, F.struct(F.abs(F.col("col") - F.col("edge")).alias("d"), F.col("col").alias("at"))))
    return near.groupBy(*by).agg(F.coalesce(best["at"], F.first("edge")).alias("snapped"))


def seams(strength: DataFrame, by: list[str], targets: DataFrame, window: Column, key: list[str] | None = None) -> DataFrame:
    """by, key, at: the strongest column around each target (by, key, target); of equal ones the first."""
    key = key or ["j"]
    hit = strength.join(targets, by).where((F.col("col") >= F.col("target") - window) & (F.col("col") <= F.col("target") + window))
    return hit.groupBy(*by, *key).agg(F.max_by("col", F.struct("s", -F.col("col"))).alias("at"))


def to_pseudo_page(points: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """points (page, x, y in pixels) where a pseudo page has them, in the first month whose box holds them by x.

    boxes: page, month, x0, x1, y0 (edges of the month's box), tile_x, tile_y, tile_w, tile_h (its tile there, with the box
    in its middle), y1. Points that no box holds are left out.
    """
    hit = month_of(points, boxes.select(*page, "month", "x0", "x1"), page, "x").drop("x0", "x1").join(boxes, [*page, "month"])
    centred = lambda tile, size, a, b: F.col(tile) + (F.col(size) - (F.col(b) - F.col(a))) / 2.0
    out = hit.withColumn(
        "new_x", centred("tile_x", "tile_w", "x0", "x1") + F.col("x") - F.col("x0")
    ).withColumn("new_y", centred("tile_y", "tile_h", "y0", "y1") + F.col("y") - F.col("y0"))
    return out.select(*points.columns, "month", "new_x", "new_y")


def seam_reach(w: Column, parts: Column) -> Column:
    """How far from its even place a cut is looked for: four columns at least, eight hundredths of a part else."""
    return F.greatest(F.lit(4), F.rint(0.08 * w / parts)).cast("long")


def seam_edges(x: Column, w: Column, parts: Column, strength: Callable[[Column], Column]) -> Column:
    """The edges of a box's parts, as cut_at_seams cuts it, from the row alone. strength: that of a column by its number."""
    reach = seam_reach(w, parts)

    def cut(target: Column) -> Column:
        low, high = F.greatest(x + 4, target - reach), F.least(x + w - 4, target + reach + 1) - 1
        near = F.transform(F.sequence(low, high), lambda c: F.struct(strength(c).alias("s"), (-c).alias("first")))
        return F.coalesce(F.when(low <= high, -F.array_max(near)["first"]), target)

    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda j: let(x + F.rint(j * w / parts).cast("long"), cut))
    inner = F.when(parts > 1, F.array_sort(cuts)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(x), inner, F.array(x + w))


def cut_at_seams(boxes: DataFrame, page: list[str], strength: DataFrame, of_box: bool = False) -> DataFrame:
    """boxes (page, pos, x, w, parts) cut into `parts`, each cut at the strongest column near its even place; adds part, x, w.

    strength: page (and pos, with of_box: the columns of each box's own rows), col, s. Cuts keep four columns away from the
    box's ends; of equal columns the first is taken, and a cut without columns stays even.
    """
    keys = [*page, "pos"]
    wide = boxes.where("parts > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    wide = wide.withColumn("target", F.col("x") + F.rint(F.col("j") * F.col("w") / F.col("parts")).cast("long"))
    reach = seam_reach(F.col("w"), F.col("parts"))
    low = F.greatest(F.col("x") + 4, F.col("target") - reach)
    high = F.least(F.col("x") + F.col("w") - 4, F.col("target") + reach + 1) - 1
    asked = wide.select(*keys, "j", low.alias("low"), high.alias("high"))
    near = strength.join(asked, keys if of_box else page).where(F.col("col").between(F.col("low"), F.col("high")))
    found = near.groupBy(*keys, "j").agg(F.max_by("col", F.struct("s", -F.col("col"))).alias("at"))
    cuts = wide.join(found, [*keys, "j"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.coalesce("at", "target"))).alias("cuts"))
    none = F.array().cast("array<bigint>")
    edges = F.concat(F.array("x"), F.coalesce("cuts", none), F.array(F.col("x") + F.col("w")))
    whole = boxes.join(cuts, keys, "left").withColumn("edges", edges)
    parts = whole.select(*keys, F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("part", "left"), "edges")
    return parts.select(
        *keys, (F.col("part") + 1).alias("part"), F.col("left").alias("x"), (F.get("edges", F.col("part") + 1) - F.col("left")).alias("w")
    )
