"""Rasters as (tile, row, col, gray) tables: column strengths, masks to polylines, ridge refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_strength(raster: DataFrame, by: list[str]) -> DataFrame:
    """by, col, s: the sum over rows of the absolute horizontal gradient (3 x 3, weights 1 2 1 down the rows).

    Rows and columns beyond the border mirror the ones inside it, so border columns have no gradient.
    """
    across = Window.partitionBy(*by, "row").orderBy("col")
    down = Window.partitionBy(*by, "col").orderBy("row")
    g = raster.withColumn("d", F.coalesce(F.lead("gray").over(across) - F.lag("gray").over(across), F.lit(0.0)))
    up, below = F.lag("d").over(down), F.lead("d").over(down)
    g = g.withColumn("up", F.coalesce(up, below, F.col("d"))).withColumn("below", F.coalesce(below, up, F.col("d")))
    return g.groupBy(*by, "col").agg(F.sum(F.abs(F.col("up") + 2 * F.col("d") + F.col("below"))).alias("s"))


def mask_to_polyline(raster: DataFrame, by: list[str], level: float) -> DataFrame:
    """by, x, y: the mean row of each column's pixels above the level."""
    return raster.where(F.col("gray") > level).groupBy(*by, F.col("col").alias("x")).agg(F.avg("row").alias("y"), F.count("*").alias("n"))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Luma in whole numbers, as 16-bit fixed point."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16)


def refine_ridges(raster: DataFrame, seeds: DataFrame, by: list[str], window: int = 25, strip: int = 3) -> DataFrame:
    """seeds (by, seed, x, y) with new_y: the darkest row near the seed, between rows by a parabola; y itself without a clear dip.

    The profile is the mean gray of a strip around x for each row within the window, smoothed by (1 4 6 4 1) / 16. A seed
    outside of the image looks from the nearest pixel inside.
    """
    size = raster.groupBy(*by).agg(F.max("col").alias("last_col"), F.max("row").alias("last_row"))
    inside = lambda c, last: F.greatest(F.lit(0), F.least(F.rint(F.col(c)).cast("int"), F.col(last).cast("int")))
    xi, yi = inside("x", "last_col"), inside("y", "last_row")
    # A seed asks for its own columns only: pixels meet it by tile and column, not by tile.
    asked = seeds.join(size, by).select(*by, "seed", "x", "y", yi.alias("_yi"), F.explode(F.sequence(xi - strip, xi + strip)).alias("col"))
    near = raster.join(asked, [*by, "col"]).where(F.col("row").between(F.col("_yi") - window, F.col("_yi") + window))
    profile = near.groupBy(*by, "seed", "x", "y", "row").agg(F.avg("gray").alias("v"))
    key = [*by, "seed", "x", "y"]
    o = Window.partitionBy(*key).orderBy("row")
    n = F.count("*").over(Window.partitionBy(*key))
    profile = profile.withColumn("i", F.row_number().over(o)).withColumn("n", n)
    # Mirrored borders: row 1 - k stands for row 1 + k.
    arrays = profile.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda p: p["v"]).alias("v"), F.min("row").alias("top")
    )

    def smooth(v: Column, i: Column) -> Column:
        m = F.size(v) - 1
        place = lambda j: F.get(v, (m - F.abs(m - F.abs(j))).cast("int"))
        return (place(i - 2) + 4 * place(i - 1) + 6 * place(i) + 4 * place(i + 1) + place(i + 2)) / 16

    arrays = arrays.withColumn("s", F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: smooth(F.col("v"), i)))
    total = F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / total
    arrays = arrays.withColumn("mean", mean).withColumn("low", F.array_min("s"))
    spread = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / total)
    arrays = arrays.withColumn("spread", spread).withColumn("at", F.array_position("s", F.col("low")).cast("int") - 1)
    a, b, c = F.get("s", F.col("at") - 1), F.get("s", F.col("at")), F.get("s", F.col("at") + 1)
    bend = a - 2 * b + c
    inside = (F.col("at") > 0) & (F.col("at") < total - 1) & (F.abs(bend) > 1e-9)
    exact = F.col("at") + F.when(inside, 0.5 * (a - c) / F.when(inside, bend)).otherwise(0.0)
    clear = (total >= 3) & (F.col("spread") >= 1e-3) & (F.col("mean") - F.col("low") >= 0.5 * F.col("spread"))
    found = arrays.select(*by, "seed", F.when(clear, F.col("top") + exact).alias("found"))
    return seeds.join(found, [*by, "seed"], "left").withColumn("new_y", F.coalesce("found", F.col("y").cast("double"))).drop("found")


def crop(raster: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """The pixels of a box, with rows and columns from its corner."""
    inside = raster.where((F.col("col") >= x) & (F.col("col") < x + w) & (F.col("row") >= y) & (F.col("row") < y + h))
    return inside.withColumn("row", F.col("row") - y).withColumn("col", F.col("col") - x)


def rotate(raster: DataFrame, by: list[str], degrees: Column) -> DataFrame:
    """Images turned counter-clockwise by a multiple of 90 degrees: an index of each pixel, no resampling."""
    size = raster.groupBy(*by).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    q, r, c = F.pmod(F.rint(degrees / 90), F.lit(4)).cast("int"), F.col("row"), F.col("col")
    row = F.when(q == 1, F.col("last_col") - c).when(q == 2, F.col("last_row") - r).when(q == 3, c).otherwise(r)
    col = F.when(q == 1, r).when(q == 2, F.col("last_col") - c).when(q == 3, F.col("last_row") - r).otherwise(c)
    return raster.join(size, by).select(
        *by, row.alias("row"), col.alias("col"), *(x for x in raster.columns if x not in (*by, "row", "col"))
    )


def _cubic(t: Column) -> Column:
    """The cubic convolution kernel with a = -1/2."""
    d = F.abs(t)
    near, far = (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2
    return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)


def stretch(raster: DataFrame, by: list[str], factor: Column | float, whole: bool = False) -> DataFrame:
    """Images of round(width x factor) columns, at least one, by cubic convolution along their rows; `col` and `gray` are new.

    A new column looks at the old ones within two columns (two new ones where the image shrinks) of its own middle; at the
    borders the weights of those that exist are made to sum to one. whole: to 0 to 255, rounded. A row of pixels is one
    array; its columns count from 0 in their order. One shuffle, as many rows as there are pixels.
    """
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    sized = raster.groupBy(*by, "row").agg(
        F.array_sort(F.collect_list(F.struct("col", F.col("gray").cast("double").alias("gray")))).alias("p"), F.max(factor).alias("factor")
    )
    width = F.size("p")
    new = F.greatest(F.lit(1), F.bround(width * F.col("factor")).cast("int"))
    rows = sized.select(*by, "row", F.transform("p", lambda q: q["gray"]).alias("v"), width.alias("old"), new.alias("new"))
    scale = F.col("old") / F.col("new")
    wide = F.greatest(scale, F.lit(1.0))

    def at(j: Column) -> Column:
        middle = (j + 0.5) * scale
        first = F.greatest(F.lit(0), (middle - 2 * wide + 0.5).cast("int"))
        last = F.least(F.col("old"), (middle + 2 * wide + 0.5).cast("int")) - 1
        taps = F.transform(
            F.sequence(first, last), lambda i: F.struct(_cubic((i - middle + 0.5) / wide).alias("w"), F.get("v", i).alias("v"))
        )
        total = F.aggregate(
            taps,
            F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("w")),
            lambda s, t: F.struct((s["a"] + t["w"] * t["v"]).alias("a"), (s["w"] + t["w"]).alias("w"))
        )
        return F.element_at(F.transform(F.array(total), lambda s: s["a"] / s["w"]), 1)

    out = rows.select(*by, "row", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("new") - 1), at)).alias("col", "gray"))
    rounded = F.least(F.greatest(F.floor(F.col("gray") + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return out.withColumn("gray", rounded) if whole else out
