"""Backends that find curves in tiles, by name: tables in, candidate points out, with the schema checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegralType, NumericType, StringType

from tracewright.operators import candidates as cd
from tracewright.operators import raster

#: Columns of candidate points, and what they may be.
POINTS = {
    "tile": (StringType, IntegralType),
    "cand": (IntegralType,),
    "ord": (IntegralType,),
    "x": (DoubleType,),
    "y": (DoubleType,),
    "confidence": (NumericType,)
}

Backend = Callable[..., DataFrame]
_BACKENDS: dict[str, Backend] = {}


def register(name: str) -> Callable[[Backend], Backend]:
    """Makes a function of tiles (and its own parameters) a backend of that name; a name is given once."""

    def add(f: Backend) -> Backend:
        if name in _BACKENDS:
            raise ValueError(f"there is a backend {name!r} already")
        _BACKENDS[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_BACKENDS)


def checked(points: DataFrame, name: str) -> DataFrame:
    """points with the columns of POINTS in order; ValueError names those that are missing or of another kind."""
    found = {f.name: f.dataType for f in points.schema}
    wrong = [
        f"{c} is missing" if c not in found else f"{c} is {found[c].simpleString()}" for c,
        kinds in POINTS.items() if not isinstance(found.get(c), kinds)
    ]
    if wrong:
        raise ValueError(f"backend {name!r}: " + ", ".join(wrong))
    return points.select(*POINTS)


def extract(name: str, tiles: DataFrame, **parameters) -> DataFrame:
    """The points that a backend finds in tiles (tile, row, col, gray)."""
    if name not in _BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(names())}")
    return checked(_BACKENDS[name](tiles, **parameters), name)


def extract_with_fallback(
    first: str, second: str, tiles: DataFrame, viable: Callable[[DataFrame], DataFrame], parameters: dict | None = None
) -> DataFrame:
    """Points of both backends, `pool` telling which: the second one sees only tiles of which the first's points are not viable.

    viable: points to the tiles (tile) that need no more. The second's candidates are numbered on from the first's.
    """
    parameters = parameters or {}
    own = extract(first, tiles, **parameters.get(first, {}))
    rest = tiles.join(viable(own).select("tile").distinct(), "tile", "left_anti")
    return cd.merge_pools(own, extract(second, rest, **parameters.get(second, {})), ["tile"])


@register("mask")
def mask(tiles: DataFrame, level: float = 128.0) -> DataFrame:
    """One curve a tile: the middle of the pixels above a level in every column; confidence is the share of columns that have any."""
    line = raster.mask_to_polyline(tiles, ["tile"], level)
    width = tiles.groupBy("tile").agg((F.max("col") + 1).alias("w"))
    share = line.groupBy("tile").agg(F.count("*").alias("n")).join(width, "tile").select(
        "tile", (F.col("n") / F.col("w")).alias("confidence")
    )
    return line.join(share, "tile").select(
        "tile",
        F.lit(0).cast("bigint").alias("cand"),
        F.col("x").cast("bigint").alias("ord"),
        F.col("x").cast("double").alias("x"),
        "y",
        "confidence"
    )


@register("ridge")
def ridge(tiles: DataFrame) -> DataFrame:
    """One curve a tile: the brightest row of every column, the topmost of several; confidence is how far it stands out from the column's mean."""
    best = tiles.groupBy("tile", "col").agg(
        F.max_by(F.struct("row", "gray"), F.struct("gray", -F.col("row"))).alias("b"),
        F.avg("gray").alias("mean"),
        F.min("gray").alias("low")
    )
    lead = F.coalesce(F.try_divide(F.col("b.gray") - F.col("mean"), F.col("b.gray") - F.col("low")), F.lit(0.0))
    rows = best.withColumn("lead", lead)
    share = rows.groupBy("tile").agg(F.avg("lead").alias("confidence"))
    return rows.join(share, "tile").select(
        "tile",
        F.lit(0).cast("bigint").alias("cand"),
        F.col("col").cast("bigint").alias("ord"),
        F.col("col").cast("double").alias("x"),
        F.col("b.row").cast("double").alias("y"),
        "confidence"
    )


@udtf(returnType="tile string, ord bigint, x double, y double")
class MaskCurve:
    """mask_curve(TABLE(tiles) PARTITION BY (tile), level): the mask backend for SQL; tiles: tile, row, col, gray. State is a column's sums."""

    def __init__(self):
        self.tile, self.sums = None, {}

    def eval(self, pixel, level):
        self.tile = str(pixel["tile"])
        if pixel["gray"] is not None and pixel["gray"] > level:
            total, n = self.sums.get(pixel["col"], (0.0, 0))
            self.sums[pixel["col"]] = (total + pixel["row"], n + 1)

    def terminate(self):
        for col, (total, n) in sorted(self.sums.items()):
            yield self.tile, int(col), float(col), total / n


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("mask_curve", MaskCurve)
