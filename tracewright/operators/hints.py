"""Hints as tables: panels drawn by hand instead of detected ones, and annotations of a sheet as hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import geometry, units
from tracewright.functions.columns import let
from tracewright.operators import axes

# Fixed value: the flag of a panel that a hint has drawn.
BOX_FLAG = "user_hint:bbox"
PANEL_COLUMNS = ("run_id", "panel", "label", "box", "plot", "x_start", "x_end", "confidence", "flags")


def _within(edges: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h) as given, cut off at the page's edges; null if there is none. An array of another length is an error."""
    wrong = F.raise_error(F.lit("a box of a hint has four numbers")).cast("bigint")
    side = lambda i: F.when(F.size(edges) == 4, F.get(edges, F.lit(i)).cast("bigint")).otherwise(wrong)

    def cut(start: Column, length: Column, whole: Column) -> tuple[Column, Column]:
        begin = F.greatest(F.lit(0).cast("bigint"), start)
        return begin, F.least(length, whole - begin)

    (x, w), (y, h) = cut(side(0), side(2), width), cut(side(1), side(3), height)
    return F.when(F.size(F.coalesce(edges, F.array().cast("array<int>"))) > 0, geometry.box(x, y, w, h))


def hint_panels(hints: DataFrame, pages: DataFrame) -> DataFrame:
    """PANEL_COLUMNS of the panels that hints draw, in the order of their index.

    hints: run_id, panels (of artifacts.read_hints). pages: run_id, width, height. Hints without an index come first and
    are numbered by their place among all of the run's hints, drawn or not. Without a plot area the panel's box is it.
    """
    place = F.transform(F.col("panels"), lambda p, i: F.struct(F.coalesce(p["index"], F.lit(0)).alias("at"), i.alias("i"), p.alias("p")))
    rows = hints.join(pages.select("run_id", "width", "height"), "run_id").select(
        "run_id", "width", "height", F.posexplode(F.array_sort(place)).alias("n", "h")
    )
    p = F.col("h.p")
    box, plot = (_within(p[c], F.col("width"), F.col("height")) for c in ("bbox_px", "plot_area_px"))
    number = F.coalesce(F.nullif(p["index"], F.lit(0)), F.col("n") + 1).cast("string")
    text = lambda c: F.coalesce(p[c], F.lit(""))
    name = F.concat(F.lit("p"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    drawn = rows.withColumn("box", box).where(F.col("box").isNotNull())
    return drawn.select(
        "run_id", name.alias("panel"), text("label").alias("label"), "box", F.coalesce(
            plot, F.col("box")
        ).alias("plot"), text("x_start").alias("x_start"), text("x_end").alias("x_end"),
        F.lit(1.0).alias("confidence"), F.array(F.lit(BOX_FLAG)).alias("flags"),
    )


def panels_of(detected: DataFrame, hints: DataFrame, pages: DataFrame) -> DataFrame:
    """PANEL_COLUMNS: a run's drawn panels where its hints have any, else the detected ones (of those columns)."""
    drawn = hint_panels(hints, pages)
    rest = detected.join(drawn.select("run_id").distinct(), "run_id", "left_anti")
    return drawn.unionByName(rest.select(*PANEL_COLUMNS))


def from_annotations(pages: DataFrame, boxes: DataFrame, wanted: DataFrame) -> DataFrame:
    """scan_id, year, month, hints: annotations of sheets (artifacts.read_month_annotations) as hints.

    wanted: scan_id, year, month and tile_h, the height of that month's tile; a null month asks for the whole sheet, whose
    anchors stay in its own rows. The anchors are January's edges, or, in a month's tile, where these rows are in it.
    """
    edges = boxes.join(pages.select("scan_id", "height", "low_value", "high_value"), "scan_id")
    half = F.col("h") / 2
    edges = edges.select(
        "scan_id",
        "month",
        ((F.col("cy") - half) * F.col("height")).alias("y0"),
        ((F.col("cy") + half) * F.col("height")).alias("y1"),
        "low_value",
        "high_value"
    )
    january = edges.where("month = 1").select("scan_id", F.col("y1").alias("c_low"), F.col("y0").alias("c_high"), "low_value", "high_value")
    months = edges.groupBy("scan_id").agg(F.array_sort(F.collect_set("month")).alias("months"))
    own = wanted.join(january, "scan_id").join(months, "scan_id")
    placed = own.join(edges.select("scan_id", "month", "y0", "y1"), ["scan_id", "month"], "left")
    placed = axes.tile_rows(placed, ["scan_id"])
    one = F.col("month").isNotNull()
    first = F.make_date(F.col("year"), F.coalesce("month", F.lit(1)), F.lit(1))
    hint = lambda **known: F.struct(*(v.alias(k) for k, v in known.items()))
    tile = F.array(hint(index=F.lit(1), month=F.col("month"), x_start=first.cast("string"), x_end=F.last_day(first).cast("string")))
    sheet = F.transform("months", lambda m: hint(index=m, month=m, x_start=F.lit(None).cast("string"), x_end=F.lit(None).cast("string")))
    panels = F.when(one, tile).otherwise(sheet)
    anchor = lambda row, value: F.struct(
        F.when(one, F.col(f"tile_{row}")).otherwise(F.col(f"c_{row}")).alias("pixel"), F.col(value).alias("value")
    )
    note = F.concat(F.lit("from the month annotations of "), "scan_id")
    made = let(
        panels,
        lambda ps: hint(
            station=F.substring(
                "scan_id", 1, 2
            ), year=F.col("year"), unit=units.by_date(first), y_scale=F.lit("linear"), rotation_deg=F.lit(0), expected_panels=F.size(ps),
            panel_layout=F.when(F.size(ps) > 1, "row").otherwise("single"), y_anchors=F.array(
                anchor("low", "low_value"), anchor("high", "high_value")
            ), panels=ps, notes=note,
        ),
    )
    return placed.select("scan_id", "year", "month", F.from_json(F.to_json(made), schemas.HINTS).alias("hints"))


def save(rows: DataFrame, path: str, key: str) -> None:
    """Each row's hints as a JSON file of its own below key=..., which artifacts.read_hints reads back strictly. key is unique."""
    rows.select(key, F.to_json("hints").alias("value")).write.partitionBy(key).mode("overwrite").text(path)
