"""Digitised series: values in native units and millimetres, annual stitching, QC routing, hints and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import units
from tracewright.operators.fit import value_at


def physical(series: DataFrame, raw_unit: Column, dated: bool = True) -> DataFrame:
    """value_native, native_unit and value_mm of densified series (y_corrected, slope, intercept, scale, x_key); gaps stay null."""
    value = value_at(F.col("slope"), F.col("intercept"), F.col("y_corrected"), F.col("scale"))
    out = series.withColumn("value_native", F.when(~F.col("flagged"), value)).withColumn(
        "native_unit", F.when(~F.col("flagged"), units.in_force(raw_unit, F.col("x_key"), dated))
    )
    return out.withColumn("value_mm", units.to_mm(F.col("value_native"), F.col("native_unit")))


def stitch(rows: DataFrame, by: list[str]) -> DataFrame:
    """One series of each group's panels: of rows with one key the last panel's stands; groups need two panels.

    rows: by, panel_ord, x_key (ISO date), value. Adds overlaps (rows that gave way).
    """
    many = F.size(F.collect_set("panel_ord").over(Window.partitionBy(*by))) >= 2
    kept = rows.withColumn("_many", many).where("_many").groupBy(*by, "x_key").agg(
        F.max_by(F.struct("value", "panel_ord"), "panel_ord").alias("r"), (F.count("*") - 1).alias("overlaps")
    )
    return kept.select(*by, "x_key", "r.value", "r.panel_ord", "overlaps")


def continuity(stitched: DataFrame, by: list[str]) -> DataFrame:
    """Days, missing days between first and last, gaps (no value) and overlaps of each stitched series."""
    day = F.to_date("x_key")
    return stitched.groupBy(*by).agg(
        F.min("x_key").alias("first_key"), F.max("x_key").alias("last_key"), F.count("*").alias("n"), (
            F.date_diff(F.max(day), F.min(day)) + 1 - F.count("*")
        ).alias("missing"), F.count_if(F.col("value").isNull()).alias("gaps"), F.sum("overlaps").alias("overlaps")
    )


def qc_action(verdict: Column) -> Column:
    return F.when(verdict == "ok", "accept").when(verdict == "major", "reextract").otherwise("review")


def override(hint: Column, model: Column) -> tuple[Column, Column]:
    """The hint where there is one, and whether it differs from what the model had read (an empty reading does not count)."""
    given = hint.isNotNull() & (hint.cast("string") != "")
    read = model.isNotNull() & ~model.cast("string").isin("", "0")
    return F.when(given, hint).otherwise(model), F.coalesce(given & read & (hint != model), F.lit(False))


def panel_hints(panels: DataFrame, hints: DataFrame, page: list[str]) -> DataFrame:
    """panels (page, place, month) with its hint: one for its month, else one for its position.

    hints: page, h_month, h_index, h_ord, hint. Of several the first (h_ord) stands. One join on the page, then a choice.
    """
    keyed = panels.join(hints, page, "left")
    by_month = F.col("month").isNotNull() & (F.col("h_month") == F.col("month"))
    way = F.when(by_month, 1).when(F.col("h_index") == F.col("place"), 2)
    own = panels.columns
    return keyed.groupBy(*own).agg(
        F.min(F.when(way.isNotNull(), F.struct(way.alias("way"), "h_ord", "hint"))).alias("h")
    ).select(*own, F.col("h.hint").alias("hint"), F.col("h.way").alias("way"))


def flag_rows(*parts: DataFrame) -> DataFrame:
    """Review flags of all stages as one table (stage, ref, reason, severity): rows are appended, nothing is locked."""
    return reduce(DataFrame.unionByName, parts)


def gaps(series: DataFrame, by: list[str]) -> DataFrame:
    """by, n_gaps, gaps: the keys at which a series has no sample, in order."""
    empty = F.array_sort(F.collect_list(F.when(F.col("flagged"), F.struct("slice", "x_key"))))
    return series.groupBy(*by).agg(F.transform(empty, lambda e: e["x_key"]).alias("gaps")).withColumn("n_gaps", F.size("gaps").cast("long"))


def chain_of_panels(panels: DataFrame, by: list[str], used: str) -> DataFrame:
    """A stitched series' confidences: the least of its panels' chains (a map), and whether any panel's baseline was applied."""
    least = [F.min(F.col("chain")[c]).alias(c) for c in ("panel", "calibration", "extraction", "coverage")]
    return panels.groupBy(*by).agg(*least, F.bool_or(used).alias("baseline_applied"), F.count("*").alias("n"))
