"""Gates of a chart's way through the stages, and the review flags they raise. Flags are rows (stage, ref, reason, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates

# The kinds of charts that can be digitised.
LINE_CHARTS = ("line", "multi_line", "area")


def flags(rows: DataFrame, when: Column, stage: str, ref: Column, reason: Column, severity: str = "warning") -> DataFrame:
    """A flag for each row for which `when` holds."""
    return rows.where(when).select(
        F.lit(stage).alias("stage"), ref.cast("string").alias("ref"), reason.alias("reason"), F.lit(severity).alias("severity")
    )


def percent(share: Column, digits: int = 1) -> Column:
    """As printed in a flag."""
    return F.concat(F.format_string(f"%.{digits}f", share * 100), F.lit("%"))


def legible(rows: DataFrame) -> DataFrame:
    """Ticks or labels that could be read; those of which nothing is said count as read."""
    return rows.where(F.coalesce("legible", F.lit(True)) & F.col("value").isNotNull())


def visible_points(points: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """The visible points of traced curves, with `trace`: the confidence times the share of visible points. Curves with fewer than `least` are left out."""
    w = Window.partitionBy(*by)
    seen = F.count_if("visible").over(w)
    counted = points.withColumn("trace", F.col("confidence") * seen / F.count("*").over(w)).withColumn("_seen", seen)
    return counted.where(F.col("visible") & (F.col("_seen") >= least)).drop("_seen")


def panel_flags(panels: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """panels (page, panel, confidence) below the confidence gate: one flag for each page."""
    low = panels.groupBy("page").agg(F.count_if(F.col("confidence") < gates.panel_confidence).alias("n"))
    return flags(
        low, F.col("n") > 0, "triage", F.col("page"), F.concat(F.col("n").cast("string"), F.lit(" panel(s) below confidence gate"))
    )


def axis_flags(axes: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Flags of y axes as they are printed, with their figures. axes: those of axes.share, with n_ticks and value_range."""
    ref, text = F.col("panel"), F.format_string
    own = ~F.col("shared")
    relative = F.try_divide("rmse", F.nullif("value_range", F.lit(0.0)))
    rows = [
        flags(
            axes,
            F.col("slope").isNull(),
            "calibrate",
            ref,
            text("no usable axis fit (%d calibration points)", F.coalesce("n_ticks", F.lit(0))),
            "blocking"
        ),
        flags(
            axes, own & (F.col("method") == "two_anchor"), "calibrate", ref, F.lit("only 2 calibration points; using two-anchor mapping")
        ),
        flags(
            axes, own & (F.col("r2") < gates.least_r2), "calibrate", ref, text(f"axis fit r2=%.4f below gate {gates.least_r2}", F.col("r2"))
        ),
        flags(axes, own & (relative > gates.most_residual), "calibrate", ref, text("relative fit residual %.3f above gate", relative)),
        flags(axes, F.col("shared"), "calibrate", ref, F.concat(F.lit("y calibration shared from "), "donor"), "info"),
        flags(
            axes,
            F.col("inconsistent"),
            "calibrate",
            ref,
            F.concat(F.lit("y-fit slope differs from donor "), "donor", F.lit(" by "), percent(F.col("slope_off")))
        ),
    ]
    return reduce(DataFrame.unionByName, rows)


def page_flags(pages: DataFrame, expected: Column) -> DataFrame:
    """Flags of pages (page, kind, axis_labels, curve_labels, n_panels, n_series, n_labels)."""
    ref, known = F.col("page"), F.coalesce(expected, F.lit(0)) > 0
    rows = [
        flags(
            pages,
            ~F.col("kind").isin(*LINE_CHARTS),
            "triage",
            ref,
            F.concat(F.lit("classified as "), "kind", F.lit(": no line chart")),
            "blocking"
        ),
        flags(
            pages,
            ~F.col("axis_labels") & ~F.col("curve_labels"),
            "triage",
            ref,
            F.lit("no axis labels and no curve labels: no absolute calibration")
        ),
        flags(
            pages,
            known & (F.col("n_panels") != 1) & (F.col("n_panels") != expected),
            "triage",
            ref,
            F.concat(F.lit("expected 1 or "), expected.cast("string"), F.lit(" panels, got "), F.col("n_panels").cast("string"))
        ),
        flags(pages, F.col("n_panels") == 0, "triage", ref, F.lit("no chart panels detected"), "blocking"),
        flags(
            pages,
            F.col("n_series") > 1,
            "triage",
            ref,
            F.concat(F.lit("multi-series chart: "), F.col("n_series").cast("string"), F.lit(" curves")),
            "info"
        ),
        flags(
            pages, (F.col("n_series") == 1) & (F.col("n_labels") > 1), "triage", ref, F.lit("one curve but several legend labels"), "info"
        ),
    ]
    return reduce(DataFrame.unionByName, rows)


def refinement_flags(points: DataFrame, most: float = 12.0) -> DataFrame:
    """points (panel, y, new_y) of refined baselines: a flag for panels of which some moved more than `most` pixels."""
    moved = points.groupBy("panel").agg(F.count_if(F.abs(F.col("new_y") - F.col("y")) > most).alias("n"))
    return flags(moved, F.col("n") > 0, "baseline", F.col("panel"), F.concat(F.lit("large_refinement:"), F.col("n").cast("string")))


def baseline_usable(visible: Column, n_points: Column, beta: Column) -> Column:
    return F.coalesce(visible, F.lit(False)) & (n_points >= 2) & beta.isNotNull()


def extraction_flags(tiles: DataFrame) -> DataFrame:
    """tiles (tile, error, n_candidates)."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return flags(tiles, failed, "extract", F.col("tile"), F.concat(F.lit("extraction failed: "), "error"), "blocking").unionByName(
        flags(
            tiles,
            ~failed & (F.coalesce("n_candidates", F.lit(0)) == 0),
            "extract",
            F.col("tile"),
            F.lit("no polyline candidates returned"),
            "blocking"
        )
    )


def ready(panels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """panels (panel, cand, slope) that can become series, and flags of those that cannot: a missing curve is told before a missing axis."""
    no_curve, no_axis = F.col("cand").isNull(), F.col("slope").isNull()
    told = flags(panels, no_curve, "series", F.col("panel"), F.lit("no selected polyline"), "blocking").unionByName(
        flags(panels, ~no_curve & no_axis, "series", F.col("panel"), F.lit("no usable axis calibration"), "blocking")
    )
    return panels.where(~no_curve & ~no_axis), told


def edge_tags(panels: DataFrame, page: list[str]) -> DataFrame:
    """panels (panel, x) with edge: 'left' for a page's first by x, 'right' for its last; pages of one panel have none.

    Of equal x the panel's name decides; a page has it once. Ends are a page's least and greatest place, so that nothing
    is sorted within pages.
    """
    w, at = Window.partitionBy(*page), F.struct("x", "panel")
    left, right = at.eqNullSafe(F.col("_ends.a")), at.eqNullSafe(F.col("_ends.z"))
    ends = F.struct(F.count("*").over(w).alias("n"), F.min(at).over(w).alias("a"), F.max(at).over(w).alias("z"))
    return panels.withColumn("_ends", ends).withColumn(
        "edge", F.when(F.col("_ends.n") > 1, F.when(left, "left").when(right, "right"))
    ).drop("_ends")


def first_attempt(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Of several readings (by, attempt, failed, ticks) the first that did not fail and has ticks; by and attempt only, null without one."""
    good = ~F.coalesce("failed", F.lit(False)) & (F.size("ticks") > 0)
    return attempts.groupBy(*by).agg(F.min(F.when(good, F.struct("attempt", "ticks"))).alias("a")).select(
        *by, F.col("a.attempt").alias("attempt"), F.col("a.ticks").alias("ticks")
    )


def total_rotation(turns: Column, most: int = 3) -> Column:
    """(degrees, converged): the readings of a page's turn summed until one is zero, `most` turns at most."""
    step = lambda acc, d: F.when(acc["done"] | (acc["n"] >= most), acc).when(d == 0, F.struct(acc["deg"].alias("deg"), acc["n"].alias("n"), F.lit(True).alias("done"))).otherwise(
        F.struct(F.pmod(acc["deg"] + d, F.lit(360)).alias("deg"), (acc["n"] + 1).alias("n"), acc["done"].alias("done"))
    )
    start = F.struct(F.lit(0).alias("deg"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(turns, start, step, lambda acc: F.struct(acc["deg"].alias("degrees"), acc["done"].alias("converged")))


def confidence_chain(panel: Column, calibration: Column, extraction: Column, coverage: Column) -> Column:
    return F.create_map(
        F.lit("panel"),
        panel,
        F.lit("calibration"),
        calibration,
        F.lit("extraction"),
        extraction,
        F.lit("coverage"),
        F.coalesce(coverage, F.lit(0.0))
    )


def usage(rows: DataFrame, by: list[str], column: str = "usage") -> DataFrame:
    """by, key, total: maps of counts added up key by key."""
    return rows.select(*by, F.explode(column).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("total"))


def new_runs(after: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    return after.select(*key).distinct().join(before.select(*key).distinct(), key, "left_anti")


def listing(rows: DataFrame, name: str, most: int = 40) -> DataFrame:
    """The first names, in order: a report."""
    return rows.select(name).distinct().orderBy(name).limit(most)
