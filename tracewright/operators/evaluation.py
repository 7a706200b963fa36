"""Evaluation of calibrations and series against ground truth and published results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import fit, metrics


def level_map(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b: ground-truth level = a x grid value + b, by least squares over a page's pixels.

    pixels: by, c_y, level, and the page's human axis (slope, intercept). Pages whose grid values are all alike have nulls.
    """
    grid = pixels.withColumn("grid", fit.value_at(F.col("slope"), F.col("intercept"), F.col("c_y")))
    return grid.groupBy(*by).agg(F.regr_slope("level", "grid").alias("a"), F.regr_intercept("level", "grid").alias("b"))


def to_level(values: DataFrame, maps: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """values on the level scale of the ground truth; of pages without a map they stay."""
    return values.join(maps, by, "left").withColumn(value, F.coalesce(F.col("a") * F.col(value) + F.col("b"), F.col(value))).drop("a", "b")


def axis_errors(axes: DataFrame) -> DataFrame:
    """axes (slope, intercept, h_slope, h_intercept) with slope_err_pct and zero_px_err, the distance of their zero rows."""
    return axes.withColumn("slope_err_pct", F.try_divide(F.abs(F.col("slope") - F.col("h_slope")), F.abs(F.col("h_slope"))) * 100).withColumn(
        "zero_px_err", F.abs(fit.beta(F.col("slope"), F.col("intercept")) - fit.beta(F.col("h_slope"), F.col("h_intercept")))
    )


def induced_error(points: DataFrame, by: list[str]) -> DataFrame:
    """by, induced_rmse, induced_mae: what an axis (slope, intercept) instead of the human one makes of a curve's pixels."""
    e = fit.value_at(F.col("slope"), F.col("intercept"), F.col("pixel")) - fit.value_at(
        F.col("h_slope"), F.col("h_intercept"), F.col("pixel")
    )
    return points.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("induced_rmse"), F.avg(F.abs(e)).alias("induced_mae"))


def calibration_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Months, usable ones, median errors and the worst one of each run's calibrations (slope_err_pct null: unusable)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("slope_err_pct").alias("n_usable"), F.median("slope_err_pct").alias(
            "median_slope_err_pct"
        ), F.median("zero_px_err").alias("median_zero_px_err"),
        F.median("induced_mae").alias("median_induced_mae"), F.max("induced_mae").alias("worst_induced_mae"),
    )


def with_published(rows: DataFrame, published: DataFrame, by: list[str]) -> DataFrame:
    """rows with the published result of their scan and month, where there is one: the best of those marked best.

    Only where not a single published row is marked, the highest of all stands instead.
    """
    marked = F.coalesce(F.col("isBest") == "yes", F.lit(False))
    some = not published.where(marked).isEmpty()  # one bit
    best = metrics.best_rows(published.where(marked) if some else published, by, F.lit(True), [F.desc("peak_score"), F.col("rmse")])
    return rows.join(best.select(*by, F.col("peak_score").alias("paper_peak_score"), F.col("rmse").alias("paper_rmse")), by, "left")


def month_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over the months of a run; months without a value do not count."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(
            F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(f"mean_{c}") for c in (
                "rmse", "mae", "maxae", "pearson_r", "peak_score"
            )
        ),
        F.avg("paper_peak_score").alias("mean_paper_peak_score")
    )


def series_months(series: DataFrame, panels: DataFrame) -> DataFrame:
    """The first series of each panel with the panel's month; stitched ones are left out. series: run, key, panel, series_id."""
    own = series.where((F.col("series_id") == "s1") & ~F.col("key").startswith("annual"))
    return own.join(panels.where(F.col("month").isNotNull()).select("run", "panel", "month"), ["run", "panel"])


def gauge_names(rows: DataFrame, gauges: DataFrame, prefix: str = "DE_BY_DAN_") -> DataFrame:
    """rows (scan_id) with the station of their gauge, or the scan's first two digits. prefix: of the gauges' ids."""
    names = gauges.groupBy(F.col("gauge_id").alias("_gauge")).agg(F.min("name").alias("station"))
    own = F.substring("scan_id", 1, 2)
    return rows.withColumn(
        "_gauge", F.concat(F.lit(prefix), own)
    ).join(names, "_gauge", "left").withColumn("station", F.coalesce("station", own)).drop("_gauge")


def extractor_summary(selected: DataFrame, meta: DataFrame, verdicts: DataFrame) -> DataFrame:
    """run, coverage, tokens, verdicts of each run: mean coverage of its selected curves, tokens in all, 'panel:verdict' by panel.

    selected: run, coverage (null ones do not count). meta: run, key, value (text): the values of keys that begin with
    'tokens:' are added up as far as they are whole numbers. verdicts: run, panel, verdict. A run of any of the tables has
    a row; without tokens it has 0, without verdicts the empty string.
    """
    cover = selected.groupBy("run").agg(F.avg("coverage").alias("coverage"))
    spent = meta.groupBy("run").agg(F.sum(F.when(F.col("key").startswith("tokens:"), F.col("value").try_cast("bigint"))).alias("tokens"))
    told = F.expr("listagg(concat(panel, ':', verdict), ' ') WITHIN GROUP (ORDER BY panel, verdict)")
    judged = verdicts.groupBy("run").agg(told.alias("verdicts"))
    out = cover.join(spent, "run", "full").join(judged, "run", "full")
    return out.select(
        "run", "coverage", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("verdicts", F.lit("")).alias("verdicts")
    )
