"""Axis calibration: least-squares lines, robust lines by repeated rejection, and what follows from them.

The robust fit keeps a group's ticks together as an array and folds over it inside the JVM: panels have few ticks, so a
single shuffle by panel replaces the two regressions and medians that each round would cost as windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates


def value_at(slope: Column, intercept: Column, pixel: Column, scale: Column | None = None) -> Column:
    line = slope * pixel + intercept
    return line if scale is None else F.when(scale == "log", F.pow(F.lit(10.0), line)).otherwise(line)


def pixel_at(slope: Column, intercept: Column, value: Column, scale: Column | None = None) -> Column:
    """Null on a flat axis."""
    v = value if scale is None else F.when(scale == "log", F.log10(value)).otherwise(value)
    return F.try_divide(v - intercept, slope)


def two_anchor(c_low: Column, v_low: Column, c_high: Column, v_high: Column) -> tuple[Column, Column]:
    """Slope and intercept of the line through two anchors (log values are to be given as logarithms)."""
    slope = F.try_divide(v_high - v_low, c_high - c_low)
    return slope, v_low - slope * c_low


def zero_pixel(c_low: Column, v_low: Column, c_high: Column, v_high: Column) -> Column:
    """The pixel at which the axis reads zero."""
    return c_low - F.try_divide(v_low, v_high - v_low) * (c_high - c_low)


def beta(slope: Column, intercept: Column) -> Column:
    """The ideal row of a printed zero line, from a fit."""
    return pixel_at(slope, intercept, F.lit(0.0))


def dedupe_ticks(ticks: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """The first tick of each rounded pixel and value."""
    first = Window.partitionBy(*by, F.rint("pixel"), "value").orderBy(order)
    return ticks.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ols(ticks: DataFrame, by: list[str]) -> DataFrame:
    return ticks.groupBy(*by).agg(
        F.regr_slope("value", "pixel").alias("slope"), F.regr_intercept("value", "pixel").alias("intercept"), F.count("*").alias("n_ticks")
    )


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _line(ts: Column) -> Column:
    """(slope, intercept) of an array of (p, v), centred on the means for accuracy; null without two different pixels."""
    n = F.size(ts).cast("double")
    total = lambda f: F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + f(t))

    def centred(m: Column) -> Column:
        sxy = F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + (t["p"] - m["p"]) * (t["v"] - m["v"]))
        sxx = F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + (t["p"] - m["p"]) * (t["p"] - m["p"]))
        slope = F.try_divide(sxy, sxx)
        return F.struct(slope.alias("slope"), (m["v"] - slope * m["p"]).alias("intercept"))

    return _let(F.struct((total(lambda t: t["p"]) / n).alias("p"), (total(lambda t: t["v"]) / n).alias("v")), centred)


def _median(xs: Column) -> Column:
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return _let(F.array_sort(xs), middle)


def robust_fit(ticks: DataFrame, by: list[str], gates: Gates = Gates()) -> DataFrame:
    """slope, intercept, r2, rmse, n_ticks, n_used, n_rejected, method and ticks (p, v, ord, used, residual) of each group.

    ticks: by, pixel, value, ord. Rounds of: a line through the kept ticks; residuals of all ticks; a tick is kept if
    its residual lies within mad_cut robust deviations of the kept ones' median, whether it was kept before or not.
    Rounds end when nothing changes, when the deviation is zero or when fewer than two ticks would stay. Two ticks give
    the exact line; groups with fewer give no row.
    """
    grouped = ticks.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("ord").alias("ord"), F.col("pixel").cast("double").alias("p"), F.col("value").cast("double").alias("v"))
            )
        ).alias("ts")
    ).where(F.size("ts") >= 2)
    all_of = F.col("ts")
    state = lambda keep, done: F.struct(keep.alias("keep"), done.alias("done"))

    def one_round(acc: Column, _: Column) -> Column:
        def with_line(line: Column) -> Column:
            residual = lambda t: t["v"] - (line["slope"] * t["p"] + line["intercept"])

            def with_spread(s: Column) -> Column:
                def with_new(new: Column) -> Column:
                    stop = (s["sigma"] <= 0) | (F.size(new) < 2) | (new == acc["keep"])
                    return state(F.when(stop, acc["keep"]).otherwise(new), stop)

                return _let(F.filter(all_of, lambda t: F.abs(residual(t) - s["med"]) <= gates.mad_cut * s["sigma"]), with_new)

            kept = F.transform(acc["keep"], residual)
            spread = _let(
                _median(kept),
                lambda med: F.struct(
                    med.alias("med"), (gates.mad_scale * _median(F.transform(kept, lambda r: F.abs(r - med)))).alias("sigma")
                )
            )
            return _let(spread, with_spread)

        return F.when(acc["done"], acc).otherwise(_let(_line(acc["keep"]), with_line))

    keep = F.aggregate(F.sequence(F.lit(1), F.lit(gates.fit_rounds)), state(all_of, F.lit(False)), one_round, lambda acc: acc["keep"])
    # Each explode of one value keeps the fold from being written out again wherever its result is used.
    fitted = grouped.withColumn("keep", F.explode(F.array(F.when(F.size("ts") == 2, all_of).otherwise(keep))))
    fitted = fitted.withColumn("line", F.explode(F.array(_line(F.col("keep")))))
    slope, intercept = F.col("line.slope"), F.col("line.intercept")
    residual = lambda t: t["v"] - (slope * t["p"] + intercept)
    n_used = F.size("keep")
    mean = F.aggregate("keep", F.lit(0.0), lambda a, t: a + t["v"]) / n_used
    fitted = fitted.withColumn(
        "ss_res", F.aggregate("keep", F.lit(0.0), lambda a, t: a + residual(t) * residual(t))
    ).withColumn("mean", mean)
    fitted = fitted.withColumn(
        "ss_tot", F.aggregate("keep", F.lit(0.0), lambda a, t: a + (t["v"] - F.col("mean")) * (t["v"] - F.col("mean")))
    )
    exact = F.size("ts") == 2
    r2 = F.when(exact, 1.0).when(F.col("ss_tot") > 0, 1.0 - F.try_divide("ss_res", "ss_tot")).when(F.col("ss_res") == 0, 1.0).otherwise(0.0)
    lo, hi = F.array_min(F.transform("keep", lambda t: t["v"])), F.array_max(F.transform("keep", lambda t: t["v"]))
    ticks_out = F.transform(
        all_of,
        lambda t: F.struct(
            t["ord"].alias("ord"),
            t["p"].alias("p"),
            t["v"].alias("v"),
            F.array_contains("keep", t).alias("used"),
            F.when(~exact, residual(t)).alias("residual")
        )
    )
    return fitted.select(
        *by, slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"), F.when(exact, 0.0).otherwise(
            F.sqrt(F.col("ss_res") / n_used)
        ).alias("rmse"), F.size("ts").alias("n_ticks"), n_used.alias("n_used"),
        (
            F.size("ts") - n_used
        ).alias("n_rejected"), F.when(exact, "two_anchor").otherwise("irls_mad").alias("method"), (hi - lo).alias("value_range"),
        F.array_max(
            F.transform("keep", lambda t: t["p"])
        ).alias("c_low"), F.array_min(F.transform("keep", lambda t: t["p"])).alias("c_high"), ticks_out.alias("ticks"),
    )


def fit_both_scales(ticks: DataFrame, by: list[str], declared: Column, gates: Gates = Gates()) -> DataFrame:
    """The linear and the logarithmic fit in one pass (the scale is one more key), and the better of the two.

    A declared scale stays unless the other's r2 is better by scale_stickiness. A group with a value that is not
    positive has no logarithmic fit. declared: a column over `by` ('linear', 'log', or anything else for unknown).
    """
    bad = F.min("value").over(Window.partitionBy(*by)) <= 0
    both = ticks.withColumn("_bad", bad).withColumn(
        "scale", F.explode(F.array(F.lit("linear"), F.lit("log")))
    ).where((F.col("scale") == "linear") | ~F.col("_bad"))
    both = both.withColumn(
        "value", F.when(F.col("scale") == "log", F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value"))
    ).drop("_bad")
    fits = robust_fit(both, [*by, "scale"], gates).withColumn("declared", declared)
    primary = F.when(F.col("declared") == "log", "log").otherwise("linear")
    known = F.col("declared").isin("linear", "log")
    w = Window.partitionBy(*by)
    fits = fits.withColumn("own_r2", F.max(F.when(F.col("scale") == primary, F.col("r2"))).over(w))
    lead = F.when(
        (F.col("scale") != primary) & known & (F.col("r2") - F.col("own_r2") < gates.scale_stickiness), -1.0
    ).otherwise(F.col("r2"))
    order = w.orderBy(F.desc("lead"), F.desc(F.col("scale") == primary))
    best = fits.withColumn("lead", lead).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.withColumn("scale_auto", (F.col("scale") != primary) & known).drop("lead", "_n", "own_r2")


def gate_flags(fits: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """flags: two_anchor_only, low_r2 with its figure (low_r2:0.9912), high_residual."""
    relative = F.try_divide("rmse", F.nullif("value_range", F.lit(0.0)))
    flags = F.array_compact(
        F.array(
            F.when(
                (F.col("method") == "two_anchor") & F.lit(gates.least_ticks > 2), "two_anchor_only"
            ), F.when(F.col("r2") < gates.least_r2, F.format_string("low_r2:%.4f", "r2")), F.when(relative > gates.most_residual, "high_residual")
        )
    )
    return fits.withColumn("flags", flags)


def support(fits: DataFrame) -> Column:
    """How well a fit is supported: its r2, less for fewer than three used ticks."""
    return F.col("r2") * F.least(F.lit(1.0), F.col("n_used") / 3)


def magnitude_sides(ticks: DataFrame, by: list[str], gates: Gates = Gates()) -> DataFrame:
    """side of each tick by the largest gap of log values (two scales differ by orders of magnitude); null where there is none.

    Needs four positive ticks, all but two of the group, a gap of magnitude_gap decades, and two ticks on either side.
    """
    w = Window.partitionBy(*by)
    n = ticks.withColumn("n_all", F.count("*").over(w)).withColumn(
        "positive", (F.col("value") > 0).cast("int")
    ).withColumn("n_positive", F.sum("positive").over(w))
    ordered = w.orderBy(F.desc("positive"), "value", "ord")
    n = n.withColumn("i", F.row_number().over(ordered)).withColumn("next", F.lead("value").over(ordered))
    gap = F.when(
        (F.col("i") < F.col("n_positive")) & (F.col("next") > F.col("value")), F.log10(F.try_divide(F.col("next"), F.col("value")))
    )
    n = n.withColumn("gap", gap).withColumn("cut", F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", "i"))).over(w))
    good = (F.col("n_positive") >= 4) & (
        F.col("n_positive") >= F.col("n_all") - 2
    ) & (F.col("cut.gap") >= gates.magnitude_gap) & (F.col("cut.i") >= 2) & (F.col("n_positive") - F.col("cut.i") >= 2)
    side = F.when(good & (F.col("positive") == 1), F.when(F.col("i") <= F.col("cut.i"), "left").otherwise("right"))
    return n.withColumn("split_side", side).drop("n_all", "positive", "n_positive", "i", "next", "gap", "cut")


def pick_side(ticks: DataFrame, by: list[str], gates: Gates = Gates()) -> DataFrame:
    """The better supported side's fit on charts with two scales; ticks of neither side count for both.

    ticks: by, side, pixel, value, ord. Sides count if both have two ticks; else the magnitude split stands in; else all
    ticks make one fit (side null).
    """
    w = Window.partitionBy(*by)
    counted = magnitude_sides(ticks, by, gates)
    tagged = (F.count_if(F.col("side") == "left").over(w) >= 2) & (F.count_if(F.col("side") == "right").over(w) >= 2)
    counted = counted.withColumn("tagged", tagged).withColumn("split", F.max("split_side").over(w).isNotNull())
    known = F.col("side").isin("left", "right")
    sides = F.when(F.col("tagged"), F.when(known, F.array("side")).otherwise(F.array(F.lit("left"), F.lit("right"))))
    sides = sides.when(
        F.col("split"), F.when(F.col("split_side").isNotNull(), F.array("split_side")).otherwise(F.array().cast("array<string>"))
    ).otherwise(F.array(F.lit("both")))
    fits = robust_fit(counted.withColumn("side", F.explode(sides)), [*by, "side"], gates)
    order = w.orderBy(F.desc(support(fits)), "side")
    return fits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def share_donor(fits: DataFrame, page: list[str], panel: str, usable: Column, gates: Gates = Gates()) -> DataFrame:
    """Panels without a usable fit take the page's best supported one; usable ones are compared with it.

    Adds donor, shared, inconsistent, and slope and intercept as they then hold.
    """
    w = Window.partitionBy(*page)
    score = F.when(usable, support(fits))
    best = F.max(
        F.when(usable, F.struct(score.alias("score"), (-F.col("rank")).alias("first"), F.col(panel).alias("donor"), "slope", "intercept"))
    ).over(w)
    ranked = fits.withColumn("rank", F.row_number().over(w.orderBy(panel)))
    out = ranked.withColumn("best", best).withColumn("_usable", usable).withColumn("donor", F.col("best.donor"))
    off = F.try_divide(F.abs(F.col("slope") - F.col("best.slope")), F.abs(F.col("best.slope")))
    out = out.withColumn("shared", ~F.col("_usable") & F.col("best").isNotNull()).withColumn(
        "inconsistent", F.col("_usable") & (F.col(panel) != F.col("donor")) & F.coalesce(off > gates.donor_slope, F.lit(False))
    )
    for c in ("slope", "intercept"):
        out = out.withColumn(c, F.when(F.col("shared"), F.col(f"best.{c}")).otherwise(F.col(c)))
    return out.drop("rank", "best", "_usable")
