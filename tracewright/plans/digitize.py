"""The whole chain for many charts in one plan: readings or ticks, and candidates, to calibrated, gap-flagged series.

Everything is keyed by page and panel: panels of different pages may have one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates
from tracewright.operators import axes, fit, readings, resample
from tracewright.operators import candidates as cd
from tracewright.operators import series as sr

KEY = ["page", "panel"]
#: Columns that panels may lack, and what stands for them.
_OPTIONAL = {
    "page": "panel", "y_scale": "'unknown'", "dual": "false", "n_series": "1", "labels": "CAST(NULL AS array<string>)", "height": "0.0D",
    "top": "CAST(NULL AS double)", "bottom": "CAST(NULL AS double)",
}


def _or_else(c: str, other: str, columns: list[str]) -> Column:
    """A label, or another one where it is empty."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(other) if other in columns else F.lit(None).cast("string"), F.lit(""))


def _known(panels: DataFrame, gates: Gates) -> DataFrame:
    """panels with every optional column, an x axis struct and n, its samples. Labels that are empty are the month's."""
    panels = panels.withColumns({c: F.expr(default) for c, default in _OPTIONAL.items() if c not in panels.columns})
    if "x_kind" in panels.columns:
        start, end = (_or_else(f"x_{c}", f"month_{c}", panels.columns) for c in ("start", "end"))
        panels = panels.withColumn("x", axes.x_axis(F.col("x_kind"), start, end))
        if "month_start" in panels.columns:
            month = [F.coalesce(f"month_{c}", F.lit("")) for c in ("start", "end")]
            panels = panels.withColumn("x", axes.with_month(F.col("x"), *month))
        if "hint_start" in panels.columns:
            panels = panels.withColumn("x", F.coalesce(axes.hinted(F.col("hint_start"), F.col("hint_end")), F.col("x")))
        return panels.withColumn("n", F.coalesce("x.n_samples", F.lit(gates.slices)))
    dated = F.col("start").isNotNull()
    kind, n = F.when(dated, "date").otherwise("unknown"), F.when(dated, F.col("n"))
    x = F.struct(kind.alias("kind"), F.col("start").cast("string").alias("start"), F.lit("").alias("end"), n.alias("n_samples"))
    return panels.withColumn("x", x)


def _paged(table: DataFrame | None, known: DataFrame) -> DataFrame | None:
    """table with its page: its own, or that of the panel of its name (then names must be of one page each)."""
    if table is None or "page" in table.columns:
        return table
    return table.join(known.select(*KEY), "panel")


def _selected(
    known: DataFrame, scored: DataFrame, points: DataFrame, picks: DataFrame | None, assigned: DataFrame | None, gates: Gates
) -> DataFrame:
    """page, panel, series, cand, label, too_few: one curve for panels of one series, distinct ones for the others.

    Several curves are chosen among a panel's viable ones; only where it has none, among all.
    """
    given = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    single = cd.select_single(scored, picks, KEY, gates).select(*KEY, "cand")
    many = known.where("n_series > 1").select(*KEY, "n_series", "labels", "height")
    lines = cd.as_polylines(points.join(many.select(*KEY), KEY, "left_semi"), [*KEY, "cand"])
    pool = scored.withColumn("_any", F.max("viable").over(Window.partitionBy(*KEY))).where(F.col("viable") | ~F.col("_any"))
    lines = lines.join(cd.rank(pool, KEY).select(*KEY, "cand", "rank"), [*KEY, "cand"]).join(many, KEY)
    names = F.lit(None).cast("map<bigint,string>")
    if assigned is not None:
        lines = lines.join(assigned.select(*KEY, F.col("assigned").cast("map<bigint,string>").alias("assigned")), KEY, "left")
    else:
        lines = lines.withColumn("assigned", names)
    n, labels = cd.census(F.col("n_series"), F.lit(None).cast("array<string>"), F.lit(None).cast("int"), F.col("labels"))
    lines = lines.withColumn("cand", F.col("cand").cast("long")).withColumn("labels", labels).withColumn("n_series", n)
    multi = cd.select_multi(lines, KEY).select(*KEY, F.explode("chosen").alias("c"), "too_few")
    multi = multi.select(*KEY, "c.series", "c.cand", "c.label", "too_few")
    one = single.join(
        known.where("n_series <= 1 OR n_series IS NULL").select(*KEY, F.coalesce(F.get(given, F.lit(0)), F.lit("")).alias("label")), KEY
    )
    one = one.select(*KEY, F.lit("s1").alias("series"), F.col("cand").cast("long").alias("cand"), "label", F.lit(False).alias("too_few"))
    return one.unionByName(multi)


def _read(panels: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """panels with what their readings say of unit, scale and x axis; their ticks; their flags."""
    place = panels.select(*KEY, F.col("x0").alias("x"), "axis_labels", "curve_labels", F.col("y_scale").alias("scale_guess"))
    read = readings.cascade(place, attempts)
    own = panels.drop("unit", "y_scale", "x_kind", "x_start", "x_end")
    own = own.join(panels.select(*KEY, F.col("unit").alias("_unit")), KEY)
    told = read.select(*KEY, "unit", F.col("scale").alias("y_scale"), "x_kind", "x_start", "x_end")
    own = own.join(told, KEY).withColumn("unit", F.coalesce("_unit", F.nullif("unit", F.lit("")))).drop("_unit")
    return own, readings.ticks_of(read), read.select(*KEY, F.col("flags").alias("read_flags"))


def digitize(
    ticks: DataFrame | None, points: DataFrame, panels: DataFrame, baseline: DataFrame | None = None, picks: DataFrame | None = None, gates: Gates = Gates(), dated: bool = True,
    anchors: DataFrame | None = None, assigned: DataFrame | None = None, attempts: DataFrame | None = None,
) -> DataFrame:
    """Series (page, panel, series, label, cand, slice, x_key, value_native, value_mm, flagged, flags, ...) of every panel that has a curve.

    Tables have a page and a panel; one without a page belongs to the page that has its panel, whose name then is of one
    page alone. ticks: ord, pixel, value (and side on panels with two scales). points: cand, ord, x, y (page), confidence.
    panels: panel, x0, x1, unit; the x axis as n and start (a date or null), or as the labels x_kind, x_start, x_end (and
    month_start, month_end of the panel's month, and hint_start, hint_end, which beat both); if known: page (panels that share a value scale; else each stands
    alone), y_scale, dual, n_series, labels, height (of its tile), top and bottom (rows of its crop). baseline: x, y,
    beta. anchors: page, panel (or null), ord, pixel, value. assigned: a map of candidates to labels. Instead of ticks,
    attempts (readings.cascade): panels then have axis_labels and curve_labels, and the reading gives scale, x axis, and
    the unit where panels have none.

    Slices are cut by the uncorrected x. A baseline without beta is measured against the zero row of the panel's axis.
    Panels without a usable axis take their page's; without one their series have pixels but no values, and `unusable`.
    """
    panels = panels.withColumns({c: F.expr(_OPTIONAL[c]) for c in ("page", "y_scale") if c not in panels.columns})
    read_flags = None
    if attempts is not None:
        panels, ticks, read_flags = _read(panels, attempts)
    by = [*KEY, "cand"]
    known = _known(panels, gates)
    ticks, points, baseline, picks, assigned = (_paged(t, known) for t in (ticks, points, baseline, picks, assigned))
    own_anchors = axes.anchors_of(known.select(*KEY), anchors, ["page"]) if anchors is not None else None
    fits = axes.share(axes.calibrate(known, ticks, gates, own_anchors), gates)
    if read_flags is not None:
        fits = fits.join(read_flags, KEY, "left").withColumn("flags", F.concat("read_flags", "flags")).drop("read_flags")
    on_page = points.join(known.select(*KEY, "x0", "x1", "n"), KEY)
    sampled = resample.last_per_slice(on_page, by, F.col("x0"), F.col("x1"), F.col("n"), ("confidence", "n"))
    scored = resample.scored(sampled, by, F.max("n"), gates.alpha, gates.viable_coverage)
    chosen = _selected(known, scored, points, picks, assigned, gates)
    own = sampled.drop("n").join(chosen.select(*by, "series"), by)
    if baseline is not None:
        known_beta = F.max("beta") if "beta" in baseline.columns else F.lit(None).cast("double")
        zero = fits.select(*KEY, fit.beta(F.col("slope"), F.col("intercept")).alias("zero"))
        beta = baseline.groupBy(*KEY).agg(known_beta.alias("beta")).join(zero, KEY, "left")
        beta = beta.select(*KEY, F.coalesce("beta", "zero").alias("beta"))
        base = resample.interpolate(own.select(*KEY, "x", "series", "slice"), baseline.select(*KEY, "x", "y"), KEY)
        own = own.join(base.select(*KEY, "series", "slice", "base"), [*KEY, "series", "slice"], "left").join(beta, KEY, "left")
        own = own.withColumn("y_corrected", F.coalesce(resample.correct(F.col("y"), F.col("base"), F.col("beta")), F.col("y")))
    else:
        own = own.withColumn("y_corrected", F.col("y"))
    slices = known.join(chosen, KEY).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x_key = axes.x_key(F.col("x"), F.col("slice"), F.col("n")).alias("x_key")
    keys = slices.select(*KEY, "series", "label", "cand", "too_few", "slice", "unit", x_key)
    full = keys.join(own.drop("cand"), [*KEY, "series", "slice"], "left").withColumn("flagged", F.col("x").isNull())
    full = full.join(fits.select(*KEY, "donor", "slope", "intercept", "scale", "flags"), KEY, "left")
    few = F.when(F.col("too_few"), F.array_append("flags", F.lit("too_few_curves"))).otherwise(F.col("flags"))
    out = sr.physical(full.withColumn("flags", few), F.col("unit"), dated)
    measured = ["x_key", "value_native", "native_unit", "value_mm", "x", "y", "y_corrected", "flagged"]
    return out.select(*KEY, "series", "label", "cand", "slice", *measured, "donor", "flags")
