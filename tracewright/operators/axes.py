"""Axes of panels: x axes from printed labels and hints, y axes as fit records, and what a page's panels share.

An x axis is a struct (kind, start, end, n_samples, flags); a y axis is a row of a table. Panels whose ticks give no fit
stay in it, marked `unusable`, so that their page's donor can stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates
from tracewright.functions import dates, text
from tracewright.functions.columns import let
from tracewright.operators import fit

_X = "struct<kind:string,start:string,end:string,n_samples:int,flags:array<string>>"


def _axis(kind: str, start: Column, end: Column, n: Column, flags: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        start.cast("string").alias("start"),
        end.cast("string").alias("end"),
        n.cast("int").alias("n_samples"),
        flags.cast("array<string>").alias("flags")
    )


def _with_extent(start: Column, end: Column, body) -> Column:
    """body(first, last): both dates of a labelled extent, each read once; an end without a year has the start's."""
    both = lambda first: F.struct(first.alias("first"), dates.parse_label(end, F.year(first)).alias("last"))
    return let(dates.parse_label(start), lambda first: let(both(first), lambda x: body(x["first"], x["last"])))


def _plain(number: Column) -> Column:
    return F.when(number == F.rint(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def x_axis(kind: Column, start: Column, end: Column) -> Column:
    """An x axis from its kind ('date', 'numeric', anything else is unknown) and its two labels.

    Dates: one sample a day; a single label stands for its whole month. Numbers: one sample a unit if the extent is whole;
    it may fall. Labels that cannot be read stay as they are, with a flag and no samples.
    """
    none, n = F.array(), F.lit(None)

    def dated(first: Column, last: Column) -> Column:
        out = F.when(last >= first, _axis("date", first, last, F.date_diff(last, first) + 1, none))
        out = out.when(
            first.isNotNull() & last.isNull(), _axis("date", F.trunc(first, "MM"), F.last_day(first), dates.days_in_month(first), none)
        )
        return out.otherwise(_axis("date", start, end, n, F.array(F.lit("dates_unparsed"))))

    def counted(x: Column) -> Column:
        a, b, width = x["a"], x["b"], F.abs(x["b"] - x["a"])
        out = F.when(
            a != b,
            _axis(
                "numeric",
                _plain(a),
                _plain(b),
                F.when(width == F.rint(width), width + 1),
                F.when(b < a, F.array(F.lit("descending"))).otherwise(none)
            )
        )
        return out.otherwise(_axis("numeric", start, end, n, F.array(F.lit("numeric_extent_unparsed"))))

    numbers = F.struct(text.lenient_number(start).alias("a"), text.lenient_number(end).alias("b"))
    return F.when(
        kind == "date", _with_extent(start, end, dated)
    ).when(kind == "numeric", let(numbers, counted)).otherwise(_axis("unknown", start, end, n, none))


def with_month(x: Column, start: Column, end: Column) -> Column:
    """A panel's month beats an axis that is no dated one with samples (day numbers, say)."""

    def preferred(first: Column, last: Column) -> Column:
        whole = F.coalesce((x["kind"] == "date") & x["n_samples"].isNotNull(), F.lit(False))
        return F.when(
            ~whole & (last >= first),
            _axis("date", first, last, F.date_diff(last, first) + 1, F.array_append(x["flags"], F.lit("x_from_month_hint")))
        ).otherwise(x.cast(_X))

    return _with_extent(start, end, preferred)


def hinted(start: Column, end: Column) -> Column:
    """The x axis of a user's hint; null where the hint has no extent."""
    a, b = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    kind = F.when(dates.parse_label(a).isNotNull() | dates.parse_label(b).isNotNull(), "date").otherwise("numeric")
    made = let(x_axis(kind, a, b), lambda x: x.withField("flags", F.array_append(x["flags"], F.lit("user_hint:x_extent"))))
    return F.when((a != "") | (b != ""), made)


def x_position(x: Column, i: Column, n: Column) -> Column:
    """Where sample i of n lies on a numeric axis."""
    return x["start"].try_cast("double") + (x["end"].try_cast("double") - x["start"].try_cast("double")) * F.try_divide(i, n - 1)


def x_key(x: Column, i: Column, n: Column) -> Column:
    """The key of sample i of n: its day, its number, or its place from 1 on."""
    place = (i + 1).cast("string")
    day = F.date_add(F.try_to_date(x["start"], "yyyy-MM-dd"), i).cast("string")
    number = let(F.round(x_position(x, i, n), 6), lambda v: F.coalesce(_plain(v), place))
    return F.when((x["kind"] == "date") & x["n_samples"].isNotNull(), day).when(x["kind"] == "numeric", number).otherwise(place)


def anchors_of(panels: DataFrame, anchors: DataFrame, page: list[str]) -> DataFrame:
    """page, panel, ord, pixel, value: a panel's own anchors, else its page's.

    anchors: page, panel (null for the whole page), ord, pixel, value.
    """
    both = panels.select(*page, "panel").join(anchors.select(*page, F.col("panel").alias("own"), "ord", "pixel", "value"), page)
    both = both.where(F.col("own").isNull() | (F.col("own") == F.col("panel")))
    best = F.max(F.col("own").isNotNull()).over(Window.partitionBy(*page, "panel"))
    return both.withColumn("best", best).where(F.col("own").isNotNull() == F.col("best")).drop("own", "best")


def _crossed(given: DataFrame, model: DataFrame, key: list[str], gates: Gates) -> DataFrame:
    """key, worst: how far the axis that was read lies from anchors, at the scale of the panel, in values.

    given: key, pixel, value. model: key, y_scale, ord, pixel, value. Readings that make no axis at that scale check nothing.
    """
    scale = F.when(F.col("y_scale") == "log", "log").otherwise("linear")
    least = F.min("value").over(Window.partitionBy(*key))
    at_scale = model.withColumn("m_scale", scale).withColumn("_least", least).where((F.col("m_scale") == "linear") | (F.col("_least") > 0))
    logged = F.when(F.col("m_scale") == "log", F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value"))
    fits = fit.robust_fit(at_scale.withColumn("value", logged).drop("_least"), [*key, "m_scale"], gates)
    fits = fits.select(*key, "m_scale", F.col("slope").alias("m_slope"), F.col("intercept").alias("m_intercept"))
    value = fit.value_at(F.col("m_slope"), F.col("m_intercept"), F.col("pixel"), F.col("m_scale"))
    return given.join(fits, key).groupBy(*key).agg(F.max(F.abs(value - F.col("value"))).alias("worst"))


def calibrate(panels: DataFrame, ticks: DataFrame, gates: Gates = Gates(), anchors: DataFrame | None = None) -> DataFrame:
    """A y axis for each panel: scale, slope, intercept, r2, rmse, counts, method, anchor pair, flags, review_required.

    panels: page, panel, and if they are known y_scale ('linear', 'log'), dual (two value scales), top and bottom (rows of
    its crop). ticks: page (if panels of two pages may have one name), panel, ord, pixel, value, and side on dual panels.
    Repeated ticks count once. Panels with two anchors or more (anchors_of) take these for ticks; their own readings then
    only check them, at the panel's scale: `hint_mismatch` where the two differ by more than anchor_span of what the crop
    spans in values (without a crop: of what the anchors span). Panels without a fit are `unusable`.
    """
    known = panels
    none = F.lit(None).cast("double")
    for c, default in (("y_scale", F.lit("unknown")), ("dual", F.lit(False)), ("top", none), ("bottom", none)):
        known = known if c in known.columns else known.withColumn(c, default)
    known = known.select("page", "panel", "y_scale", "dual", "top", "bottom")
    key = [c for c in ("page", "panel") if c in ticks.columns]
    named = known.select(*key, "y_scale", "dual")
    has_side = "side" in ticks.columns
    read = fit.dedupe_ticks(ticks.where(F.col("pixel").isNotNull() & F.col("value").isNotNull()), key).join(named, key)
    tick = [*key, "y_scale", "ord", "pixel", "value"]
    used = read.select(*tick)
    if has_side:
        sided = fit.pick_side(read.where("dual").select(*key, "y_scale", "side", "ord", "pixel", "value"), [*key, "y_scale"], gates)
        picked = sided.select(*key, "y_scale", F.explode("ticks").alias("t")).select(
            *key, "y_scale", "t.ord", F.col("t.p").alias("pixel"), F.col("t.v").alias("value")
        )
        used = used.join(named.where("dual").select(*key), key, "left_anti").unionByName(picked)
    given = None
    if anchors is not None:
        given = anchors.select(*key, "ord", "pixel", "value").join(named.select(*key, "y_scale"), key).select(*tick)
        enough = given.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2").select(*key)
        given = given.join(enough, key, "left_semi")
        model = used
        used = used.join(enough, key, "left_anti").unionByName(
            given.withColumn("y_scale", F.when(F.col("y_scale") == "log", "log").otherwise("linear"))
        )
    fits = fit.gate_flags(fit.fit_both_scales(used, [*key, "y_scale"], F.col("y_scale"), gates), gates)
    at = lambda c: fit.value_at(F.col("slope"), F.col("intercept"), F.col(c), F.col("scale"))
    fits = fits.withColumn("v_low", at("c_low")).withColumn("v_high", at("c_high")).drop("y_scale", "declared")
    if given is not None:
        fits = fits.join(_crossed(given, model, key, gates), key, "left").join(
            given.select(*key).distinct().withColumn("hinted", F.lit(True)), key, "left"
        )
        fits = fits.join(known.select(*key, "top", "bottom"), key, "left")
        span = F.coalesce(F.abs(at("top") - at("bottom")), F.abs(F.col("v_high") - F.col("v_low")))
        span = F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0))
        marks = F.array_compact(
            F.array(F.when(F.col("hinted"), "user_hint:y_anchors"), F.when(F.col("worst") / span > gates.anchor_span, "hint_mismatch"))
        )
        fits = fits.withColumn("flags", F.concat("flags", marks)).withColumn(
            "method", F.when(F.col("hinted"), "user_anchors").otherwise(F.col("method"))
        )
        fits = fits.drop("worst", "hinted", "top", "bottom")
    out = known.select("page", "panel").join(fits, key, "left").withColumn("usable", F.col("slope").isNotNull())
    none = F.array(F.lit("unusable"))
    return out.withColumn("flags", F.when(F.col("usable"), F.col("flags")).otherwise(none)).withColumn("review_required", ~F.col("usable"))


_SHARED = (
    "scale",
    "scale_auto",
    "slope",
    "intercept",
    "r2",
    "rmse",
    "n_ticks",
    "n_used",
    "n_rejected",
    "method",
    "value_range",
    "c_low",
    "v_low",
    "c_high",
    "v_high",
    "ticks"
)


def share(axes: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """axes (of calibrate) with `donor`, the page's best supported panel: unusable panels take its whole axis, others whose slope is far from it are flagged.

    A page has few panels: one window over each.
    """
    w = Window.partitionBy("page")
    score = F.col("r2") * F.least(F.lit(1.0), F.col("n_used") / 3)
    axis = F.when(F.col("usable"), F.struct(F.col("panel").alias("donor"), F.struct(*_SHARED, "flags").alias("y")))
    best = F.first(axis, ignorenulls=True).over(
        w.orderBy(F.desc("usable"), F.desc(score), "panel").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    out = axes.withColumn("best", best)
    taken = ~F.col("usable") & F.col("best").isNotNull()
    off = F.try_divide(F.abs(F.col("slope") - F.col("best.y.slope")), F.abs(F.col("best.y.slope")))
    far = F.col("usable") & (F.col("panel") != F.col("best.donor")) & F.coalesce(off > gates.donor_slope, F.lit(False))
    flags = F.when(
        taken, F.array_append(F.col("best.y.flags"), F.concat(F.lit("y_fit_shared_from:"), F.col("best.donor")))
    ).when(far, F.array_append("flags", F.lit("y_fit_inconsistent"))).otherwise(F.col("flags"))
    columns = [F.when(taken, F.col(f"best.y.{c}")).otherwise(F.col(c)).alias(c) for c in _SHARED]
    return out.select(
        "page",
        "panel",
        F.col("best.donor").alias("donor"),
        taken.alias("shared"),
        far.alias("inconsistent"),
        off.alias("slope_off"),
        *columns,
        flags.alias("flags"),
        (F.col("review_required") & ~taken).alias("review_required")
    )


def tile_rows(boxes: DataFrame, page: list[str]) -> DataFrame:
    """boxes with tile_low, tile_high: a page's two anchor rows in the coordinates of each month's tile, which has its box in the middle.

    boxes: page, month, y0, y1 (edges in pixels), c_low, c_high (the page's anchor rows), tile_h.
    """
    offset = F.col("y0") - (F.col("tile_h") - (F.col("y1") - F.col("y0"))) / 2.0
    return boxes.withColumn("tile_low", F.col("c_low") - offset).withColumn("tile_high", F.col("c_high") - offset)


def seeded(boxes: DataFrame, low: Column, high: Column) -> DataFrame:
    """boxes (of tile_rows) calibrated from the annotation alone: the line through both anchor rows."""
    slope, intercept = fit.two_anchor(F.col("tile_low"), low, F.col("tile_high"), high)
    return boxes.withColumn("slope", slope).withColumn("intercept", intercept).withColumn("method", F.lit("human_anchors")).withColumn(
        "flags", F.array(F.lit("seeded_from_annotations"))
    )
