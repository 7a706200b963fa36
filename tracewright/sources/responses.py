"""Answers of a model as typed tables: text in, structs out, with what is wrong told and nothing lost.

Answers come as rows with their text; who asked the model is of no interest here. Each kind of question has a declared
schema, fields that must be there, and words that a field may have. Coordinates are 0 to 1000 on what the model was shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry, text
from tracewright.operators import checks

_TICK = "struct<pos_1000:bigint,value:double,label_text:string,legible:boolean,side:string>"
_POINT = "struct<x_1000:bigint,y_1000:bigint>"
_BOX = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"
_SIDES = ("left", "right", "unknown")


@dataclass(frozen=True)
class Kind:
    """The schema of an answer; paths (through arrays by []) of fields that must be there, of words, and of coordinates."""

    schema: str
    required: tuple[str, ...] = ()
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    places: tuple[str, ...] = ()


# The answers' fields and words, as the prompts ask for them.
KINDS = {
    "orientation": Kind("rotation_deg bigint, reason string, confidence double", ("rotation_deg",)),
    "triage": Kind(
        "rotation_deg bigint, chart_kind string, page_kind string, y_axis_labels_present boolean, value_labels_on_curve boolean, y_scale_guess string, dual_y_axis boolean, n_series bigint, series_labels array<string>, "
        f"panels array<struct<box:{_BOX},plot_area:{_BOX},label:string,x_start_label:string,x_end_label:string,n_series:bigint,series_labels:array<string>,confidence:double>>, title string, station string, year bigint, "
        "date_range string, y_unit string, unit_transition_present boolean, unit_transition_date string, language string, handwritten_annotations boolean, notes string, confidence double",
        (
            "rotation_deg",
            "chart_kind",
            "y_axis_labels_present",
            "panels",
            "panels[].confidence",
            *(f"panels[].{b}.{c}" for b in ("box", "plot_area") for c in ("x0", "y0", "x1", "y1"))
        ),
        {
            "chart_kind": ("line_chart", "multi_panel_line_chart", "bar_chart", "scatter", "table", "text_page", "other"),
            "y_scale_guess": ("linear", "log", "unknown")
        },
        tuple(f"panels[].{b}.{c}" for b in ("box", "plot_area") for c in ("x0", "y0", "x1", "y1")),
    ),
    "axis": Kind(
        f"y_unit_text string, y_scale string, y_ticks array<{_TICK}>, x_kind string, x_start_label string, x_end_label string, x_ticks array<{_TICK}>, notes string, confidence double",
        ("y_ticks", "x_kind", "confidence", *(f"{t}[].{c}" for t in ("y_ticks", "x_ticks") for c in ("pos_1000", "value"))),
        {"y_scale": ("linear", "log"), "x_kind": ("date", "numeric", "unknown"), "y_ticks[].side": _SIDES, "x_ticks[].side": _SIDES},
        ("y_ticks[].pos_1000", "x_ticks[].pos_1000"),
    ),
    "curve_labels": Kind(
        "labels array<struct<x_1000:bigint,y_1000:bigint,value:double,label_text:string,legible:boolean>>, unit_text string, confidence double",
        ("labels", "labels[].x_1000", "labels[].y_1000", "labels[].value"), {}, ("labels[].x_1000", "labels[].y_1000"),
    ),
    "baseline": Kind(
        f"line_visible boolean, points array<{_POINT}>, confidence double",
        ("line_visible", "points", "points[].x_1000", "points[].y_1000"),
        {},
        ("points[].x_1000", "points[].y_1000")
    ),
    "qc": Kind(
        "verdict string, issues array<string>, reason string, confidence double", ("verdict",), {"verdict": ("ok", "minor", "major")}
    ),
    "pick": Kind("best_cand_id bigint, reason string, confidence double", ("best_cand_id",)),
    "points": Kind(
        "series array<struct<series_label:string,points:array<struct<x_1000:bigint,y_1000:bigint,visible:boolean>>,confidence:double>>, notes string, confidence double",
        (
            "series", "series[].series_label", "series[].points", "series[].points[].x_1000", "series[].points[].y_1000"
        ), {}, ("series[].points[].x_1000", "series[].points[].y_1000"),
    ),
    "assign": Kind(
        "assignments array<struct<cand_id:bigint,series_label:string>>, confidence double",
        ("assignments", "assignments[].cand_id", "assignments[].series_label")
    ),
}


def _some(value: Column, path: list[str], test: Callable[[Column], Column]) -> Column:
    """Whether the test holds anywhere along a path; what is not there is not tested beyond its first gap."""
    head, rest = path[0], path[1:]
    inner = value[head.removesuffix("[]")]
    if head.endswith("[]"):
        return F.coalesce(F.exists(inner, lambda x: _some(x, rest, test) if rest else test(x)), F.lit(False))
    return _some(inner, rest, test) if rest else test(inner)


def parse(raw: DataFrame, kind: str) -> DataFrame:
    """raw (text and more) with data, error and out_of_range.

    error: null if the answer is valid, 'malformed' (no JSON of that schema; the fence around it and words before it do not
    count), else 'missing:field' or 'unknown word:field' of the first field in declared order that is at fault. data is
    null then. A field whose value is null counts as missing. out_of_range: fields with a coordinate beyond 0 to 1000 or a
    confidence beyond 0 to 1; these answers stay valid, as points are kept within the page later.
    """
    spec = KINDS[kind]
    read = F.from_json(text.clean_json(F.col("text")), f"{spec.schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    out = raw.withColumn("data", read)
    d = F.col("data")
    gone = [(p, _some(d, p.split("."), lambda v: v.isNull()), "missing") for p in spec.required]
    odd = [(p, _some(d, p.split("."), lambda v, w=w: v.isNotNull() & ~v.isin(*w)), "unknown word") for p, w in spec.words.items()]
    fault = F.when(F.col("text").isNull() | d.isNull() | d["_corrupt"].isNotNull(), "malformed")
    for path, wrong, what in [*gone, *odd]:
        fault = fault.when(wrong, f"{what}:{path}")
    beyond = [F.when(_some(d, p.split("."), lambda v: (v < 0) | (v > 1000)), F.lit(p)) for p in spec.places]
    beyond.append(F.when((d["confidence"] < 0) | (d["confidence"] > 1), F.lit("confidence")))
    out = out.withColumn("error", fault)
    whole = F.col("error").isNull()
    return out.withColumn(
        "out_of_range", F.when(whole, F.array_compact(F.array(*beyond)))
    ).withColumn("data", F.when(whole, d.dropFields("_corrupt")))


def first_valid(parsed: DataFrame, by: list[str]) -> DataFrame:
    """by, n_attempts, n_malformed, n_invalid, attempt, data, last_error: the first valid answer of each question.

    parsed: by, attempt, data, error (of parse). last_error is that of the last attempt where none is valid.
    """
    good = F.col("error").isNull()
    last = F.max_by("error", "attempt")
    found = parsed.groupBy(*by).agg(
        F.count("*").alias("n_attempts"), F.count_if(
            F.col("error") == "malformed"
        ).alias("n_malformed"), F.count_if(F.col("error") != "malformed").alias("n_invalid"),
        F.min(F.when(good, F.col("attempt"))).alias("attempt"), F.min_by(
            F.when(good, F.col("data")), F.when(good, F.col("attempt"))
        ).alias("data"), last.alias("last_error"),
    )
    return found.withColumn("last_error", F.when(F.col("attempt").isNull(), F.col("last_error")))


def axis_attempts(answers: DataFrame) -> DataFrame:
    """The attempts that readings.cascade takes, of parsed answers on axes: page, panel, kind, ord, data, error, and the crop (y, h) that was shown."""
    at = lambda t: F.struct(
        F.coalesce(t["side"], F.lit("unknown")).alias("side"),
        geometry.crop_to_page(t["pos_1000"], F.col("crop.y"), F.col("crop.h")).alias("pixel"),
        t["value"].alias("value"),
        F.coalesce(t["legible"], F.lit(True)).alias("legible")
    )
    d = F.col("data")
    return answers.select(
        "page", "panel", "kind", "ord", F.col("error").isNotNull().alias("failed"), d["y_unit_text"].alias("unit"), F.coalesce(
            d["y_scale"], F.lit("linear")
        ).alias("scale"), d["confidence"].alias("confidence"),
        d["x_kind"].alias("x_kind"), d["x_start_label"].alias("x_start"), d["x_end_label"].alias("x_end"), F.transform(
            d["y_ticks"], at
        ).alias("ticks"),
    )


def label_attempts(answers: DataFrame) -> DataFrame:
    """As axis_attempts, of parsed answers on values along curves."""
    at = lambda t: F.struct(
        F.lit("unknown").alias("side"),
        geometry.crop_to_page(t["y_1000"], F.col("crop.y"), F.col("crop.h")).alias("pixel"),
        t["value"].alias("value"),
        F.coalesce(t["legible"], F.lit(True)).alias("legible")
    )
    d, none = F.col("data"), F.lit("")
    return answers.select(
        "page", "panel", F.lit("curve").alias("kind"), "ord", F.col("error").isNotNull().alias("failed"), d["unit_text"].alias("unit"), F.lit("unknown").alias("scale"), F.coalesce(
            d["confidence"], F.lit(0.0)
        ).alias("confidence"),
        F.lit("unknown").alias("x_kind"), none.alias("x_start"), none.alias("x_end"), F.transform(d["labels"], at).alias("ticks"),
    )


def curve_points(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, series, label, ord, x, y, trace: the visible points of traced curves in pixels of the tile (width, height).

    answers: by, data (kind points), width, height. Curves of fewer than two visible points are left out; trace is the
    curve's confidence times its share of visible points.
    """
    series = answers.select(*by, "width", "height", F.posexplode("data.series").alias("series", "s"))
    points = series.select(
        *by,
        "series",
        "width",
        "height",
        F.col("s.series_label").alias("label"),
        F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"),
        F.posexplode("s.points").alias("ord", "p")
    )
    seen = checks.visible_points(points.withColumn("visible", F.coalesce("p.visible", F.lit(True))), [*by, "series"])
    at = lambda c, dim: geometry.point_to_px(F.col(f"p.{c}_1000"), F.col(dim)).alias(c)
    return seen.select(*by, "series", "label", "ord", at("x", "width"), at("y", "height"), "trace")
