"""The whole chain: keyed by page and panel, and right where it was wrong."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tracewright.operators import axes
from tracewright.plans.digitize import digitize

TICKS = "page string, panel string, ord int, pixel double, value double"
POINTS = "page string, panel string, cand int, ord int, x double, y double, confidence double"
PANELS = "page string, panel string, x0 double, x1 double, unit string, n int, start date"


def ticks(page, panel, slope=-0.1, at=36.0):
    return [(page, panel, i, 360.0 - 50 * i, at + slope * (360.0 - 50 * i)) for i in range(6)]


def curve(page, panel, cand, y, confidence, days=31, each=2.0):
    return [(page, panel, cand, k, 100.0 + k * each / 2, y + 0.001 * k, confidence) for k in range(int(days * 2 / each * 1.0))]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def panel(page, name, **more):
    return (page, name, 100.0, 131.0, "mm", 31, date(1849, 1, 1), *more.values())


def test_two_pages_with_one_panel_name(spark):
    t = frame(spark, ticks("a", "p1") + ticks("b", "p1", slope=-0.2, at=72.0), TICKS)
    p = frame(spark, curve("a", "p1", 1, 200.0, 0.9) + curve("b", "p1", 1, 300.0, 0.9), POINTS)
    base = frame(
        spark,
        [(g, "p1", x, 350.0 + d, 350.0) for g, d in (("a", 5.0), ("b", 0.0)) for x in (100.0, 131.0)],
        "page string, panel string, x double, y double, beta double"
    )
    got = digitize(t, p, frame(spark, [panel("a", "p1"), panel("b", "p1")], PANELS), base).where("slice = 3").collect()
    assert {r.page: pytest.approx(r.value_native, abs=0.02) for r in got} == {"a": 36 - 0.1 * 195, "b": 72 - 0.2 * 300} and len(got) == 2
    assert digitize(t, p, frame(spark, [panel("a", "p1"), panel("b", "p1")], PANELS)).count() == 62


def test_several_series_come_from_viable_curves(spark):
    p = curve("a", "p1", 1, 200.0, 0.6) + curve("a", "p1", 2, 260.0, 0.55) + curve("a", "p1", 3, 320.0, 1.0, days=25)
    panels = frame(spark, [(*panel("a", "p1"), 2, ["one", "two"], 400.0)], PANELS + ", n_series int, labels array<string>, height double")
    got = digitize(frame(spark, ticks("a", "p1"), TICKS), frame(spark, p, POINTS), panels).where("slice = 0").collect()
    assert sorted((r.series, r.cand, r.label) for r in got) == [("s1", 1, "one"), ("s2", 2, "two")]
    none = [row for row in p if row[2] == 3 or row[3] % 2 == 0 and row[4] < 110]
    got = digitize(frame(spark, ticks("a", "p1"), TICKS), frame(spark, none, POINTS), panels).where("slice = 0").collect()
    assert {r.cand for r in got} == {1, 3}  # without a viable curve all stand


def test_one_series_has_its_label_and_its_curve_in_gaps(spark):
    panels = frame(spark, [(*panel("a", "p1"), ["", "Level"]), (*panel("a", "p2"), None)], PANELS + ", labels array<string>")
    p = curve("a", "p1", 7, 200.0, 0.9, days=20) + curve("a", "p2", 8, 200.0, 0.9)
    got = digitize(frame(spark, ticks("a", "p1") + ticks("a", "p2"), TICKS), frame(spark, p, POINTS), panels).collect()
    assert {(r.panel, r.label, r.cand) for r in got} == {("p1", "Level", 7), ("p2", "", 8)} and any(r.flagged and r.cand == 7 for r in got)


def checked(spark, t, anchors, **more):
    extra = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in more.items())
    panels = frame(spark, [("a", "p1", *more.values())], "page string, panel string" + (f", {extra}" if extra else ""))
    own = axes.anchors_of(panels, frame(spark, [("a", "p1", i, p, v) for i, (p, v) in enumerate(anchors)], TICKS), ["page"])
    return axes.calibrate(panels, frame(spark, t, TICKS), anchors=own).first()


def test_anchors_are_checked_at_the_panel_s_scale(spark):
    log = [("a", "p1", i, 300.0 - 50 * i, 10.0 ** (i / 2)) for i in range(6)]
    good = checked(spark, log, [(300.0, 1.0), (100.0, 100.0)], y_scale="log", top=0.0, bottom=360.0)
    assert good.flags == ["two_anchor_only", "user_hint:y_anchors"] and good.scale == "log" and good.method == "user_anchors"
    assert "hint_mismatch" in checked(spark, log, [(300.0, 1.0), (100.0, 10000.0)], y_scale="log", top=80.0, bottom=360.0).flags
    below = [*log, ("a", "p1", 9, 310.0, -1.0)]
    assert "hint_mismatch" not in checked(  # no axis at that scale, no check
        spark, below, [(300.0, 1.0), (100.0, 10000.0)], y_scale="log"
    ).flags


def test_the_crop_is_the_span_of_the_check(spark):
    near = [(200.0, 16.0), (190.0, 17.06)]
    assert "hint_mismatch" in checked(spark, ticks("a", "p1"), near).flags
    assert "hint_mismatch" not in checked(spark, ticks("a", "p1"), near, top=0.0, bottom=360.0).flags
    assert "hint_mismatch" in checked(spark, ticks("a", "p1"), [(200.0, 46.0), (100.0, 56.0)], top=0.0, bottom=360.0).flags


def test_readings_instead_of_ticks(spark):
    tick = [("left", p, v, True) for _, _, _, p, v in ticks("a", "p1")]
    schema = "page string, panel string, kind string, ord int, failed boolean, unit string, scale string, confidence double, x_kind string, x_start string, x_end string, ticks array<struct<side:string,pixel:double,value:double,legible:boolean>>"
    attempts = frame(
        spark,
        [
            ("a", "p1", "axis", 1, False, "", "linear", 0.9, "date", "1849-01-01", "1849-01-31", []),
            ("a", "p1", "curve", 1, False, "cm", "linear", 0.8, "", "", "", tick)
        ],
        schema
    )
    panels = frame(
        spark,
        [("a", "p1", 100.0, 131.0, None, True, True)],
        "page string, panel string, x0 double, x1 double, unit string, axis_labels boolean, curve_labels boolean"
    )
    r = digitize(None, frame(spark, curve("a", "p1", 1, 200.0, 0.9), POINTS), panels, attempts=attempts).where("slice = 30").first()
    assert (r.x_key, r.value_mm, r.flags[0]) == ("1849-01-31", pytest.approx(160.0, abs=1), "curve_labels")


def test_empty_labels_are_the_month_s(spark):
    panels = frame(
        spark,
        [
            ("a", "p1", 100.0, 131.0, "mm", "date", "", "", "1849-02-01", "1849-02-28"),
            ("a", "p2", 100.0, 131.0, "mm", "numeric", "1", "", "x", "31")
        ],
        "page string, panel string, x0 double, x1 double, unit string, x_kind string, x_start string, x_end string, month_start string, month_end string"
    )
    p = frame(spark, curve("a", "p1", 1, 200.0, 0.9) + curve("a", "p2", 1, 200.0, 0.9), POINTS)
    got = {
        r.panel: (r.n, r.flags, r.last) for r in digitize(frame(spark, ticks("a", "p1") + ticks("a", "p2"), TICKS), p, panels).groupBy("panel").agg(
            F.count("*").alias("n"), F.first("flags").alias("flags"), F.max(F.struct("slice", "x_key"))["x_key"].alias("last")
        ).collect()
    }
    assert got["p1"][0] == 28 and got["p1"][2] == "1849-02-28" and "x_from_month_hint" not in got["p1"][1]
    assert got["p2"][0] == 31 and got["p2"][2] == "31"


def test_hints_beat_printed_labels(spark):
    panels = frame(
        spark,
        [
            ("a", "p1", 100.0, 131.0, "mm", "numeric", "1", "31", "1849-03-01", "1849-03-10"),
            ("a", "p2", 100.0, 131.0, "mm", "numeric", "1", "31", None, "")
        ],
        "page string, panel string, x0 double, x1 double, unit string, x_kind string, x_start string, x_end string, hint_start string, hint_end string"
    )
    p = frame(spark, curve("a", "p1", 1, 200.0, 0.9) + curve("a", "p2", 1, 200.0, 0.9), POINTS)
    got = {
        r.panel: (r.n, r.first) for r in digitize(
            frame(spark, ticks("a", "p1") + ticks("a", "p2"), TICKS), p, panels
        ).groupBy("panel").agg(F.count("*").alias("n"), F.min_by("x_key", "slice").alias("first")).collect()
    }
    assert got == {"p1": (10, "1849-03-01"), "p2": (31, "1")}
