"""Reports: whole, in order, with their figures."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions.text import general
from tracewright.operators import axes, checks
from tracewright.sources import reports, sinks


def test_general_numbers_as_c_prints_them(spark):
    numbers = [
        0.0, 1.0, -0.1234567, 123456.0, 12345.6, 99999.5, 1e-5, 0.00012345678, -2.5e17, 3.14159265, 100.0, 1e300, 0.1, 999995.0, None
    ]
    got = spark.createDataFrame([(x,) for x in numbers], "v double").select(general(F.col("v"), 5)).collect()
    assert [r[0] for r in got] == [None if x is None else f"{x:.5g}" for x in numbers]


def test_reports_of_two_runs(spark, tmp_path):
    make = spark.createDataFrame
    box = "box struct<x:int,y:int,w:int,h:int>"
    parts = [
        reports.head_lines(
            make(
                [("r1", "annual", "1", "a.png", 10, 20), ("r2", None, None, None, None, None)],
                "run_id string, profile string, version string, input string, width int, height int"
            )
        ),
        reports.panel_lines(
            make(
                [("r1", f"p{i:03}", "", (i, 0, 5, 5), 0.9, ["x", "y"] if i == 1 else None) for i in range(250)],
                f"run_id string, panel string, label string, {box}, confidence double, flags array<string>"
            )
        ),
        reports.calibration_lines(
            make(
                [
                    ("r1", "p1", "mm", "linear", -0.1234567, 0.99912345, 5, 6, ["low_r2:0.9991"]),
                    ("r1", "p2", "mm", None, None, None, None, None, ["unusable"])
                ],
                "run_id string, panel string, unit string, scale string, slope double, r2 double, n_used int, n_ticks int, flags array<string>"
            )
        ),
        reports.extraction_lines(
            make(
                [
                    ("r1", "p1", None, 4, "s1", "Level", 2, 0.5, None, 0.25, "s_alpha"),
                    ("r1", "p2", "no line", 0, None, None, None, None, None, None, None),
                    ("r1", "p3", "", 3, None, None, None, None, None, None, None)
                ],
                "run_id string, panel string, error string, n_candidates int, series string, label string, cand int, confidence double, coverage double, s_alpha double, method string"
            )
        ),
        reports.series_lines(
            make(
                [
                    ("r1", "p1", "p1", "Level", "p1.csv", 31, 2, True, {"panel": 0.5, "coverage": 1.0}, "minor", "off by one"),
                    ("r1", "annual", "annual", None, "y.csv", 365, 3, None, None, None, None)
                ],
                "run_id string, key string, panel string, label string, path string, n int, n_gaps int, baseline_applied boolean, chain map<string,double>, verdict string, reason string"
            )
        ),
        reports.flag_lines(
            make(
                [
                    ("r1", "info", "select", "p1", "later"),
                    ("r1", "blocking", "series", None, "first"),
                    ("r2", "warning", "qc", "p9", "second")
                ],
                "run_id string, severity string, stage string, ref string, reason string"
            )
        ),
    ]
    found = reports.reports(*parts)
    text = {r.run_id: r.report for r in found.collect()}
    one = text["r1"].split("\n")
    assert one[0] == "# Run report: r1" and "- input: `a.png` (10x20)" in one and sum(
        x.startswith("| p") and "5,5" in x for x in one
    ) == 250
    for line in (
        "| p001 |  | 1,0,5,5 | 0.90 | x, y |", "| p1 | mm | linear | -0.12346 | 0.9991 | 5/6 | low_r2:0.9991 |", "| p2 | mm |  | - | - | - | unusable |", "| p1 Level | 4 | 2 | 0.500 | 0.000 | 0.250 | s_alpha |", "| p2 | ERROR: no line |  |  |  |  |  |",
        "| p3 | 3 | none |  |  |  |  |", "- **Level** csv: `p1.csv` (31 samples, 2 gaps, baseline applied)", "  - confidence chain: coverage=1.00, panel=0.50", "  - QC: **minor** off by one", "- csv: `y.csv` (365 days, 3 gaps)",
    ):
        assert line in one, line
    order = [
        one.index(x) for x in (
            "## Panels",
            "## Calibration",
            "## Extraction",
            "## Series",
            "### Annual series",
            "### p1",
            "## Review flags",
            "| blocking | series |  | first |",
            "| info | select | p1 | later |"
        )
    ]
    assert order == sorted(order) and "## Panels" not in text["r2"] and "- input" not in text["r2"] and text["r2"].endswith(
        "| warning | qc | p9 | second |\n"
    )
    reports.write(found, str(tmp_path / "out"))
    back = {r.run_id: r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert {k: v.rstrip("\n") for k, v in back.items()} == {k: v.rstrip("\n") for k, v in text.items()}


def test_what_a_table_leaves_out_is_told(spark):
    df = spark.range(7).coalesce(1)
    assert "... and 4 more rows" in sinks.markdown(df, "t", 3) and "more rows" not in sinks.markdown(df, "t", 7)


def test_results_are_sentences(spark, tmp_path):
    report = sinks.evaluation_report(
        spark.createDataFrame(
            [("r", 3, 2, 1.234, 2.0, 0.5, 0.75)],
            "run string, n int, n_usable int, median_slope_err_pct double, median_zero_px_err double, median_induced_mae double, worst_induced_mae double"
        ),
        spark.createDataFrame(
            [("r", 12, 11, 0.9123, 0.5, 0.6)],
            "run string, n int, n_detected int, mean_iou double, pooled_median double, worse_median double"
        ),
        spark.createDataFrame(
            [(f"r{i}", 12, 1.0, 2.0, 9.5, 0.9, 0.95, None) for i in range(4)],
            "run string, n int, mean_rmse double, mean_mae double, mean_maxae double, mean_pearson_r double, mean_peak_score double, mean_paper_peak_score double"
        ),
        str(tmp_path), most=3,
    )
    for said in (
        "- months evaluated: 3 (2 usable)",
        "- median slope error: 1.23 %",
        "- panels detected: 11/12",
        "- mean IoU: 0.912",
        "- median |x-edge error|: 0.60 days",
        "- mean peak-aware score: 0.950",
        "- mean largest error: 9.50",
        "... and 1 more rows"
    ):
        assert said in report, said
    assert "published" not in report and spark.read.option("header", True).csv(str(tmp_path / "series")).count() == 4


def test_axis_flags_have_their_figures(spark):
    ticks = [("a", "p1", i, 100.0 * i, 2.0 * i * i) for i in range(6)] + [
        ("a", "p2", 0, 0.0, 0.0), ("a", "p2", 1, 100.0, 50.0), ("b", "p1", 0, 1.0, 1.0)
    ]
    panels = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p1"), ("b", "p2")], "page string, panel string")
    found = axes.share(
        axes.calibrate(panels, spark.createDataFrame(ticks, "page string, panel string, ord int, pixel double, value double"))
    )
    told = {(r.ref, r.severity, r.reason) for r in checks.axis_flags(found).collect()}
    rows = {(r.page, r.panel): r for r in found.collect()}
    r2 = rows["a", "p1"].r2
    assert r2 < 0.995 and (
        "p1", "warning", f"axis fit r2={r2:.4f} below gate 0.995"
    ) in told and f"low_r2:{r2:.4f}" in rows["a", "p1"].flags
    assert (
        "p2", "warning", "only 2 calibration points; using two-anchor mapping"
    ) in told and ("p1", "blocking", "no usable axis fit (0 calibration points)") in told
    off = [x for x in told if "differs from donor p1 by" in x[2]]
    assert len(off) == 1 and off[0][2].endswith("%")
    assert rows["b", "p2"].flags == ["unusable"] and pytest.approx(0.5) == rows["a", "p2"].slope
