import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tracewright.plans.digitize import digitize
from tracewright.sources import artifacts as a
from tracewright.sources import sinks, zip_members
from tracewright.streaming import landing


def test_month_and_baseline_annotations(spark, tmp_path):
    f = tmp_path / "Passau_210018.tif.txt"
    f.write_text("# LOW_VALUE: 0.5\n# HIGH_VALUE: 3.5\n# IMAGE_SIZE: 9000 4000\n# NOTE: x\n1 0.1 0.5 0.08 0.4\n2 0.2 0.5 0.08 0.3\n")
    pages, boxes = a.read_month_annotations(spark, str(f))
    p = pages.first()
    assert (p.scan_id, p.low_value, p.high_value, p.width, p.height) == ("210018", 0.5, 3.5, 9000, 4000) and boxes.count() == 2
    r = a.anchor_rows(pages, boxes).first()
    assert (r.c_low, r.c_high) == pytest.approx((0.7 * 4000, 0.3 * 4000))
    g = tmp_path / "base.txt"
    g.write_text("# c\n\n0 0.1 0.2 0.3 0.4 0.5 0.6\n0 9 9\n")
    assert [
        (r.i, r.x, r.y) for r in a.read_baseline_annotations(spark, str(g)).orderBy("i").collect()
    ] == [(0, 0.1, 0.2), (1, 0.3, 0.4), (2, 0.5, 0.6)]


def test_hints_are_strict(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(
        json.dumps(
            {
                "station": "Passau",
                "y_anchors": [{"pixel": 1, "value": 2}],
                "panels": [{"index": 1, "y_anchors": [{"pixel": 3, "value": 4}]}]
            }
        )
    )
    bad.write_text(json.dumps({"panels": [{"index": 1, "y_anchors": [{"pixel": 3, "valeu": 4}]}]}))
    row = a.read_hints(spark, str(good)).first()
    assert row.station == "Passau" and row.panels[0].y_anchors[0].value == 4
    with pytest.raises(Exception, match="valeu"):
        a.read_hints(spark, str(bad)).collect()
    assert a.parse_hints(spark.createDataFrame([('{"year": 1849, "yaer": 1}',)], "value string")).first().unknown == ["yaer"]


def test_artifacts_ignore_unknown_fields(spark, tmp_path):
    f = tmp_path / "qc.json"
    f.write_text(json.dumps({"panels": {"p01": {"verdict": "ok", "new": 1}}, "more": 2}))
    row = a.read_artifact(spark, str(f), "qc").first()
    assert row.schema_version == 1 and row.panels["p01"].verdict == "ok"


def test_csv_frames(spark, tmp_path):
    gt = tmp_path / "gt.csv"
    gt.write_text("INDEX,C_X,C_Y,DATE,GAUGELEVEL,ICE,REMARKS,date,GAUGELEVEL_NO_ADJUSTMENT\n0,10,20,1849-01-01,1.5,,,1849-01-01,1.4\n")
    r = a.read_ground_truth(spark, str(gt)).first()
    assert (r.C_X, r.DATE, r.GAUGELEVEL) == (10, date(1849, 1, 1), 1.5)
    ev = tmp_path / "ev.csv"
    ev.write_text(
        "location,file_id,month,confidence,coverage,Max Deviation,Avg Deviation,RMSE,MAE,Pearson r,Custom,isBest\nPassau_21,18,1,0.9,0.8,1,2,3,4,0.5,0.6,yes\nPassau_21,12345,1,0.9,0.8,1,2,3,4,0.5,0.6,no\n"
    )
    assert [r.scan_id for r in a.read_evaluation(spark, str(ev)).orderBy("file_id").collect()] == ["210018", "2112345"]
    ob = tmp_path / "ob.csv"
    ob.write_text(
        "date,gauge_id,waterlevel_mm,confidence,coverage,pixel_x,pixel_y,notes\n1849-01-01,A,1,,,,,\n1850-01-01,A,2,,,,,\n1850-01-01,B,3,,,,,\n"
    )
    assert [r.waterlevel_mm for r in a.read_observations(spark, str(ob), "A", 1850).collect()] == [2.0]


def test_bundles_and_zip_source(spark, tmp_path):
    z = tmp_path / "b.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr(
            "results.json",
            json.dumps(
                {
                    "run_id": "r1",
                    "tiles": {"p01": {"candidates": [{"confidence": 0.9, "points_px_tile": [[1, 2], [3, 4]]}]}, "p02": {"error": "no line"}}
                }
            )
        )
        f.writestr("tiles/210018_M01.png", b"one")
        f.writestr("tiles/210018_M02.png", b"two")
    rows = {r.tile: r for r in a.read_result_bundles(spark, str(z), "r1").collect()}
    assert rows["p01"].cand == 0 and rows["p01"].pts[1].y == 4 and rows["p02"].error == "no line"
    with pytest.raises(Exception, match="another run"):
        a.read_result_bundles(spark, str(z), "r2").collect()
    zip_members.register(spark)
    got = spark.read.format("zip_members").option(
        "path", f"file://{z}"
    ).option("suffix", ".png").option("pattern", "M0[2-9]").option("members", 1).load().collect()
    assert [(r.name, r.size, bytes(r.content)) for r in got] == [("tiles/210018_M02.png", 3, b"two")]


def test_sidecar_candidates(spark, tmp_path):
    f = tmp_path / "p01.candidates.json"
    f.write_text(json.dumps([{"confidence": 0.5, "points": [[0, 1]]}, {"points": [[2, 3], [4, 5]]}]))
    tiles = spark.createDataFrame([("p01",), ("p02",)], "tile string")
    assert sorted(
        (r.tile, r.error or "") for r in a.with_missing(tiles, a.read_candidates(spark, str(f))).collect()
    ) == [("p01", ""), ("p01", ""), ("p02", "no candidates file")]
    assert [
        (r.tile, r.cand, r.confidence, len(r.pts)) for r in a.read_candidates(spark, str(f)).orderBy("cand").collect()
    ] == [("p01", 0, 0.5, 1), ("p01", 1, 1.0, 2)]


def chart(spark):
    """A year's first two months: value = (360 - y) / 10, ticks with one misread, a curve with a gap, a sagging baseline."""
    import math

    ticks, pts, base = [], [], []
    for p in ("p01", "p02"):
        ticks += [(p, i, 360.0 - 50 * i + 0.3 * (i % 3), 5.0 * i if i != 4 else 99.0) for i in range(9)]
        for d in range(31 * 6):
            day = d // 6
            sag = 5 * math.sin(d / 40)
            if not (p == "p02" and day == 10):
                pts.append((p, 1, d, 100.0 + d, 360 - 10 * (12 + 8 * math.sin(day / 5)) + sag, 0.9))
            pts.append((p, 2, d, 100.0 + d, 300.0, 0.2))
            base.append((p, 100.0 + d, 360 + sag, 360.0))
    panels = spark.createDataFrame(
        [(p, 100.0, 286.0, 31, date(1849, m, 1), "Pegel") for p, m in (("p01", 1), ("p02", 3))],
        "panel string, x0 double, x1 double, n int, start date, unit string"
    )
    return (
        spark.createDataFrame(ticks, "panel string, ord int, pixel double, value double"),
        spark.createDataFrame(pts, "panel string, cand int, ord int, x double, y double, confidence double"),
        panels,
        spark.createDataFrame(base, "panel string, x double, y double, beta double"),
    )


def test_digitize_end_to_end(spark, tmp_path):
    import math

    ticks, pts, panels, base = chart(spark)
    out = digitize(ticks, pts, panels, base).cache()
    rows = {(r.panel, r.slice): r for r in out.collect()}
    assert len(rows) == 62 and rows["p02", 10].flagged and sum(r.flagged for r in rows.values()) == 1
    for (p, s), r in rows.items():
        if not r.flagged:
            assert r.value_native == pytest.approx(12 + 8 * math.sin(s / 5), abs=0.1) and r.cand == 1 and r.native_unit == "bavarian_foot"
    assert rows["p01", 0].x_key == "1849-01-01" and rows["p02", 30].x_key == "1849-03-31"
    done = out.select(
        "panel",
        "x_key",
        "value_native",
        "native_unit",
        "value_mm",
        F.col("x").alias("pixel_x_page"),
        F.col("y").alias("pixel_y_page"),
        F.col("y_corrected").alias("pixel_y_corrected"),
        "flagged"
    )
    sinks.series_csv(done, str(tmp_path / "series"), ["panel"])
    back = spark.read.option("header", True).csv(str(tmp_path / "series"))
    assert back.count() == 62 and back.where("flagged = 'true' AND value_native IS NULL").count() == 1
    text = sinks.run_report(
        out,
        spark.createDataFrame([("p01", 0.5)], "panel string, slope double"),
        spark.createDataFrame([("series", "p02", "gap", "info")], "stage string, ref string, reason string, severity string")
    )
    assert "| p02 | 31 | 1 | 1849-03-11 |" in text


def test_status_and_pivot(spark, tmp_path):
    p = str(tmp_path / "status")
    for s in ("running", "done"):
        sinks.append(spark.createDataFrame([("r", "select", s, None)], "run_id string, stage string, status string, error string"), p)
    assert sinks.latest_status(spark.read.parquet(p)).first().status == "done"
    rows = spark.createDataFrame(
        [("a", "cpu", 0.9, ""), ("a", "trace", None, "boom")], "source string, backend string, score double, error string"
    )
    r = sinks.pivot_table(rows, "source", "backend", F.col("score"), ["cpu", "trace"]).first()
    assert (r.cpu, r.trace) == ("0.9", "ERR")


def test_streaming(spark, tmp_path):
    src, out, flags = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "flags")
    src.mkdir()
    (src / "a.json").write_text(
        "\n".join(json.dumps({"run_id": "r", "panel": "p01", "ord": i, "x": float(i), "y": 1.0 * i}) for i in range(5))
    )
    q = landing.to_series(landing.landing_points(spark, str(src)), out, str(tmp_path / "ck"), 0.0, 10.0, 10, flags)
    q.awaitTermination(120)
    assert spark.read.parquet(out).where("NOT flagged").count() == 5 and spark.read.parquet(flags).first().reason == "5 empty slices"


def flat_chart(spark, panels, columns):
    """Panels with a line at y = 200 (value 16 by the ticks of `p1`) and one at y = 300, and two of three without ticks."""
    ticks = [("p1", i, 360.0 - 50 * i, 5.0 * i) for i in range(6)] + [("p2", 0, 360.0, 0.0)]
    pts = [
        (p, c, d, 100.0 + d, y + 0.001 * d, conf) for p in ("p1", "p2", "q1") for c,
        y,
        conf in ((1, 200.0, 0.9), (2, 300.0, 0.8), (3, 200.5, 0.85)) for d in range(62)
    ]
    return (
        spark.createDataFrame(ticks, "panel string, ord int, pixel double, value double"),
        spark.createDataFrame(pts, "panel string, cand int, ord int, x double, y double, confidence double"),
        spark.createDataFrame(panels, f"panel string, page string, x0 double, x1 double, unit string, {columns}"),
    )


def test_unusable_panels_take_their_own_pages_axis(spark):
    panels = [
        ("p1", "a", 100.0, 162.0, "mm", 31, date(1849, 1, 1)),
        ("p2", "a", 100.0, 162.0, "mm", 31, date(1849, 3, 1)),
        ("q1", "b", 100.0, 162.0, "mm", 31, date(1849, 1, 1))
    ]
    rows = digitize(*flat_chart(spark, panels, "n int, start date")).where("slice = 0").collect()
    got = {r.panel: r for r in rows}
    assert got["p2"].value_native == pytest.approx(16.0, abs=0.1) and "y_fit_shared_from:p1" in got["p2"].flags and got["p2"].donor == "p1"
    assert got["q1"].value_native is None and got["q1"].flags == ["unusable"] and got["q1"].donor is None and not got["q1"].flagged


def test_axes_from_labels_and_months(spark):
    panels = [
        ("p1", "a", 100.0, 162.0, "mm", "numeric", "1", "31", "1849-03-01", "1849-03-31"),
        ("p2", "a", 100.0, 162.0, "mm", "numeric", "40", "10", None, None),
        ("q1", "a", 100.0, 162.0, "mm", "date", "Juli 1849", "", None, None)
    ]
    rows = digitize(
        *flat_chart(spark, panels, "x_kind string, x_start string, x_end string, month_start string, month_end string")
    ).collect()
    keys = lambda p: [r.x_key for r in sorted((r for r in rows if r.panel == p), key=lambda r: r.slice)]
    assert (keys("p1")[0], keys("p1")[-1], len(keys("p1"))) == ("1849-03-01", "1849-03-31", 31)
    assert (
        keys("p2")[0], keys("p2")[1], keys("p2")[-1]
    ) == ("40", "39", "10") and (keys("q1")[0], keys("q1")[-1]) == ("1849-07-01", "1849-07-31")


def test_several_series_and_anchors(spark):
    panels = [
        ("p1", "a", 100.0, 162.0, "mm", 31, None, 2, ["Pegel", "Wind"], 400.0), ("p2", "a", 100.0, 162.0, "mm", 31, None, 3, None, 400.0)
    ]
    ticks, pts, panels = flat_chart(spark, panels, "n int, start date, n_series int, labels array<string>, height double")
    anchors = spark.createDataFrame(
        [("a", None, 0, 400.0, 0.0), ("a", None, 1, 0.0, 400.0), ("a", "p2", 0, 400.0, 0.0), ("a", "p2", 1, 0.0, 40.0)],
        "page string, panel string, ord int, pixel double, value double"
    )
    assigned = spark.createDataFrame([("p1", {1: "Wind", 2: "Pegel"})], "panel string, assigned map<int,string>")
    rows = digitize(ticks, pts.where("panel != 'q1'"), panels, anchors=anchors, assigned=assigned).where("slice = 0").collect()
    got = sorted((r.panel, r.series, r.cand, r.label, round(r.value_native, 2)) for r in rows)
    assert got == [
        ("p1", "s1", 1, "Wind", 200.0),
        ("p1", "s2", 2, "Pegel", 100.0),
        ("p2", "s1", 1, "series 1", 20.0),
        ("p2", "s2", 2, "series 2", 10.0)
    ]
    flags = {r.panel: r.flags for r in rows}
    assert "too_few_curves" in flags[
        "p2"
    ] and "too_few_curves" not in flags["p1"] and "hint_mismatch" in flags["p1"] and "user_hint:y_anchors" in flags["p2"]


def test_scale_and_side_in_the_chain(spark):
    """A panel declared linear with log ticks, and one with two value scales."""
    ticks = [("p1", i, 400.0 - 40 * i, 10.0 ** (i / 2), None) for i in range(8)] + [("p2", i, 400.0 - 40 * i, 5.0 * i, "left") for i in range(8)] + [
        ("p2", 10 + i, 395.0 - 40 * i, 900.0 * i + (300 if i % 2 else 0), "right") for i in range(8)
    ]
    _, pts, panels = flat_chart(
        spark,
        [("p1", "a", 100.0, 162.0, "mm", 31, None, "linear", False), ("p2", "b", 100.0, 162.0, "mm", 31, None, "unknown", True)],
        "n int, start date, y_scale string, dual boolean"
    )
    rows = digitize(
        spark.createDataFrame(ticks, "panel string, ord int, pixel double, value double, side string"), pts.where("panel != 'q1'"), panels
    ).where("slice = 0").collect()
    got = {r.panel: r.value_native for r in rows}
    assert got["p1"] == pytest.approx(10**2.5, rel=0.01) and got["p2"] == pytest.approx(25.0, rel=0.01)


def test_streaming_again_doubles_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"run_id": "r", "panel": "p01", "ord": i, "x": float(i), "y": 1.0}) for i in range(5)))
    for checkpoint in ("one", "two"):  # a lost checkpoint runs the same batch again
        landing.to_series(landing.landing_points(spark, str(src)), out, str(tmp_path / checkpoint), 0.0, 10.0, 10).awaitTermination(120)
    assert spark.read.parquet(out).count() == 10
    live = landing.live_coverage(landing.landing_points(spark, str(src)), 0.0, 10.0, 10)
    q = live.writeStream.format("memory").queryName("live_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live_test").first().coverage == 0.5


def test_zip_source_checks_members(spark, tmp_path):
    z = tmp_path / "t.zip"
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.png", b"x" * 500)
        f.writestr("b.png", b"yy")
    zip_members.register(spark)
    load = lambda: spark.read.format("zip_members").option("path", f"file://{z}").option("members", 1).load()
    assert sorted((r.name, bytes(r.content)) for r in load().collect()) == [("a.png", b"x" * 500), ("b.png", b"yy")]
    raw = bytearray(z.read_bytes())
    raw[40] ^= 1
    z.write_bytes(raw)
    with pytest.raises(Exception, match="checksum|decompress"):
        load().collect()


def test_images_gauges_truth_and_levels(spark, tmp_path):
    for name in ("a.png", "sub/b.TIF", "c.txt"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(name.encode())
    assert sorted(bytes(r.content) for r in a.read_images(spark, str(tmp_path / "img")).collect()) == [b"a.png", b"sub/b.TIF"]
    (tmp_path / "g.csv").write_text("gauge_id,gauge_name,river\nDE_BY_DAN_21,Passau,Donau\n")
    assert a.read_gauges(spark, str(tmp_path / "g.csv")).first().name == "Passau"
    (tmp_path / "x.truth.json").write_text(json.dumps({"months": [{"month": 2, "box": [1, 2, 3, 4]}]}))
    r = a.read_truth(spark, str(tmp_path / "x.truth.json")).first()
    assert (r.stem, r.month, r.box.w) == ("x", 2, 3)
    (tmp_path / "gt.csv").write_text(
        "INDEX,C_X,C_Y,DATE,GAUGELEVEL,ICE,REMARKS,date,GAUGELEVEL_NO_ADJUSTMENT\n0,10,20,1849-01-01,1.5,,,1849-01-01,1.4\n1,1,2,1849-01-02,,,,,\n"
    )
    assert [r.GAUGELEVEL for r in a.read_levels(spark, str(tmp_path / "gt.csv")).collect()] == [1.5]
    wanted = spark.createDataFrame([("h1", "p"), ("h2", "p")], "sha string, prompt string")
    have, missing = a.cached_responses(
        wanted, spark.createDataFrame([("h1", "p", "{}")], "sha string, prompt string, response string"), ["sha", "prompt"]
    )
    assert [r.sha for r in have.collect()] == ["h1"] and [r.sha for r in missing.collect()] == ["h2"]


def test_series_reader_and_small_sinks(spark, tmp_path):
    folder = tmp_path / "runs" / "210018_tif_M03"
    folder.mkdir(parents=True)
    (folder / "series_p01.csv").write_text(
        "x_key,value_native,native_unit,value_mm,pixel_x_page,pixel_y_page,pixel_y_corrected,flagged\n1849-03-01,1.5,mm,1.5,1,2,3,false\n7,,,,,,,true\n"
    )
    rows = a.read_series(spark, str(folder / "series_p01.csv")).orderBy("x_key").collect()
    assert (
        rows[0].scan_id, rows[0].month, rows[0].series_key, rows[0].date
    ) == ("210018", 3, "p01", date(1849, 3, 1)) and rows[1].date is None
    doc = spark.createDataFrame([(1, "t")], "schema_version int, title string")
    sinks.write_artifact(doc, str(tmp_path / "meta"))
    assert a.read_artifact(spark, str(tmp_path / "meta"), "metadata").first().title == "t"
    sinks.bundle(spark.createDataFrame([("r1", "p01", b"x")], "run_id string, tile string, content binary"), str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle")).where("run_id = 'r1'").count() == 1
    tiles = spark.createDataFrame(
        [("pg", m, 10 * m, 0, 10, 5, 20, 5, "mm") for m in (2, 1)],
        "page string, month int, x int, y int, w int, h int, page_w int, page_h int, unit string"
    )
    made = sinks.pseudo_page(tiles, ["page"]).first()
    assert json.loads(made.truth) == {
        "months": [{"month": 1, "box": [10, 0, 10, 5]}, {"month": 2, "box": [20, 0, 10, 5]}]
    } and json.loads(made.hints)["expected_panels"] == 2
    report = sinks.evaluation_report(
        spark.createDataFrame([(1, 0.5)], "run int, median_slope_err_pct double"),
        spark.createDataFrame([(1, 12)], "run int, n int"),
        spark.createDataFrame([(1, 0.9)], "run int, mean_peak_score double"),
        str(tmp_path / "eval")
    )
    assert "## Panels found" in report and spark.read.option("header", True).csv(
        str(tmp_path / "eval" / "series")
    ).first().mean_peak_score == "0.9"
    sinks.annual_csv(
        spark.createDataFrame([("r", "1849-01-01", 1.23456, 1)], "run string, x_key string, value double, panel_ord int"),
        str(tmp_path / "annual"),
        ["run"]
    )
    assert spark.read.option("header", True).csv(str(tmp_path / "annual")).first().value_native == "1.2346"


def test_runs_units_and_config(spark, tmp_path):
    from tracewright.config import GENERIC, dump
    from tracewright.operators import checks

    for run in ("210018_tif_M03", "290022_tif_M11", "other"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "manifest.json").write_text("{}")
    assert sorted((r.scan_id, r.month) for r in a.discover_runs(spark, str(tmp_path)).collect()) == [("210018", 3), ("290022", 11)]
    series = spark.createDataFrame(
        [("p", "2", "cm"), ("p", "1", " "), ("p", "3", "mm"), ("q", "1", None)], "panel string, x_key string, native_unit string"
    )
    assert {r.panel: r.unit for r in a.unit_of(series, ["panel"]).collect()} == {"p": "cm", "q": None}
    assert json.loads(dump(GENERIC))["viable_coverage"] == 0.9
    assert spark.range(1).select(checks.percent(F.lit(0.0345))).first()[0] in ("3.5%", "3.4%")
