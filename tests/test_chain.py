"""Answers of a model, hints, rasters and extractors."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.operators import checks, evaluation, extractors, hints, raster, readings, resample
from tracewright.operators import candidates as cd
from tracewright.sources import artifacts, responses

TRIAGE = {
    "rotation_deg": 0,
    "chart_kind": "line_chart",
    "y_axis_labels_present": True,
    "panels": [{"box": {"x0": 0, "y0": 0, "x1": 900, "y1": 1001}, "plot_area": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "confidence": 0.9}]
}


def parsed(spark, kind, *answers):
    text = [(i, a if isinstance(a, str | None) else json.dumps(a)) for i, a in enumerate(answers)]
    return responses.parse(spark.createDataFrame(text, "attempt int, text string"), kind).orderBy("attempt").collect()


def test_answers_are_checked_by_kind(spark):
    without = {k: v for k, v in TRIAGE.items() if k != "panels"}
    panel = TRIAGE["panels"][0]
    no_box = TRIAGE | {"panels": [panel, {**panel, "box": {"x0": 1, "y0": 2, "x1": 3}}]}
    got = parsed(
        spark,
        "triage",
        TRIAGE,
        f"Here it is:\n```json\n{json.dumps(TRIAGE)}\n```",
        json.dumps(TRIAGE)[:-9],
        without,
        no_box,
        TRIAGE | {"chart_kind": "pie"},
        TRIAGE | {"rotation_deg": "up"},
        None,
        "",
        TRIAGE | {"y_scale_guess": "log", "other": 1, "confidence": 1.5}
    )
    assert [r.error for r in got] == [
        None,
        None,
        "malformed",
        "missing:panels",
        "missing:panels[].box.y1",
        "unknown word:chart_kind",
        "malformed",
        "malformed",
        "malformed",
        None
    ]
    assert got[0].data.panels[0].box.x1 == 900 and got[0].out_of_range == ["panels[].box.y1"] and got[3].data is None and got[9].out_of_range == [
        "panels[].box.y1", "confidence"
    ]
    assert [
        r.error for r in parsed(spark, "qc", {"verdict": "ok", "issues": ["noise"]}, {"verdict": "fine"}, {"issues": []}, {"verdict": None})
    ] == [None, "unknown word:verdict", "missing:verdict", "missing:verdict"]
    assert [
        r.error for r in parsed(
            spark,
            "axis",
            {"y_ticks": [], "x_kind": "date", "confidence": 1},
            {"y_ticks": [{"pos_1000": 1}], "x_kind": "date", "confidence": 1}
        )
    ] == [None, "missing:y_ticks[].value"]
    for kind, spec in responses.KINDS.items():
        assert parsed(spark, kind, "{}")[0].error == f"missing:{spec.required[0]}"


def test_the_first_valid_answer_stands(spark):
    rows = [
        ("a", 1, "{"),
        ("a", 2, '{"verdict": "bad"}'),
        ("a", 3, '{"verdict": "minor"}'),
        ("a", 4, '{"verdict": "ok"}'),
        ("b", 1, "x"),
        ("b", 2, "{}")
    ]
    got = responses.first_valid(
        responses.parse(spark.createDataFrame(rows, "q string, attempt int, text string"), "qc"), ["q"]
    ).orderBy("q").collect()
    assert [
        (r.n_attempts, r.n_malformed, r.n_invalid, r.attempt, r.data and r.data.verdict, r.last_error) for r in got
    ] == [(4, 1, 1, 3, "minor", None), (2, 1, 1, None, None, "missing:verdict")]


def test_answers_become_attempts_and_curves(spark):
    axis = {
        "y_ticks": [{"pos_1000": 500, "value": 2.5, "side": "left"}, {"pos_1000": 100, "value": 1, "legible": False}],
        "x_kind": "date",
        "x_start_label": "Juli 1849",
        "confidence": 0.7,
        "y_unit_text": "Fuss"
    }
    labels = {"labels": [{"x_1000": 1, "y_1000": 250, "value": 7}], "unit_text": "mm"}
    keys = "page string, panel string, kind string, ord int, text string, crop struct<y:bigint,h:bigint>"
    one = responses.parse(
        spark.createDataFrame([("a", "p1", "axis", 1, json.dumps(axis), (40, 200)), ("a", "p2", "axis", 1, "?", (0, 10))], keys), "axis"
    )
    two = responses.parse(spark.createDataFrame([("a", "p2", "curve", 1, json.dumps(labels), (100, 400))], keys), "curve_labels")
    panels = spark.createDataFrame(
        [("a", "p1", 1.0, True, False, "linear"), ("a", "p2", 9.0, True, True, "log")],
        "page string, panel string, x double, axis_labels boolean, curve_labels boolean, scale_guess string"
    )
    got = {r.panel: r for r in readings.cascade(panels, responses.axis_attempts(one).unionByName(responses.label_attempts(two))).collect()}
    assert [(t.pixel, t.value) for t in got["p1"].ticks] == [(140.0, 2.5)] and (got["p1"].unit, got["p1"].x_start) == ("Fuss", "Juli 1849")
    assert [(t.pixel, t.value) for t in got["p2"].ticks] == [(200.0, 7.0)] and got["p2"].flags == ["curve_labels"] and not got["p2"].failed
    trace = {
        "series": [
            {
                "series_label": "A",
                "points": [
                    {"x_1000": 0, "y_1000": 500},
                    {"x_1000": 1200, "y_1000": 250, "visible": True},
                    {"x_1000": 5, "y_1000": 5, "visible": False}
                ],
                "confidence": 0.9
            },
            {"series_label": "B", "points": [{"x_1000": 1, "y_1000": 1}]}
        ]
    }
    answers = responses.parse(
        spark.createDataFrame([("t", json.dumps(trace), 300, 80)], "tile string, text string, width int, height int"), "points"
    )
    assert [
        (r.label, r.ord, r.x, r.y, pytest.approx(r.trace)) for r in responses.curve_points(answers, ["tile"]).orderBy("ord").collect()
    ] == [("A", 0, 0.0, 40.0, 0.6), ("A", 1, 300.0, 20.0, 0.6)]
    assert checks.legible(
        spark.createDataFrame([(1.0, True), (2.0, None), (3.0, False), (None, True)], "value double, legible boolean")
    ).count() == 2


# --- hints -----------------------------------------------------------------------------------------------------


def test_drawn_boxes_replace_detected_ones(spark):
    run = f"run_id string, panels array<{schemas.PANEL_HINT}>"
    hint = lambda index, box=None, plot=None, label="": (index, None, label, box, plot, None, None, None, None, None)
    given = spark.createDataFrame(
        [("r", [hint(2, [-5, 10, 40, 40]), hint(None, [50, 0, 100, 20], [60, 5, 10, 10], "top"), hint(7)]), ("s", [hint(1)]), ("u", [])],
        run
    )
    pages = spark.createDataFrame([(x, 120, 45) for x in "rstu"], "run_id string, width long, height long")
    detected = hints.hint_panels(
        spark.createDataFrame([(x, [hint(1, [1, 1, 9, 9])]) for x in "rstu"], run), pages
    ).withColumn("flags", F.array(F.lit("low_confidence")))
    got = {(r.run_id, r.panel): r for r in hints.panels_of(detected, given, pages).collect()}
    assert set(got) == {("r", "p01"), ("r", "p02"), ("s", "p01"), ("t", "p01"), ("u", "p01")}
    assert tuple(
        got["r", "p02"].box
    ) == (0, 10, 40, 35) and got["r", "p02"].plot == got["r", "p02"].box and got["r", "p02"].flags == ["user_hint:bbox"]
    assert tuple(got["r", "p01"].box) == (50, 0, 70, 20) and tuple(got["r", "p01"].plot) == (60, 5, 10, 10) and (
        got["r", "p01"].label, got["r", "p01"].confidence
    ) == ("top", 1.0)
    assert got["s", "p01"].flags == ["low_confidence"]
    with pytest.raises(Exception, match="four numbers"):
        hints.hint_panels(spark.createDataFrame([("r", [hint(1, [1, 2, 3])])], run), pages).collect()


def test_annotations_as_hints_and_back(spark, tmp_path):
    f = tmp_path / "Ort_700412.tif.txt"
    f.write_text("# LOW_VALUE: 0.5\n# HIGH_VALUE: 3.5\n# IMAGE_SIZE: 9000 4000\n1 0.1 0.5 0.08 0.4\n2 0.2 0.52 0.08 0.4\n")
    pages, boxes = artifacts.read_month_annotations(spark, str(f))
    wanted = spark.createDataFrame(
        [("700412", 1839, 2, 2000), ("700412", 1880, None, None)], "scan_id string, year int, month int, tile_h int"
    )
    made = hints.from_annotations(pages, boxes, wanted).withColumn("run", F.coalesce(F.col("month").cast("string"), F.lit("sheet")))
    tile, sheet = (r.hints for r in made.orderBy(F.col("month").isNull()).collect())
    assert (
        tile.expected_panels, tile.panels[0].x_start, tile.panels[0].x_end, tile.unit, tile.panel_layout, tile.station
    ) == (1, "1839-02-01", "1839-02-28", "bavarian_foot", "single", "70")
    # January spans rows 1200 to 2800; February's box begins at 1280 and lies 200 rows down its tile.
    assert [(a.pixel, a.value) for a in tile.y_anchors] == [
        (pytest.approx(2800 - 1280 + 200), 0.5), (pytest.approx(1200 - 1280 + 200), 3.5)
    ]
    assert [
        (p["index"], p.month, p.x_start) for p in sheet.panels
    ] == [(1, 1, None), (2, 2, None)] and (sheet.unit, sheet.panel_layout) == ("mm", "row")
    assert [a.pixel for a in sheet.y_anchors] == [pytest.approx(2800), pytest.approx(1200)]
    hints.save(made, str(tmp_path / "hints"), "run")
    back = {r.path.rsplit("run=", 1)[1].split("/")[0]: r for r in artifacts.read_hints(spark, str(tmp_path / "hints/*")).collect()}
    assert back["2"].panels == tile.panels and back["sheet"].y_anchors == sheet.y_anchors and back["2"].notes == tile.notes


# --- rasters ---------------------------------------------------------------------------------------------------


def convolved(row, width):
    """Cubic convolution of one row, weight by weight."""
    scale = len(row) / width
    wide = max(1.0, scale)

    def kernel(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    out = []
    for j in range(width):
        mid = (j + 0.5) * scale
        own = range(max(0, int(mid - 2 * wide + 0.5)), min(len(row), int(mid + 2 * wide + 0.5)))
        w = [kernel((i - mid + 0.5) / wide) for i in own]
        out.append(sum(a * row[i] for a, i in zip(w, own, strict=True)) / sum(w))
    return out


@pytest.mark.parametrize(("factor", "width"), [(2.0, 22), (1.0, 11), (3.3, 36), (0.5, 6), (0.01, 1)])
def test_stretch_weight_by_weight(spark, factor, width):
    rows = [[(7 * i * i + 13 * k) % 256 for i in range(11)] for k in range(3)]
    pixels = spark.createDataFrame(
        [("t", k, i, v) for k, row in enumerate(rows) for i, v in enumerate(row)], "tile string, row int, col int, gray int"
    ).repartition(3)
    got = {(r.row, r.col): r.gray for r in raster.stretch(pixels, ["tile"], factor).collect()}
    want = {(k, j): v for k, row in enumerate(rows) for j, v in enumerate(convolved(row, width))}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    whole = raster.stretch(pixels, ["tile"], factor, whole=True).collect()
    assert {(r.row, r.col): r.gray for r in whole} == {k: min(255, max(0, int((v + 0.5) // 1))) for k, v in want.items()}


def test_images_become_pixels(spark, tmp_path):
    import struct
    import zlib

    def png(path, rows, kind, channels):
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        raw = b"".join(b"\x00" + bytes(v for p in row for v in (p if channels > 1 else [p])) for row in rows)
        path.write_bytes(
            b"\x89PNG\r\n\x1a\n" + chunk(
                b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)
            ) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        )

    colour = [[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(10, 20, 30), (0, 0, 0), (255, 255, 255)]]
    png(tmp_path / "colour.png", colour, 2, 3)
    png(tmp_path / "gray.png", [[0, 128], [200, 255]], 0, 1)
    (tmp_path / "sheet.tif").write_bytes(b"II*\x00 no image")
    pixels, bad = artifacts.read_pixels(spark, str(tmp_path))
    got = {(r.tile, r.row, r.col): r.gray for r in pixels.collect()}
    assert {k: v for k, v in got.items() if k[0] == "colour"} == {
        ("colour", y, x): (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16 for y,
        row in enumerate(colour) for x,
        (r, g, b) in enumerate(row)
    }
    assert [got["gray", y, x] for y in (0, 1) for x in (0, 1)] == [0, 128, 200, 255]
    assert [(r.tile, "sheet.tif" in r.error) for r in bad.collect()] == [("sheet", True)]


# --- extractors ------------------------------------------------------------------------------------------------


def test_backends_are_checked_and_merged(spark):
    tiles = spark.createDataFrame(
        [("full", r, c, 200 if r == 3 else 10 + r) for r in range(6) for c in range(8)] + [
            ("thin", r, c, 200 if r == 2 and c < 3 else 100 if r == 4 else 10) for r in range(6) for c in range(8)
        ],
        "tile string, row int, col int, gray int"
    )
    assert {"mask", "ridge"} <= set(extractors.names())
    got = extractors.extract_with_fallback("mask", "ridge", tiles, lambda p: p.where("confidence > 0.9"))
    rows = {
        (r.tile, r.cand, r.pool): r for r in got.groupBy("tile", "cand", "pool").agg(
            F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")
        ).collect()
    }
    assert {k: (r.n, r.low, r.high) for k, r in rows.items()} == {
        ("full", 0, "primary"): (8, 3.0, 3.0), ("thin", 0, "primary"): (3, 2.0, 2.0), ("thin", 1, "fallback"): (8, 2.0, 4.0)
    }
    with pytest.raises(ValueError, match="no backend 'none'"):
        extractors.extract("none", tiles)

    @extractors.register("odd")
    def odd(tiles):
        return tiles.select("tile", F.lit("1").alias("cand"), F.col("col").alias("ord"), F.col("col").cast("double").alias("x"))

    try:
        with pytest.raises(ValueError, match="cand is string, y is missing, confidence is missing"):
            extractors.extract("odd", tiles)
        with pytest.raises(ValueError, match="already"):
            extractors.register("odd")(odd)
    finally:
        del extractors._BACKENDS["odd"]
    extractors.register_table_functions(spark)
    tiles.createOrReplaceTempView("tiles_of_test")
    sql = spark.sql("SELECT tile, ord, x, y FROM mask_curve(TABLE(tiles_of_test) PARTITION BY (tile), 128.0)")
    assert sorted(map(tuple, sql.collect())) == sorted(
        map(tuple, extractors.extract("mask", tiles).select("tile", "ord", "x", "y").collect())
    )


def test_probes_and_summaries(spark):
    got = spark.createDataFrame(
        [(1,), (40,), (41,), (None,), (0,), (3,)], "n int"
    ).select("n", resample.probe_places(F.col("n")).alias("p")).collect()
    step = 980 / 39
    forty = [int(10 + i * step) if i < 39 else 990 for i in range(40)]
    assert [r.p for r in got] == [[10], forty, forty, forty, forty, [10, 500, 990]]
    points = spark.createDataFrame(
        [("t", i, float(i), float(-i)) for i in range(100)] + [("u", 0, 1.0, 2.0)], "tile string, ord int, x double, y double"
    )
    traced = {r.tile: [p.ord for p in r.probes] for r in resample.probes(points, ["tile"], 5).collect()}
    assert traced == {"t": [0, 24, 49, 74, 99], "u": [0]}
    runs = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = evaluation.extractor_summary(
        runs([("a", 0.5), ("a", 1.0), ("b", None)], "run string, coverage double"),
        runs(
            [("a", "tokens:in", "5"), ("a", "tokens:out", "x"), ("a", "seconds", "9"), ("c", "tokens:in", "7")],
            "run string, key string, value string"
        ),
        runs([("a", "p02", "ok"), ("a", "p01", "minor")], "run string, panel string, verdict string")
    )
    assert sorted(map(tuple, got.collect())) == [("a", 0.75, 5, "p01:minor p02:ok"), ("b", None, 0, ""), ("c", None, 7, "")]


def test_published_rows_fall_back_only_without_any_mark(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 2)], "scan string, month int")
    published = lambda marks: spark.createDataFrame(
        [("s", m, p, 1.0, k) for m, p, k in marks], "scan string, month int, peak_score double, rmse double, isBest string"
    )
    got = lambda marks: sorted(
        (r.month, r.paper_peak_score) for r in evaluation.with_published(rows, published(marks), ["scan", "month"]).collect()
    )
    assert got([(1, 0.5, "yes"), (1, 0.9, None), (2, 0.8, "no")]) == [(1, 0.5), (2, None)]
    assert got([(1, 0.5, None), (1, 0.9, None), (2, 0.8, "no")]) == [(1, 0.9), (2, 0.8)]


def test_unused_candidates_operator_agrees(spark):
    """Both ways to choose distinct curves give one answer."""
    pts = spark.createDataFrame(
        [("t", c, k, float(k), y + 0.0 * k) for c, y in ((1, 10.0), (2, 11.0), (3, 30.0), (4, 50.0)) for k in range(5)],
        "tile string, cand int, ord int, x double, y double"
    )
    lines = cd.as_polylines(pts, ["tile", "cand"]).withColumn("rank", F.col("cand"))
    one = cd.distinct_polylines(lines, ["tile"], "rank", 3, F.lit(5.0)).first().accepted
    two = cd.distinct_candidates(
        lines.select("tile", "rank", "cand"), cd.separations(lines, ["tile"], "rank"), ["tile"], 3, F.lit(5.0)
    ).first().accepted
    assert one == two == [1, 3, 4]


def test_panel_counts_are_repaired_and_told(spark):
    from tracewright.operators import boxes

    schema = "page string, pos int, box struct<x:bigint,y:bigint,w:bigint,h:bigint>, plot struct<x:bigint,y:bigint,w:bigint,h:bigint>, flags array<string>"
    one = lambda page, pos, x, w: (page, pos, (x, 0, w, 50), (x + 10, 5, w - 20, 40), ["low"] if pos == 2 else [])
    rows = [
        one("wide", 1, 300, 100),
        one("wide", 2, 0, 300),
        one("wide", 3, 400, 100),
        one("many", 1, 0, 100),
        one("many", 2, 100, 100),
        one("many", 3, 205, 20),
        one("right", 1, 50, 10),
        one("right", 2, 0, 10),
        one("short", 1, 0, 100),
        one("short", 2, 100, 100)
    ]
    strength = [("wide", 2, c, 9.0 if c in (97, 207) else 5.0 if c == 120 else 1.0) for c in range(301)]
    expected = F.when(F.col("page") == "wide", 5).when(F.col("page") == "short", 4).otherwise(2)
    out, told = boxes.repair_count(
        spark.createDataFrame(rows, schema),
        ["page"],
        expected,
        spark.createDataFrame(strength, "page string, pos int, col bigint, s double")
    )
    got = {(r.page, r.panel): r for r in out.collect()}
    assert [
        (got["wide", f"p{i:02}"].box.x, got["wide", f"p{i:02}"].box.w) for i in (1, 2, 3, 4)
    ] == [(0, 97), (97, 110), (207, 93), (300, 100)]
    assert got["wide", "p01"].flags == ["low", "split_from_multimonth_box"] and got["wide", "p04"].flags == [] and (
        got["wide", "p01"].plot.x, got["wide", "p01"].plot.w
    ) == (10, 87)
    assert {k for k in got if k[0] != "wide"} == {
        ("many", "p01"), ("many", "p02"), ("right", "p01"), ("right", "p02"), ("short", "p01"), ("short", "p02")
    } and got["right", "p01"].pos == 2
    assert {(r.ref, r.severity, r.reason) for r in told.collect()} == {
        ("wide", "info", "split a 3-month-wide box into 3 panels"),
        ("many", "info", "dropped 1 sliver panel(s)"),
        ("short", "blocking", "panel count 2 != expected 4 after repair; hints can draw the boxes")
    }


def test_ranks_over_all_rows(spark):
    from tracewright.operators import metrics

    rows = spark.createDataFrame([((i * 7919) % 1000, f"k{i}") for i in range(500)], "a int, b string")
    want = {r: i for i, r in enumerate(sorted(map(tuple, rows.collect())), 1)}
    for kind in ({"parts": 1}, {"parts": 2}, {"parts": 37}, {"per_range": 20}, {"parts": 2000}):
        assert {(r.a, r.b): r.place for r in metrics.global_rank(rows, ["a", "b"], **kind).collect()} == want


def test_pixels_and_norms_are_inverse(spark):
    from tracewright.functions import geometry

    row = spark.createDataFrame([(250.0, 4000)], "v double, dim int").select(
        geometry.px_to_norm(geometry.norm_to_px(F.col("v"), F.col("dim")), F.col("dim")), geometry.px_to_norm(F.lit(1000.0), F.col("dim"))
    ).first()
    assert tuple(row) == (250.0, 250.0)
