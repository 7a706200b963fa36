"""Readings that fall back on one another, chains that go on where they stopped, panels that come in several batches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import readings, resample, runs
from tracewright.sources import sinks
from tracewright.streaming import landing

TICKS = [("left", 360.0 - 50 * i, 5.0 * i, True) for i in range(5)]
PANELS = "page string, panel string, x double, axis_labels boolean, curve_labels boolean, scale_guess string"
ATTEMPTS = f"page string, panel string, kind string, ord int, failed boolean, unit string, scale string, confidence double, x_kind string, x_start string, x_end string, ticks array<struct<side:string,pixel:double,value:double,legible:boolean>>"


def attempt(
    panel, kind, ticks=TICKS, failed=False, unit="Zoll", scale="linear", confidence=0.8, ord_=1, x=("date", "1849-01-01", "1849-01-31")
):
    return ("a", panel, kind, ord_, failed, unit, scale, confidence, *x, ticks)


def read(spark, panels, attempts):
    got = readings.cascade(
        spark.createDataFrame([("a", p, 10.0 * i, *rest) for i, (p, *rest) in enumerate(panels)], PANELS),
        spark.createDataFrame(attempts, ATTEMPTS)
    )
    return {r.panel: r for r in got.collect()}


def test_curve_labels_alone(spark):
    got = read(
        spark,
        [("p1", False, True, "log"), ("p2", False, True, "linear")],
        [
            attempt("p1", "curve", unit="Fuss", confidence=0.85),
            attempt("p1", "axis"),
            attempt("p2", "curve", failed=True),
            attempt("p2", "margin")
        ]
    )
    p = got["p1"]
    assert (
        p.used, p.unit, p.scale, p.confidence, p.x_kind, p.flags, len(p.ticks), p.failed
    ) == ("curve", "Fuss", "log", 0.85, "unknown", ["curve_labels"], 5, False)
    assert got["p2"].failed and got["p2"].flags == ["curve_labels", "reading_failed"] and got["p2"].ticks == []


def test_axis_retry_curve_and_margin_in_order(spark):
    none = []
    panels = [
        ("first", True, False, "unknown"),
        ("kept", True, True, "unknown"),
        ("again", True, True, "unknown"),
        ("curve", True, True, "unknown"),
        ("inner", True, False, "unknown"),
        ("last", True, False, "unknown")
    ]
    attempts = [
        attempt("first", "axis", none, unit="", confidence=0.3), attempt(
            "first", "axis_retry", none, unit="", confidence=0.4
        ), attempt("first", "margin", unit="mm", confidence=0.9),
        attempt("kept", "axis"), attempt("kept", "curve", unit="x"), attempt("kept", "margin"),
        attempt("again", "axis", none, unit="x"), attempt("again", "axis_retry", scale="log", confidence=0.6), attempt("again", "curve"),
        attempt("curve", "axis", none), attempt(
            "curve", "axis_retry", none, unit="Fuss", confidence=0.2, scale="log"
        ), attempt("curve", "curve", unit="mm", confidence=0.7), attempt("curve", "margin"),
        attempt("inner", "axis", none), attempt("inner", "margin"),
        attempt("last", "axis", failed=True), attempt("last", "margin"),
    ]
    got = read(spark, panels, attempts)
    brief = {k: (r.used, r.unit, r.scale, r.confidence, r.flags, len(r.ticks), r.failed) for k, r in got.items()}
    assert brief == {
        "first": (
            "margin", "mm", "linear", 0.4, ["margin_crop_retry"], 5, False
        ), "kept": ("axis", "Zoll", "linear", 0.8, [], 5, False), "again": ("axis_retry", "Zoll", "log", 0.6, [], 5, False),
        "curve": (
            "curve", "Fuss", "log", 0.7, ["curve_labels"], 5, False
        ), "inner": ("axis", "Zoll", "linear", 0.8, [], 0, False), "last": ("axis", "", "linear", 0.0, ["reading_failed"], 0, True),
    }
    assert got["curve"].x_kind == "date" and got["last"].x_kind == "unknown"


def test_a_curve_mends_a_failed_axis(spark):
    got = read(
        spark, [("p1", True, True, "unknown")], [attempt("p1", "axis", failed=True), attempt("p1", "curve", unit="mm", confidence=0.5)]
    )
    assert (got["p1"].used, got["p1"].failed, got["p1"].unit, got["p1"].confidence) == ("curve", False, "mm", 0.5)
    got = read(
        spark,
        [("p1", None, None, None), ("p2", True, False, None)],
        [
            attempt("p1", "axis", [], failed=None, unit=None, confidence=None, x=(None, None, None)),
            attempt("p1", "axis_retry"),
            attempt("p1", "other")
        ]
    )
    assert (got["p1"].used, got["p1"].unit, got["p1"].ticks, got["p2"].used, got["p2"].ticks) == ("axis", "", [], None, [])


def test_illegible_and_repeated_ticks_go(spark):
    ticks = [
        ("left", 100.2, 5.0, True),
        ("right", 99.9, 5.0, True),
        ("left", 100.0, 6.0, None),
        ("left", 50.0, 7.0, False),
        ("left", None, 8.0, True),
        None
    ]
    got = read(spark, [("p1", True, False, None)], [attempt("p1", "axis", ticks[:5], ord_=2), attempt("p1", "axis", ticks[:5], ord_=1)])
    assert [(t.side, t.pixel, t.value) for t in got["p1"].ticks] == [("left", 100.2, 5.0), ("left", 100.0, 6.0)]


# --- chains ----------------------------------------------------------------------------------------------------


def plan(spark, events, stages, ids=("r",), **kind):
    status = spark.createDataFrame(events, "run_id string, stage string, status string")
    found = runs.stages_due(
        spark.createDataFrame([(i,) for i in ids], "run_id string"), status, stages, **kind
    ).orderBy("run_id", "place").collect()
    return [(r.stage, r.action, r.why) for r in found]


def test_what_is_due(spark):
    events = [("r", "a", "done"), ("r", "b", "error"), ("r", "c", "done"), ("other", "a", "error")]
    assert plan(spark, events, ["a", "b", "c"]) == [
        ("a", "skip", "done"), ("b", "run", "was error"), ("c", "run", "a stage before it runs")
    ]
    assert plan(spark, events, ["a", "b", "c"], behind=False) == [("a", "skip", "done"), ("b", "run", "was error"), ("c", "skip", "done")]
    assert plan(spark, events, ["a", "b", "c"], skipped=["b"]) == [("a", "skip", "done"), ("c", "skip", "done")]
    assert [x[1:] for x in plan(spark, events, ["a", "b", "c"], force=True)] == [("run", "forced")] * 3
    assert plan(spark, events, ["a", "d"], ids=["new"]) == [("a", "run", "never ran"), ("d", "run", "never ran")]


def test_events_of_one_frame_keep_their_order(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.append(spark.createDataFrame([("r", "a", "running", None), ("r", "a", "done", None)], runs.EVENTS).coalesce(1), log)
    assert sinks.latest_status(spark.read.parquet(log)).first().status == "done"
    sinks.append(spark.createDataFrame([("r", "a", "error", None, 7), ("r", "a", "done", None, 3)], runs.EVENTS + ", seq long"), log)
    assert sinks.latest_status(spark.read.parquet(log)).first().status == "error"


def test_a_chain_goes_on_where_it_stopped(spark, tmp_path):
    log, ran = str(tmp_path / "log"), []
    ids = spark.createDataFrame([(f"r{i}",) for i in range(4)], "run_id string")
    sick = {"triage": {"r1"}, "qc": {"r2"}}

    def stage(name):
        def work(due):
            own = {r.run_id for r in due.collect()}
            ran.append((name, own))
            return spark.createDataFrame(
                [(x, "bad") for x in own & sick.get(name, set())], "run_id string, error string"
            ) if name in sick else None

        return work

    stages = {n: stage(n) for n in ("ingest", "triage", "select", "qc")}
    runs.run_chain(spark, ids, stages, log)
    assert ran == [
        ("ingest", {"r0", "r1", "r2", "r3"}),
        ("triage", {"r0", "r1", "r2", "r3"}),
        ("select", {"r0", "r2", "r3"}),
        ("qc", {"r0", "r2", "r3"})
    ]
    ran.clear(), sick["triage"].clear(), sick["qc"].clear()
    runs.run_chain(spark, ids, stages, log)
    assert ran == [("triage", {"r1"}), ("select", {"r1"}), ("qc", {"r1", "r2"})]
    ran.clear()
    assert runs.run_chain(spark, ids, stages, log).where("action = 'run'").isEmpty() and ran == []
    stages["select"] = lambda due: 1 / 0
    with pytest.raises(ZeroDivisionError):
        runs.run_chain(spark, ids, stages, log, force=True)
    status = {(r.run_id, r.stage): r.status for r in sinks.latest_status(spark.read.parquet(log)).collect()}
    assert status["r0", "select"] == "error" and status["r0", "triage"] == "done"


# --- panels over several batches ---------------------------------------------------------------------------------


def test_a_panel_in_several_files_is_one_series(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    start = datetime(2024, 5, 1, 12)
    panels = spark.createDataFrame(
        [("r", "p1", 0.0, 10.0, 10), ("r", "p2", 100.0, 400.0, 5), ("r", "end", 0.0, 1.0, 1)],
        "run_id string, panel string, x0 double, x1 double, n int"
    )
    points = [
        ("p1", i, 0.5 * i, 100.0 + i, i % 7) for i in range(15)
    ] + [("p1", 99, 3.0, 5.0, 3)] + [("p2", i, 100.0 + 50 * i, 1.0 * i, 2) for i in range(8)]
    rows = [
        {"run_id": "r", "panel": p, "ord": o, "x": x, "y": y, "at": (start + timedelta(minutes=m)).isoformat()} for p, o, x, y, m in points
    ]
    late = rows[::3]
    files = [rows[1::3], rows[2::3], late]

    def land(name, rows):
        (src / name).write_text("\n".join(map(json.dumps, rows)))

    def run():
        stream = landing.landing_points(spark, str(src), landing.TRACED)
        landing.append_series(landing.panel_series(stream, panels, "10 minutes", "5 minutes"), out, ck).awaitTermination(180)

    for k, own in enumerate(files):
        land(f"{k}.json", own)
        run()  # each from the checkpoint of the last
    assert spark.read.schema("panel string").parquet(out).count() == 0
    land("8.json", [{"run_id": "r", "panel": "end", "ord": 0, "x": 0.5, "y": 0.0, "at": (start + timedelta(minutes=60)).isoformat()}])
    run()
    run()
    land("9.json", [rows[0]])  # far too late: nothing changes
    run()
    got = spark.read.parquet(out)
    batch = spark.read.schema(landing.TRACED).json([str(src / f"{k}.json") for k in range(3)]).join(panels, ["run_id", "panel"])
    want = resample.last_per_slice(batch, ["run_id", "panel"], F.col("x0"), F.col("x1"), F.col("n"))
    for panel, n in (("p1", 10), ("p2", 5)):
        dense = resample.densify(want.where(F.col("panel") == panel), ["run_id", "panel"], n).select("slice", "x_key", "x", "y", "flagged")
        assert sorted(
            map(tuple, got.where(F.col("panel") == panel).select("slice", "x_key", "x", "y", "flagged").collect())
        ) == sorted(map(tuple, dense.collect()))
    assert got.count() == 15
