from datetime import date

import pytest
from pyspark.sql import functions as F

from tracewright.functions import dates, text, units
from tracewright.functions import geometry as g


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def box(x, y, w, h):
    return g.box(*(F.lit(v) for v in (x, y, w, h)))


def test_boxes(spark):
    L = F.lit
    assert tuple(one(spark, g.box_from_norm(L(100.0), L(200.0), L(600.0), L(1000.0), L(2000), L(1000)))) == (200, 200, 1000, 800)
    assert tuple(one(spark, g.box_from_norm(L(600.0), L(1000.0), L(100.0), L(200.0), L(2000), L(1000)))) == (200, 200, 1000, 800)
    assert tuple(one(spark, g.box_from_norm(L(500.0), L(1000.0), L(500.0), L(1000.0), L(100), L(100)))) == (50, 90, 10, 10)
    assert tuple(one(spark, g.box_from_norm(L(-50.0), L(-5.0), L(2000.0), L(5000.0), L(100), L(100)))) == (0, 0, 100, 100)
    assert one(spark, g.iou(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(50 / 150)
    assert one(spark, g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert tuple(one(spark, g.clamp_plot(box(0, 0, 2, 2), box(10, 10, 100, 100)))) == (10, 10, 100, 100)
    assert tuple(one(spark, g.crop_box(box(10, 10, 100, 100), L(105).cast("long"), L(500).cast("long")))) == (0, 0, 105, 122)


@pytest.mark.parametrize("degrees,want", [(0, 0), (-90, 270), (91, 90), (359, 0), (225, 180), (135, 180)])
def test_rotation(spark, degrees, want):
    assert one(spark, g.rotation(F.lit(degrees))) == want


@pytest.mark.parametrize(
    "raw,name,mm",
    [
        ("mm", "mm", 1.0),
        ("Millimeter", "mm", 1.0),
        ("cm.", "cm", 10.0),
        ("Meter", "m", 1000.0),
        ("bayer. Fuß", "bavarian_foot", 291.859),
        ("Schuh", "bavarian_foot", 291.859),
        ("Zoll", "bavarian_zoll", 291.859 / 12),
        ("Klafter", "Klafter", None),
        ("", "unknown", None),
        (None, "unknown", None)
    ]
)
def test_units(spark, raw, name, mm):
    c = units.canonical(F.lit(raw).cast("string"))
    assert one(spark, c) == name
    assert one(spark, units.factor(c)) == (None if mm is None else pytest.approx(mm))


def test_unit_switch(spark):
    assert one(spark, units.by_date(F.lit(date(1872, 3, 31)))) == "bavarian_foot"
    assert one(spark, units.by_date(F.lit(date(1872, 4, 1)))) == "mm"
    assert one(spark, units.in_force(F.lit("Zoll"), F.lit("1849-01-01"))) == "bavarian_zoll"
    assert one(spark, units.in_force(F.lit("Pegel"), F.lit("1849-01-01"))) == "bavarian_foot"
    assert one(spark, units.in_force(F.lit("Pegel"), F.lit("17"))) == "Pegel"


@pytest.mark.parametrize(
    "label,year,want",
    [
        ("1849-07-03", None, date(1849, 7, 3)),
        ("1849-02-30", None, None),
        ("Juli 1849", None, date(1849, 7, 1)),
        ("3. Juli", 1850, date(1850, 7, 3)),
        ("3. Juli", None, None),
        ("12 Sept. 1871", None, date(1871, 9, 12)),
        ("31. Feb. 1849", None, None),
        ("", 1849, None),
        ("Jänner 1850", None, date(1850, 1, 1)),
        ("ju 1849", None, None)
    ]
)
def test_dates(spark, label, year, want):
    assert one(spark, dates.parse_label(F.lit(label), F.lit(year).cast("int"))) == want


def test_label_month(spark):
    assert one(spark, dates.label_month(F.lit("Pegel Passau\nmärz\nMai"))) == 3
    assert one(spark, dates.label_month(F.lit("nothing"))) is None


def test_text(spark):
    assert one(spark, text.lenient_number(F.lit("34,5 Zoll"))) == 34.5
    assert one(spark, text.lenient_number(F.lit("none"))) is None
    assert one(spark, text.slug(F.lit("--a b/c--"))) == "a-b-c"
    assert one(spark, text.slug(F.lit("///"))) == "run"
    assert one(spark, text.month_list(F.lit("1-3,6,2"))) == [1, 2, 3, 6]
    assert [
        tuple(x) for x in one(spark, text.gauge_months(F.lit("210018:1839:1-2+6, 290022:1844:6")))
    ] == [("210018", 1839, 1), ("210018", 1839, 2), ("210018", 1839, 6), ("290022", 1844, 6)]
    assert one(spark, text.clean_json(F.lit('Sure:\n```json\n{"a": [1]}\n```'))) == '{"a": [1]}'
    assert one(spark, text.clean_json(F.lit('it is [1, 2]'))) == "[1, 2]"
    names = ["M10", "m2", "M1", "a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["a", "M1", "m2", "M10"]


def test_small_geometry_and_keys(spark):
    assert [one(spark, g.point_to_px(F.lit(v), F.lit(200))) for v in (500.0, 1200.0, -3.0)] == [100.0, 200.0, 0.0]
    assert one(spark, F.array(*g.centre_edges(F.lit(0.5), F.lit(0.2), F.lit(1000.0)))) == pytest.approx([400, 600])
    assert (one(spark, text.tile_key(F.lit("p03_s2"))), one(spark, text.gauge_id(F.lit("210018")))) == ("p03", "DE_BY_DAN_21")
