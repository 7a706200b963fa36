"""What queries over many pages shuffle and sort: no more than the rows that they are given."""

import re

from pyspark.sql import functions as F

from tracewright.operators import boxes, checks, readings
from tracewright.plans import registry

DIR = "/root/testdata/sf0.001"


def plan_of(df):
    """The executed plan without broadcasts, which tables of size do not get."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def count_of(plan, node):
    return len(re.findall(rf"^[ :+-]*(?:\*\(\d+\) )?{node}\b", plan, re.M))


def test_panel_count_repair_shuffles_rows_once_and_no_columns_of_pixels(spark):
    plan = plan_of(registry.queries()["panel_count_repair"](spark, DIR))
    assert count_of(plan, "Exchange") == 1 and count_of(plan, "SortMergeJoin") == 0


def test_strengths_of_the_row_cut_as_a_table_of_them(spark):
    schema = "page int, pos int, box struct<x:bigint,y:bigint,w:bigint,h:bigint>, plot struct<x:bigint,y:bigint,w:bigint,h:bigint>, flags array<string>"
    sizes = [(100, 100, 300), (9, 20, 7), (60, 61, 400), (5, 5, 16), (50, 51, 52), (80,), (3, 3, 9), (100, 400, 400)]
    rows = [
        (page, pos, (13 * pos + page, 0, w, 9), (13 * pos, 1, w, 7), [])
        for page, own in enumerate(sizes)
        for pos, w in enumerate(own, 1)
    ]
    panels = spark.createDataFrame(rows, schema)
    for strength in (lambda c: (c * 37 + F.col("pos") * 11) % 5, lambda c: F.when(c % 3 == 0, c % 7), lambda c: F.lit(1)):
        table = panels.select("page", "pos", F.explode(F.sequence("box.x", F.col("box.x") + F.col("box.w"))).alias("col"))
        one, told = boxes.repair_count(panels, ["page"], F.lit(7), table.withColumn("s", strength(F.col("col"))))
        two, also = boxes.repair_count(panels, ["page"], F.lit(7), strength)
        assert one.columns == two.columns and sorted(one.collect()) == sorted(two.collect())
        assert two.count() > len(rows) and sorted(told.collect()) == sorted(also.collect())


def test_edge_tags_sort_rows_once(spark):
    plan = plan_of(registry.queries()["edge_tags"](spark, DIR))
    assert count_of(plan, "Exchange") == 1 and count_of(plan, "Sort") == 1


def test_edges_with_ties_and_without_places(spark):
    rows = [("a", "p2", 1.0), ("a", "p1", 1.0), ("a", "p3", 1.0), ("b", "p1", None), ("b", "p2", 4.0), ("b", "p3", 2.0), ("c", "p1", 3.0)]
    got = checks.edge_tags(spark.createDataFrame(rows, "page string, panel string, x double"), ["page"]).collect()
    assert {(r.page, r.panel): r.edge for r in got if r.edge} == {
        ("a", "p1"): "left", ("a", "p3"): "right", ("b", "p1"): "left", ("b", "p2"): "right"
    } and len(got) == 7


def test_reading_cascade_shuffles_no_attempts(spark):
    plan = plan_of(registry.queries()["reading_cascade"](spark, DIR))
    assert count_of(plan, "Exchange") == 1 and count_of(plan, "SortMergeJoin") == 0 and "collect_list" not in plan


def test_attempts_of_the_row_are_read_as_a_table_of_them(spark):
    tick = "struct<side:string,pixel:double,value:double,legible:boolean>"
    fields = f"kind:string,ord:int,failed:boolean,unit:string,scale:string,confidence:double,x_kind:string,x_start:string,x_end:string,ticks:array<{tick}>"
    kinds, rows = [*readings.KINDS, "other"], []
    for n in range(60):
        own = [
            (kinds[(n * 7 + i) % 5], 3 - i, None if (n + i) % 6 == 0 else (n + i) % 4 == 0, ["", "mm", None][(n + i) % 3], [None, "log"][i % 2], [0.5, None, 0.25][(n * i) % 3], "date", None, f"e{i}",
             [("left", float(j), float(j), [None, True, False][(n + j) % 3]) for j in range((n + i) % 3)])
            for i in range(n % 6)
        ]
        rows.append((f"g{n // 4}", f"p{n % 4}", [None, 1.0 * (n % 3)][n % 5 > 0], [None, True, False][n % 3], n % 2 == 0, "linear", own if n % 11 else None))
    given = spark.createDataFrame(
        rows,
        f"page string, panel string, x double, axis_labels boolean, curve_labels boolean, scale_guess string, attempts array<struct<{fields}>>"
    )
    table = given.select("page", "panel", F.inline("attempts"))
    one, two = readings.cascade(given.drop("attempts"), table), readings.cascade(given)
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert len({r.used for r in two.collect()}) > 3
