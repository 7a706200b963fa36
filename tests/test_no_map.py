"""Panels from which no map onto levels can be made, against the query's SQL."""

import math

from tracewright.plans import registry


def test_panels_without_a_map_are_as_in_sql(spark, tmp_path):
    import duckdb

    rows = [
        (1, "a b c", "src1", 5), (2, "a b c d", "src1", 9), (3, "a", "src1", 3),  # a map
        (4, "a b", "src2", 5), (5, "a b c d", "src2", 9), (6, "b a", "src2", 3),  # both anchors on one pixel
        (7, "a b", "src3", 7), (8, "a b c d", "src3", 9), (9, "a", "src3", 7),  # a flat axis: grid values are all alike
        (10, "a b", "src4", 7),  # one tick
        (11, None, "src5", 7),  # no pixel
        (12, None, "src6", 7), (13, "a b", "src6", 5), (14, "a b c", "src6", 9), (15, "a", "src6", 2),  # the first has none
    ]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(registry.oracle_sql()["level_affine"])
    told = lambda row: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)
    got = registry.queries()["level_affine"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(told, got)) == sorted(map(told, want.fetchall()))
    assert {r.panel: r.at_100 for r in got}["src2"] is None and {r.panel: r.at_100 for r in got}["src1"] is not None
