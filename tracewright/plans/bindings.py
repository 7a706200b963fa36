"""Driver tables as chart inputs: candidates, polylines, ticks, aligned series, boxes, labels, rasters, month panels.

Charts are small and many: the number of tiles, panels and pages grows with the tables, what one of them holds does not.

Each function has its SQL beside it (a common table expression of the same columns), for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.geometry import box

SLICES, EXTENT = 30, 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: tile (15 users), cand, ord, x (days since 2024-01-01), y, confidence: a candidate polyline for each user."""
    e = table(spark, sf_dir, "events")
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400000000.0)
    return e.select(
        (F.col("user_id") % 10 + F.floor(F.col("user_id") / 150) * 10).alias("tile"),
        F.col("user_id").alias("cand"),
        F.col("event_id").alias("ord"),
        x.alias("x"),
        F.col("value").alias("y"),
        ((F.col("user_id") * 37 % 100) / 100.0).alias("confidence")
    )


POINTS = """pt AS (SELECT user_id % 10 + user_id // 150 * 10 AS tile, user_id AS cand, event_id AS ord, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS x, value AS y, (user_id * 37 % 100) / 100.0::DOUBLE AS confidence FROM events)"""


def _label_tile() -> Column:
    return F.col("label").cast("long") + F.floor(F.col("vec_id") / 500) * 10


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: tile (label, 50 vectors), cand (vector), ord = x, y: 64 points each."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_label_tile().alias("tile"), F.col("vec_id").alias("cand"), F.posexplode("embedding").alias("ord", "v")).select(
        "tile", "cand", "ord", F.col("ord").cast("double").alias("x"), (F.col("v").cast("double") * 1000).alias("y")
    )


CURVES = """cv AS (SELECT label::BIGINT + vec_id // 500 * 10 AS tile, vec_id AS cand, i - 1 AS ord, (i - 1)::DOUBLE AS x, embedding[i]::DOUBLE * 1000 AS y FROM embeddings, unnest(range(1, 65)) AS r(i))"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: panel (source, 50 documents), ord (document), pixel (spaces), value (characters)."""
    d = table(spark, sf_dir, "documents")
    panel = F.concat(
        F.substring("source", 1, 3), (F.substring("source", 4, 9).cast("long") + F.floor(F.col("doc_id") / 1000) * 20).cast("string")
    )
    return d.select(
        panel.alias("panel"),
        F.col("doc_id").alias("ord"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("double").alias("pixel"),
        F.col("n_chars").cast("double").alias("value")
    )


TICKS = """tk AS (SELECT left(source, 3) || (substr(source, 4)::BIGINT + doc_id // 1000 * 20) AS panel, doc_id AS ord, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS pixel, n_chars::DOUBLE AS value FROM documents)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: page (order), pos, conf, box.

    Rows are dealt out by `page` itself: windows over pages then need no second shuffle.
    """
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page")
    order = Window.partitionBy("page").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice"
    )
    b = box(F.col("l_partkey") % 200, F.col("l_suppkey"), F.col("l_quantity") + 50, F.col("l_quantity") + 40)
    return li.withColumn("pos", F.row_number().over(order)).select("page", "pos", F.col("l_discount").alias("conf"), b.alias("box"))


BOXES = """bx AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice) AS pos,
  l_discount AS conf, l_partkey % 200 AS x, l_suppkey AS y, (l_quantity + 50)::BIGINT AS w, (l_quantity + 40)::BIGINT AS h FROM lineitem)"""


def iou_sql(a: str, b: str) -> str:
    """Intersection over union of two boxes with columns x, y, w, h."""
    inter = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({inter}::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}))"


def pick(values: list[str], key: Column) -> Column:
    """One of the values by the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(values: list[str], key: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({key} % {len(values)} + 1)::INT]"


def daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B4: a predicted (orders) and a true (lineitem) value for each day."""
    pred = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("p"))
    truth = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.sum("l_extendedprice") / 100).alias("t"))
    return pred, truth


DAILY = """pd AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS p FROM orders GROUP BY 1), gt AS (SELECT l_shipdate::DATE AS day, sum(l_extendedprice) / 100 AS t FROM lineitem GROUP BY 1),
pr AS (SELECT day, date_trunc('month', day)::DATE AS mon, p, t FROM pd JOIN gt USING (day))"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: tile (label, 50 vectors), row (rank of the vector), col (index), gray."""
    e = table(spark, sf_dir, "embeddings")
    row = F.row_number().over(Window.partitionBy("tile").orderBy("vec_id")) - 1
    return e.withColumn("tile", _label_tile()).withColumn("row", row).select("tile", "row", F.posexplode("embedding").alias("col", "v")).select(
        "tile", "row", "col", (F.col("v").cast("double") * 100).alias("gray")
    )


RASTER = """rs AS (SELECT tile, rn AS "row", i - 1 AS col, embedding[i]::DOUBLE * 100 AS gray FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY vec_id) - 1 AS rn FROM (SELECT *, label::BIGINT + vec_id // 500 * 10 AS tile FROM embeddings)), unnest(range(1, 65)) AS r(i))"""


def month_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10: year, mon, first (day), days, n (orders), width: a panel for each month."""
    o = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("first")).agg(F.count("*").alias("n"))
    days = F.dayofmonth(F.last_day("first"))
    return o.select(
        F.year("first").alias("year"),
        F.month("first").alias("mon"),
        "first",
        days.alias("days"),
        "n",
        (days * 6 + F.col("n") % 11).cast("long").alias("width")
    )


MONTHS = """mp AS (SELECT year(f)::INT AS year, month(f)::INT AS mon, f AS first, day(last_day(f))::INT AS days, n, (day(last_day(f)) * 6 + n % 11)::BIGINT AS width FROM (SELECT date_trunc('month', o_orderdate)::DATE AS f, count(*) AS n FROM orders GROUP BY 1))"""
