"""Structured Streaming around the batch operators: points that land as files become series, flags become an appended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators import resample

POINTS = "run_id string, panel string, ord long, x double, y double"


def landing_points(spark: SparkSession, path: str, schema: str = POINTS) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def to_series(points: DataFrame, out: str, checkpoint: str, x0: float, x1: float, n: int, flags: str | None = None) -> StreamingQuery:
    """Each batch's panels, resampled by the batch operator, below epoch=... folders; a panel's points arrive in one file, hence one batch.

    A batch that is run again after a failure overwrites its own folder, so nothing is doubled.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        sampled = resample.last_per_slice(batch, ["run_id", "panel"], F.lit(x0), F.lit(x1), F.lit(n))
        series = resample.densify(sampled, ["run_id", "panel"], n)
        series.persist()
        series.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if flags:
            gaps = series.groupBy("run_id", "panel").agg(F.count_if("flagged").alias("gaps")).where("gaps > 0")
            told = gaps.select(
                F.lit("series").alias("stage"),
                "run_id",
                F.col("panel").alias("ref"),
                F.concat(F.col("gaps").cast("string"), F.lit(" empty slices")).alias("reason"),
                F.lit("info").alias("severity")
            )
            told.write.mode("overwrite").parquet(f"{flags}/epoch={epoch}")
        series.unpersist()

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_coverage(points: DataFrame, x0: float, x1: float, n: int) -> DataFrame:
    """Coverage of each panel as points come in (complete output): distinct slices so far, in one stateful aggregate."""
    sliced = points.withColumn("slice", resample.slice_of(F.col("x"), F.lit(x0), F.lit(x1), F.lit(n))).where("slice IS NOT NULL")
    return sliced.groupBy("run_id", "panel").agg((F.size(F.collect_set("slice")) / n).alias("coverage"))


TRACED = POINTS + ", at timestamp"


def panel_series(points: DataFrame, panels: DataFrame, delay: str = "10 minutes", pause: str = "5 minutes") -> DataFrame:
    """run_id, panel, slice, x_key, x, y, flagged: each panel's densified series, once, when its points have stopped coming.

    points: a stream of run_id, panel, ord, x, y and at, when the point was traced; a panel's points may come in any number
    of files and batches, in any order. panels: a table of run_id, panel, x0, x1, n (its own extent and slices). A panel is
    over `pause` after its last point; its series is appended once the newest point of the stream is `delay` further.
    Until then points may come late; later ones are left out, as Spark's watermark has it. A point that came twice counts
    once. A panel whose points pause for longer has two series: choose `pause` accordingly. State is a panel's points.
    """
    known = panels.select("run_id", "panel", "x0", "x1", "n")
    sliced = points.withWatermark("at", delay).join(known, ["run_id", "panel"])
    sliced = sliced.withColumn("slice", resample.slice_of(F.col("x"), F.col("x0"), F.col("x1"), F.col("n"))).where("slice IS NOT NULL")
    own = F.collect_list(F.struct("slice", "x", "ord", "y"))
    panel = sliced.groupBy(F.session_window("at", pause), "run_id", "panel", "n").agg(own.alias("points"))
    each = panel.select("run_id", "panel", "points", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
    last = F.array_max(F.filter("points", lambda p: p["slice"] == F.col("slice")))
    each = each.withColumn("p", last)
    return each.select(
        "run_id", "panel", "slice", (F.col("slice") + 1).cast("string").alias("x_key"), "p.x", "p.y", F.col("p").isNull().alias("flagged")
    )


def append_series(series: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Series to Parquet files, each row once, however often the query is started from its checkpoint."""
    return series.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
