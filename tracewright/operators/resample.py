"""Polylines to series: last point in each slice, coverage, densified series with gaps, interpolation along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(x: Column, x0: Column, x1: Column, n: Column) -> Column:
    """0 to n - 1; the right edge belongs to the last slice. Null outside of the extent."""
    at = F.floor((x - x0) / (x1 - x0) * n).cast("int")
    return F.when((x >= x0) & (x <= x1) & (x1 > x0), F.least(F.greatest(at, F.lit(0)), n.cast("int") - 1))


def last_per_slice(points: DataFrame, by: list[str], x0: Column, x1: Column, n: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each slice's point with the greatest x, of equal ones the latest (ord); carry: further columns of that point."""
    sliced = points.withColumn("slice", slice_of(F.col("x"), x0, x1, n)).where(F.col("slice").isNotNull())
    picked = F.max_by(F.struct("x", "y", "ord", *carry), F.struct("x", "ord"))
    return sliced.groupBy(*by, "slice").agg(picked.alias("p")).select(*by, "slice", "p.*")


def coverage(sampled: DataFrame, by: list[str], n: Column) -> DataFrame:
    """The share of slices that hold a point."""
    return sampled.groupBy(*by).agg((F.count("*") / n).alias("coverage"))


def s_alpha(confidence: Column, cover: Column, alpha: float = 0.69) -> Column:
    return (1.0 - alpha) * confidence + alpha * cover


def scored(sampled: DataFrame, by: list[str], n: Column, alpha: float, viable: float) -> DataFrame:
    """by, coverage, confidence, s_alpha and viable of sampled curves (last_per_slice with their confidence)."""
    out = sampled.groupBy(*by).agg((F.count("*") / n).alias("coverage"), F.max("confidence").alias("confidence"))
    return out.withColumn(
        "s_alpha", s_alpha(F.col("confidence"), F.col("coverage"), alpha)
    ).withColumn("viable", F.col("coverage") >= viable)


def densify(series: DataFrame, by: list[str], n: int, start: Column | None = None) -> DataFrame:
    """Every slice of every series, with `flagged` where no point fell, and its key: a date from `start` on, or 1 to n."""
    keys = series.select(*by).distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = keys.join(series, [*by, "slice"], "left").withColumn("flagged", F.col("x").isNull())
    return out.withColumn("x_key", (F.date_add(start, F.col("slice")) if start is not None else F.col("slice") + 1).cast("string"))


def interpolate(queries: DataFrame, knots: DataFrame, by: list[str]) -> DataFrame:
    """queries (by, x, ...) with base: the knots' (by, x, y) polyline at x, its end values beyond its ends.

    One sort instead of a range join: both sides are laid along x, and each query takes the last knot before it and the
    first one after it.
    """
    rest = [c for c in queries.columns if c not in by and c != "x"]
    lone = knots.groupBy(*by, "x").agg(F.max("y").alias("y"))
    one = lone.select(
        *by,
        F.col("x").cast("double").alias("x"),
        F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("knot"),
        F.lit(None).cast(queries.select(F.struct(*rest)).schema[0].dataType).alias("q"),
        F.lit(0).alias("kind")
    )
    two = queries.select(
        *by,
        F.col("x").cast("double").alias("x"),
        F.lit(None).cast("struct<x:double,y:double>").alias("knot"),
        F.struct(*rest).alias("q"),
        F.lit(1).alias("kind")
    )
    w = Window.partitionBy(*by).orderBy("x", "kind")
    before = F.last("knot", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The next knot is the last one when the order is turned round: a frame that only grows is computed in one pass.
    back = Window.partitionBy(*by).orderBy(F.desc("x"), F.desc("kind"))
    after = F.last("knot", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    laid = one.unionByName(two).withColumn("a", before).withColumn("b", after).where("kind = 1")
    share = F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    base = F.when(F.col("a").isNull(), F.col("b.y")).when(
        F.col("b").isNull() | (F.col("b.x") == F.col("a.x")) | (F.col("x") == F.col("a.x")), F.col("a.y")
    ).otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * share)
    return laid.select(*by, "x", "q.*", base.alias("base"))


def correct(y: Column, base: Column, beta: Column) -> Column:
    """A curve's y without the sag of the printed baseline against its ideal row."""
    return y - (base - beta)


def linspace(lo: Column | float, hi: Column | float, k: Column) -> Column:
    """k evenly spaced numbers from lo to hi, both included; one number is lo."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    step = F.coalesce(F.try_divide(hi - lo, k - 1), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when((i == k - 1) & (k > 1), hi).otherwise(i * step + lo))


def probe_places(n_samples: Column, most: int = 40, lo: int = 10, hi: int = 990) -> Column:
    """Where a tracer is asked to read a curve: as many places as it has samples, `most` at most (all if unknown), cut to whole numbers."""
    k = F.least(F.coalesce(F.nullif(n_samples, F.lit(0)), F.lit(most)), F.lit(most))
    return F.transform(linspace(lo, hi, k), lambda x: x.cast("int"))


def probes(points: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, probes: `most` points (ord, x, y) of each trace, spread evenly over their places in order; all of a shorter one."""
    own = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    n = F.size("p")
    places = linspace(0, (n - 1).cast("double"), F.least(n, F.lit(most)))
    return own.select(*by, F.transform(places, lambda i: F.get("p", i.cast("int"))).alias("probes"))
