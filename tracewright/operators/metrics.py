"""Accuracy of digitised series against ground truth, and summaries of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def align(pred: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of p and t on equal keys; rows with a missing key or value on either side go."""
    known = lambda df, v: df.where(
        F.expr(" AND ".join(f"{c} IS NOT NULL" for c in on))
    ).withColumn(v, _finite(v)).where(F.col(v).isNotNull())
    return known(pred, "p").join(known(truth, "t"), on)


def pearson(p: str = "p", t: str = "t") -> Column:
    """0 where a side is constant or there are fewer than two pairs."""
    return F.coalesce(F.try_divide(F.covar_pop(p, t), F.nullif(F.stddev_pop(p) * F.stddev_pop(t), F.lit(0.0))), F.lit(0.0))


def aligned_metrics(pairs: DataFrame, by: list[str], order: list[str], alpha: float = 0.4, beta: float = 0.4) -> DataFrame:
    """n, rmse, mae, maxae, pearson_r and the peak-aware score of each group of pairs (p, t).

    The score weighs correlation, how close the maxima are, and how far apart they stand in the order of rows (first
    maxima count; distance by rows, not by dates).
    """
    at = pairs.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    d = F.col("p") - F.col("t")
    first = lambda v: F.min_by("_i", F.struct((-F.col(v)).alias("v"), "_i"))
    out = at.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(
            F.avg(d * d)
        ).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("maxae"), pearson().alias("pearson_r"),
        F.max("t").alias("max_t"), F.max("p").alias("max_p"), F.abs(first("t") - first("p")).alias("peak_offset"),
    )
    s_val = F.coalesce(1.0 - F.try_divide(F.abs(F.col("max_t") - F.col("max_p")), F.nullif("max_t", F.lit(0.0))), F.lit(0.0))
    s_time = F.greatest(F.lit(0.0), 1.0 - F.col("peak_offset") / F.col("n"))
    out = out.withColumn("s_peak_val", s_val).withColumn("s_peak_time", s_time)
    return out.withColumn(
        "peak_score", alpha * F.col("pearson_r") + beta * F.col("s_peak_val") + (1.0 - alpha - beta) * F.col("s_peak_time")
    ).drop("max_t", "max_p")


def scale_ratio(pairs: DataFrame, by: list[str], least: float = 1e-6) -> DataFrame:
    """The median of truth over prediction where the prediction is not about zero: shows a wrong unit."""
    return pairs.where(F.abs("p") > least).groupBy(*by).agg(F.median(F.col("t") / F.col("p")).alias("ratio"))


def best_rows(rows: DataFrame, by: list[str], mark: Column, order: list[Column]) -> DataFrame:
    """One row of each group: the marked one, else the last by the order given."""
    w = Window.partitionBy(*by).orderBy(mark.desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summarize(rows: DataFrame, by: list[str]) -> DataFrame:
    """Boxes found and their edge errors of each run: the two ways in which the errors' medians are reported.

    rows: by, detected, iou, left_err, right_err. pooled: median of both edges' absolute errors together; worse: the larger
    of the two edges' medians.
    """
    edges = rows.select(
        *by,
        "detected",
        "iou",
        "left_err",
        "right_err",
        F.explode(
            F.array(
                F.struct(F.lit("l").alias("side"), F.abs("left_err").alias("e")),
                F.struct(F.lit("r").alias("side"), F.abs("right_err").alias("e"))
            )
        ).alias("x")
    )
    one = F.col("x.side") == "l"
    return edges.groupBy(*by).agg(
        F.count_if(one).alias("n"), F.count_if(one & F.col("detected")).alias("n_detected"), F.avg(
            F.when(one, F.col("iou"))
        ).alias("mean_iou"), F.median("x.e").alias("pooled_median"),
        F.greatest(F.median(F.when(one, F.col("x.e"))), F.median(F.when(~one, F.col("x.e")))).alias("worse_median"),
    )


def _range_of(key: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds the key reaches, by halving."""
    if not bounds:
        return F.lit(0)
    held, n = F.array(*bounds), len(bounds)
    widths = [1 << k for k in reversed(range(n.bit_length()))]

    def step(low: Column, width: Column) -> Column:
        at = low + width
        return F.when((at <= n) & (key >= F.get(held, at - 1)), at).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def global_rank(rows: DataFrame, order: list[str], parts: int | None = None, per_range: int = 500_000, most: int = 4096) -> DataFrame:
    """rows with place, from 1: a rank over all rows without one task for all.

    Rows fall into ranges, one for each `per_range` of them (`most` at most, or as many as `parts` says). A few keys, those
    with the least hashes, bound the ranges and are constants of the plan; a row's place is its place in its range, after
    all rows of the ranges before it. order: columns without nulls that tell rows apart. rows is read three times.
    """
    parts = parts or min(most, max(8, -(-rows.count() // per_range)))
    bounds = sorted(tuple(x) for x in rows.select(*order).distinct().orderBy(F.xxhash64(*order)).limit(parts - 1).collect())
    kinds = [rows.schema[c].dataType for c in order]
    constants = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, order, strict=True))) for b in bounds]
    ranged = rows.withColumn("_range", _range_of(F.struct(*order), constants))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.withColumn("_own", own).join(F.broadcast(before), "_range")  # a row for each range
    return placed.withColumn("place", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
