"""Results to files: series CSV, run status and review flags as appended tables, bundles, and small markdown reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Columns of a series file, and the digits of its numbers.
COLUMNS = ("x_key", "value_native", "native_unit", "value_mm", "pixel_x_page", "pixel_y_page", "pixel_y_corrected", "flagged")
DIGITS = {"value_native": 4, "value_mm": 2, "pixel_x_page": 1, "pixel_y_page": 1, "pixel_y_corrected": 1}


def _fixed(c: str, digits: int) -> Column:
    """Fixed digits, half to even on the decimal value; empty for null."""
    return F.coalesce(F.bround(F.col(c), digits).cast(f"decimal(38,{digits})").cast("string"), F.lit(""))


def series_csv(series: DataFrame, path: str, by: list[str]) -> None:
    """Digitised series as CSV below by=... folders; numbers are formatted here and nowhere before."""
    out = series.select(
        *by,
        "x_key",
        *(_fixed(c, n).alias(c) for c, n in DIGITS.items()),
        F.coalesce("native_unit", F.lit("")).alias("native_unit"),
        "flagged"
    )
    out.select(*by, *COLUMNS).repartition(*by).sortWithinPartitions(*by, "x_key").write.partitionBy(*by).option("header", True).option(
        "emptyValue", ""
    ).mode("overwrite").csv(path)


def append(rows: DataFrame, path: str) -> None:
    """Status events or review flags: rows are added, none is changed, so no lock is needed.

    `at` is when, `seq` the place among rows that were added together: as given, else the order of the frame.
    """
    seq = F.col("seq").cast("long") if "seq" in rows.columns else F.monotonically_increasing_id()
    rows.withColumn("seq", seq).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_status(events: DataFrame) -> DataFrame:
    """run_id, stage and its last status by at and seq; of events alike in both the one with the greatest status and error."""
    order = F.struct("at", *(["seq"] if "seq" in events.columns else []), "status", "error")
    return events.groupBy("run_id", "stage").agg(F.max_by(F.struct("status", "error"), order).alias("s")).select("run_id", "stage", "s.*")


def write_artifact(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def bundle(tiles: DataFrame, path: str, by: str = "run_id") -> None:
    """Tiles with their bytes for an extractor elsewhere: a partitioned table is the bundle."""
    tiles.write.mode("overwrite").partitionBy(by).parquet(path)


def pivot_table(rows: DataFrame, index: str, columns: str, value: Column, values: list[str]) -> DataFrame:
    """A row for each index, a column for each of the given values: first value, ERR where the row has an error."""
    cell = F.first(F.when(F.col("error") != "", F.lit("ERR")).otherwise(F.coalesce(value.cast("string"), F.lit(""))), ignorenulls=True)
    return rows.groupBy(index).pivot(columns, values).agg(cell).orderBy(index)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report table of the first rows, in the order of the frame; how many more there are is told. Whole reports: sources.reports."""
    rows = df.limit(most + 1).collect()
    left = df.count() - most if len(rows) > most else 0
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return head + "".join("| " + " | ".join(map(cell, r)) + " |\n" for r in rows[:most]) + (f"\n... and {left} more rows\n" if left else "")


def run_report(series: DataFrame, fits: DataFrame, flags: DataFrame, most: int = 200) -> str:
    """Markdown of a run: its panels' fits, its series with gaps, its flags by severity."""
    gaps = series.groupBy("panel").agg(
        F.count("*").alias("n"),
        F.count_if("flagged").alias("gaps"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("x_key")))), 1, 5), ", ").alias("first_gaps")
    )
    order = F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    listed = flags.withColumn(
        "_n", F.row_number().over(Window.partitionBy("severity").orderBy("stage", "ref"))
    ).where(F.col("_n") <= most).orderBy(order, "stage", "ref").drop("_n")
    return "\n".join(
        [
            markdown(fits.orderBy("panel"), "Axis fits", most),
            markdown(gaps.orderBy("panel"), "Series", most),
            markdown(listed, "Review flags", most)
        ]
    )


def annual_csv(rows: DataFrame, path: str, by: list[str]) -> None:
    """Stitched years (of series.stitch: by, x_key, value, panel_ord) as CSV below by=... folders."""
    out = rows.select(*by, "x_key", _fixed("value", 4).alias("value_native"), "panel_ord")
    out.repartition(*by).sortWithinPartitions(*by, "x_key").write.partitionBy(*by).option("header", True).mode("overwrite").csv(path)


# What an evaluation report says of each summary, by column.
SENTENCES = {
    "calibration": (
        "- months evaluated: {n} ({n_usable} usable)",
        "- median slope error: {median_slope_err_pct:.2f} %",
        "- median zero-pixel error: {median_zero_px_err:.1f} px",
        "- median induced series error (MAE): {median_induced_mae:.2f} mm",
        "- worst induced MAE: {worst_induced_mae:.2f} mm"
    ),
    "panels": ("- panels detected: {n_detected}/{n}", "- mean IoU: {mean_iou:.3f}", "- median |x-edge error|: {worse_median:.2f} days"),
    "series": (
        "- gauge-months evaluated: {n}",
        "- mean peak-aware score: {mean_peak_score:.3f}",
        "- published best-candidate mean on the same months: {mean_paper_peak_score:.3f}",
        "- mean Pearson r: {mean_pearson_r:.3f}",
        "- mean RMSE: {mean_rmse:.2f}",
        "- mean largest error: {mean_maxae:.2f}"
    ),
}


def _said(row: dict, name: str) -> list[str]:
    """The sentences whose figures a summary has."""
    out = []
    for sentence in SENTENCES[name]:
        fields = re.findall(r"\{(\w+)", sentence)
        if all(row.get(f) is not None for f in fields):
            out.append(sentence.format(**row))
    return out


def evaluation_report(calibration: DataFrame, panels: DataFrame, series: DataFrame, path: str, most: int = 200) -> str:
    """The three evaluations' summaries (small tables, a row a run) as CSV below path, and as one markdown report.

    Each run's results are sentences, then all are one table; of more than `most` runs the report tells how many it leaves
    out, the CSV files have all.
    """
    parts = {
        "Calibration against human anchors": ("calibration", calibration),
        "Panels found": ("panels", panels),
        "Series against ground truth": ("series", series)
    }
    out = []
    for title, (name, df) in parts.items():
        df.write.option("header", True).mode("overwrite").csv(f"{path}/{name}")
        key = df.columns[0]
        ordered = df.orderBy(key)
        told = [
            f"{key} {row[key]}:\n" + "\n".join(lines) + "\n" for row in (
                r.asDict() for r in ordered.limit(most).collect()
            ) if (lines := _said(row, name))
        ]
        out.append(markdown(ordered, title, most) + "".join(f"\n{t}" for t in told))
    return "\n".join(out)


def pseudo_page(tiles: DataFrame, page: list[str]) -> DataFrame:
    """page, hints, truth: the JSON beside each pseudo page. tiles: page, month, x, y, w, h, page_w, page_h (of months.layout), unit."""
    boxes = F.array_sort(F.collect_list(F.struct("month", F.array("x", "y", "w", "h").alias("box"))))
    hints = F.struct(
        F.first("unit").alias("unit"),
        F.count("*").cast("int").alias("expected_panels"),
        F.lit("row").alias("panel_layout"),
        F.transform(boxes, lambda m: F.struct(m["month"].alias("index"), m["month"].alias("month"))).alias("panels")
    )
    return tiles.groupBy(*page).agg(F.to_json(hints).alias("hints"), F.to_json(F.struct(boxes.alias("months"))).alias("truth"))
