"""Reports of many runs at once: every section gives lines (run_id, section, place, line), and each run's lines are one text.

Nothing is collected on the driver and nothing is cut off: a report is as long as its run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import general

# The sections in their order, with their titles and heads.
SECTIONS = ("head", "panels", "calibration", "extraction", "series", "flags")
HEADS = {
    "panels": ("Panels", ("panel", "label", "bbox (x,y,w,h)", "conf", "flags")),
    "calibration": ("Calibration", ("panel", "unit", "scale", "slope (unit/px)", "r2", "ticks used", "flags")),
    "extraction": ("Extraction", ("panel", "candidates", "selected", "conf", "coverage", "s_alpha", "method")),
    "series": ("Series", ()),
    "flags": ("Review flags", ("severity", "stage", "panel", "reason")),
}


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _fixed(c: str, digits: int, missing: str = "-") -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))).otherwise(missing)


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _lines(rows: DataFrame, section: str, place: Column, line: Column) -> DataFrame:
    return rows.select("run_id", F.lit(SECTIONS.index(section)).alias("section"), place.cast("string").alias("place"), line.alias("line"))


def _joined(flags: str) -> Column:
    return F.array_join(F.coalesce(flags, F.array().cast("array<string>")), ", ")


def head_lines(runs: DataFrame) -> DataFrame:
    """runs: run_id, profile, version, input, width, height."""
    picture = F.concat(
        F.lit("- input: `"), "input", F.lit("` ("), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(")")
    )
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("# Run report: "), "run_id"),
            F.lit(""),
            F.concat(F.lit("- profile: **"), _text("profile"), F.lit("**")),
            F.concat(F.lit("- version: "), _text("version")),
            picture
        )
    )
    return _lines(runs, "head", F.lit(""), F.array_join(parts, "\n"))


def panel_lines(panels: DataFrame) -> DataFrame:
    """panels: run_id, panel, label, box, confidence, flags."""
    box = F.concat_ws(",", *(F.col(f"box.{c}").cast("string") for c in "xywh"))
    return _lines(panels, "panels", F.col("panel"), _row(F.col("panel"), _text("label"), box, _fixed("confidence", 2), _joined("flags")))


def calibration_lines(axes: DataFrame) -> DataFrame:
    """axes: run_id, panel, unit, scale, slope, r2, n_used, n_ticks, flags; a panel without a fit has dashes."""
    fitted = F.col("slope").isNotNull()
    used = F.when(fitted, F.concat(F.col("n_used").cast("string"), F.lit("/"), F.col("n_ticks").cast("string"))).otherwise("-")
    slope, r2 = F.coalesce(general(F.col("slope"), 5), F.lit("-")), F.when(fitted, _fixed("r2", 4)).otherwise("-")
    return _lines(
        axes, "calibration", F.col("panel"), _row(F.col("panel"), _text("unit"), _text("scale"), slope, r2, used, _joined("flags"))
    )


def extraction_lines(tiles: DataFrame) -> DataFrame:
    """tiles: run_id, panel, error, n_candidates, and a row for each selected series (label, cand, confidence, coverage, s_alpha, method; cand null: none)."""
    name = F.trim(F.concat(F.col("panel"), F.lit(" "), _text("label")))
    n, blank = _text("n_candidates"), [F.lit("")] * 4
    failed, none = F.coalesce(F.col("error"), F.lit("")) != "", F.col("cand").isNull()
    whole = _row(name, n, _text("cand"), *(_fixed(c, 3, "0.000") for c in ("confidence", "coverage", "s_alpha")), _text("method"))
    line = F.when(
        failed, _row(F.col("panel"), F.concat(F.lit("ERROR: "), "error"), F.lit(""), *blank)
    ).when(none, _row(F.col("panel"), n, F.lit("none"), *blank)).otherwise(whole)
    return _lines(tiles, "extraction", F.concat_ws(" ", "panel", _text("series")), line)


def series_lines(series: DataFrame) -> DataFrame:
    """series: run_id, key, panel ('annual' for stitched years, which come first), label, path, n, n_gaps, baseline_applied, chain (a map), verdict, reason."""
    annual = F.col("panel") == "annual"
    label = F.when(_text("label") != "", F.concat(F.lit(" **"), "label", F.lit("**"))).otherwise("")
    count = F.concat(
        F.col("n").cast("string"), F.when(annual, " days, ").otherwise(" samples, "), F.col("n_gaps").cast("string"), F.lit(" gaps")
    )
    count = F.when(annual, count).otherwise(
        F.concat(count, F.lit(", baseline "), F.when(F.coalesce("baseline_applied", F.lit(False)), "applied").otherwise("off"))
    )
    first = F.concat(F.lit("-"), label, F.lit(" csv: `"), _text("path"), F.lit("` ("), count, F.lit(")"))
    links = F.transform(
        F.array_sort(F.map_entries("chain")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"].cast("double")))
    )
    chain = F.when(
        F.size(F.coalesce("chain", F.create_map().cast("map<string,double>"))) > 0,
        F.concat(F.lit("  - confidence chain: "), F.array_join(links, ", "))
    )
    judged = F.when(F.col("verdict").isNotNull(), F.concat(F.lit("  - QC: **"), "verdict", F.lit("** "), _text("reason")))
    lines = F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("### "), F.when(annual, "Annual series").otherwise(F.col("panel"))),
                first,
                F.when(~annual, chain),
                F.when(~annual, judged)
            )
        ),
        "\n"
    )
    return _lines(series, "series", F.concat(F.when(annual, "0 ").otherwise("1 "), F.col("panel"), F.lit(" "), F.col("key")), lines)


def flag_lines(flags: DataFrame) -> DataFrame:
    """flags: run_id, severity, stage, ref, reason; blocking ones first."""
    order = F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return _lines(
        flags,
        "flags",
        F.concat_ws(" ", order.cast("string"), "stage", _text("ref"), "reason"),
        _row(F.col("severity"), F.col("stage"), _text("ref"), F.col("reason"))
    )


def reports(*sections: DataFrame) -> DataFrame:
    """run_id, report: each run's lines as one markdown text, sections that have lines under their heads."""
    lines = reduce(DataFrame.unionByName, sections)
    own = lines.groupBy("run_id", "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    head = F.lit("")
    for name, (title, columns) in HEADS.items():
        table = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n" if columns else ""
        head = F.when(F.col("section") == SECTIONS.index(name), f"## {title}\n\n{table}").otherwise(head)
    text = own.select("run_id", "section", F.concat(head, body, F.lit("\n")).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n")
    return text.groupBy("run_id").agg(whole.alias("report"))


def write(found: DataFrame, path: str) -> None:
    """Each run's report as a text file below run_id=..."""
    found.select("run_id", F.col("report").alias("value")).write.partitionBy("run_id").mode("overwrite").text(path)
