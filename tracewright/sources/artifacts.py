"""JSON artifacts, hints, annotations, CSV frames and bundles of results as DataFrames. All inputs of a kind are one job."""

from __future__ import annotations

import io
import zipfile
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.operators.raster import grayscale


def read_artifact(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents of one kind, a row each, with `path`; unknown fields are ignored, defaults filled in."""
    df = spark.read.schema(schemas.ARTIFACTS[kind]).option("multiLine", True).json(path)
    out = df.withColumn("path", F.col("_metadata.file_path"))
    for name, value in schemas.DEFAULTS.items():
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def _unknown(raw: Column, where: str) -> Column:
    return F.array_except(
        F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*map(F.lit, schemas.HINT_KEYS[where]))
    )


def parse_hints(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw with `hints` and `unknown`, the keys that hints may not have, at any depth. read_hints() refuses such rows."""
    text = F.col(column)
    parts = lambda path: F.coalesce(
        F.from_json(F.get_json_object(text, path), "array<string>"), F.array().cast("array<string>")
    )
    anchors = F.concat(
        parts("$.y_anchors"),
        F.flatten(
            F.transform(
                parts("$.panels"),
                lambda p: F.coalesce(F.from_json(F.get_json_object(p, "$.y_anchors"), "array<string>"), F.array().cast("array<string>"))
            )
        )
    )
    nested = lambda xs, where: F.flatten(F.transform(xs, lambda x: _unknown(x, where)))
    unknown = F.array_distinct(F.concat(_unknown(text, "$"), nested(parts("$.panels"), "panels"), nested(anchors, "y_anchors")))
    return raw.withColumn("unknown", unknown).withColumn("hints", F.from_json(text, schemas.HINTS))


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """One row of hints for each file; an unknown key or broken JSON is an error."""
    rows = parse_hints(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")))
    bad = (F.size("unknown") > 0) | F.json_object_keys("value").isNull()
    checked = F.when(
        bad, F.raise_error(F.concat(F.lit("hints that are not allowed in "), "path", F.lit(": "), F.array_join("unknown", ", ")))
    ).otherwise(F.col("hints"))
    return rows.select("path", checked.alias("hints")).select("path", "hints.*")


def read_month_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages (scan_id, low_value, high_value, width, height) and month boxes (scan_id, month, cx, cy, w, h) of annotation files."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file")).where("line <> ''")
    scan = F.coalesce(F.nullif(F.regexp_extract("file", "_(\\d+)\\.tif", 1), F.lit("")), F.regexp_replace("file", "\\.[^.]*$", ""))
    lines = lines.withColumn("scan_id", scan)
    head = lines.where(F.col("line").startswith("#") & F.col("line").contains(":"))
    head = head.select(
        "scan_id",
        F.upper(F.trim(F.regexp_extract("line", "^#+([^:]*):", 1))).alias("key"),
        F.trim(F.regexp_extract("line", "^#+[^:]*:(.*)$", 1)).alias("value")
    )
    size = F.split(F.max(F.when(F.col("key") == "IMAGE_SIZE", F.col("value"))), "\\s+")
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).try_cast("double")
    pages = head.groupBy("scan_id").agg(
        one("LOW_VALUE").alias("low_value"),
        one("HIGH_VALUE").alias("high_value"),
        F.get(size, F.lit(0)).cast("int").alias("width"),
        F.get(size, F.lit(1)).cast("int").alias("height")
    )
    f = F.split("line", "\\s+")
    boxes = lines.where(~F.col("line").startswith("#")).select(
        "scan_id", f[0].cast("int").alias("month"), *(f[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h")))
    )
    return pages, boxes


def anchor_rows(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """scan_id, c_low, c_high: the bottom and top edge in pixels of January's box, which stand for the low and high value."""
    jan = boxes.where("month = 1").join(pages, "scan_id")
    return jan.select(
        "scan_id",
        ((F.col("cy") + F.col("h") / 2) * F.col("height")).alias("c_low"),
        ((F.col("cy") - F.col("h") / 2) * F.col("height")).alias("c_high"),
        "low_value",
        "high_value"
    )


def read_baseline_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, i, x, y: the points of each file's first line of data (a class, then x and y in turn)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("lines"))
    first = F.get(F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0))
    v = F.transform(F.slice(F.split(first, "\\s+"), F.lit(2), F.size(F.split(first, "\\s+"))), lambda x: x.cast("double"))
    rows = whole.withColumn("v", v).where(F.size("v") >= 2)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1),
        lambda i: F.struct(F.get(F.col("v"), 2 * i).alias("x"), F.get(F.col("v"), 2 * i + 1).alias("y"))
    )
    return rows.select("file", F.posexplode(pairs).alias("i", "p")).select("file", "i", "p.*")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """C_X, C_Y, DATE, GAUGELEVEL; the header's two dates differ in case alone, so columns are named by position."""
    df = spark.read.schema(schemas.GROUND_TRUTH_CSV).option("header", True).option("enforceSchema", True).csv(path)
    return df.select("C_X", "C_Y", F.to_date("DATE_").alias("DATE"), "GAUGELEVEL")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """DATE and GAUGELEVEL of ground truth, days without a level left out."""
    return read_ground_truth(spark, path).where("GAUGELEVEL IS NOT NULL").select("DATE", "GAUGELEVEL")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """stem, month and box of the truth files beside inputs (<stem>.truth.json: a list of months with their boxes)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.truth\\.json$", 1).alias("stem"), "value"
    )
    rows = raw.where("stem <> ''").select(
        "stem", F.explode(F.from_json("value", "struct<months:array<struct<month:int,box:array<bigint>>>>")["months"]).alias("m")
    )
    corner = lambda i: F.get(F.col("m.box"), F.lit(i))
    return rows.select("stem", "m.month", F.struct(*(corner(i).alias(c) for i, c in enumerate("xywh"))).alias("box"))


def read_observations(spark: SparkSession, path: str, gauge: str | None = None, year: int | None = None) -> DataFrame:
    df = spark.read.schema(schemas.OBSERVATIONS_CSV).option("header", True).csv(path)
    df = df.where(F.col("gauge_id") == gauge) if gauge else df
    return df.where((F.col("date") >= date(year, 1, 1)) & (F.col("date") < date(year + 1, 1, 1))) if year else df


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """gauge_id and name; further columns are not read."""
    return spark.read.schema(schemas.GAUGES_CSV).option("header", True).csv(path).withColumnRenamed("gauge_name", "name")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Published results by scan and month; the scan is the location's number and the file's, four digits at least."""
    df = spark.read.schema(schemas.EVALUATION_CSV).option("header", True).option("enforceSchema", True).csv(path)
    number = F.col("file_id").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return df.withColumn("scan_id", F.concat(F.regexp_extract("location", "_(\\d+)$", 1), padded))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Digitised series of any number of runs, with the run and key of their paths, and the key's date where it is one."""
    df = spark.read.schema(schemas.SERIES_CSV).option("header", True).csv(path).withColumn("path", F.col("_metadata.file_path"))
    df = df.withColumn(
        "series_key", F.regexp_extract("path", "series_?([^/]*)\\.csv$", 1)
    ).withColumn("scan_id", F.regexp_extract("path", "(\\d{6})_tif_M(\\d{2})", 1))
    return df.withColumn(
        "month", F.regexp_extract("path", "(\\d{6})_tif_M(\\d{2})", 2).try_cast("int")
    ).withColumn("date", F.try_to_date("x_key", "yyyy-MM-dd"))


def unit_of(series: DataFrame, by: list[str]) -> DataFrame:
    """by, unit: the first unit that a series names, along its keys; null without one."""
    named = F.coalesce(F.trim("native_unit"), F.lit("")) != ""
    return series.groupBy(*by).agg(F.min(F.when(named, F.struct("x_key", "native_unit")))["native_unit"].alias("unit"))


def discover_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, scan_id, month of all run folders (those with a manifest) below a folder whose names tell scan and month."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(path).select(
        F.regexp_extract("path", "^(.*)/manifest\\.json$", 1).alias("run")
    )
    name = lambda i: F.regexp_extract("run", "(\\d{6})_tif_M(\\d{2})", i)
    return found.select("run", name(1).alias("scan_id"), name(2).try_cast("int").alias("month")).where("scan_id <> ''")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """tile, cand, confidence, pts of sidecar files ([{confidence, points}]); a candidate's number is its place."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)\\.", 1).alias("tile"), "value"
    )
    lines = raw.select(
        "tile", F.posexplode(F.from_json("value", "array<struct<confidence:double,points:array<array<double>>>>")).alias("cand", "c")
    )
    pts = F.transform("c.points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return lines.select(
        "tile", F.col("cand").cast("long").alias("cand"), F.coalesce("c.confidence", F.lit(1.0)).alias("confidence"), pts.alias("pts")
    )


def with_missing(tiles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of the given tiles; a tile whose sidecar file is not there has one row with an error."""
    return tiles.select("tile").join(candidates, "tile", "left").withColumn(
        "error", F.when(F.col("cand").isNull(), F.lit("no candidates file"))
    )


def read_result_bundles(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """tile, error, cand, confidence, pts of results.json in zip bundles; a bundle of another run is an error, and a tile has an error or candidates."""

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out.append((name, z.read("results.json").decode()))
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in out], "value": [x[1] for x in out]})

    kind = "run_id string, tiles map<string,struct<error:string,candidates:array<struct<cand_id:bigint,confidence:double,points_px_tile:array<array<double>>>>>>"
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        run, "path string, value string"
    ).withColumn("r", F.from_json("value", kind))
    if run_id is not None:
        raw = raw.withColumn(
            "r",
            F.when(
                ~F.col("r.run_id").eqNullSafe(F.lit(run_id)),
                F.raise_error(F.concat(F.lit("results of another run: "), F.coalesce("r.run_id", F.lit("?"))))
            ).otherwise(F.col("r"))
        )
    tiles = raw.select(F.explode("r.tiles").alias("tile", "t"))
    rows = tiles.select(
        "tile",
        F.col("t.error").alias("error"),
        F.posexplode_outer(F.when(F.col("t.error").isNull(), F.col("t.candidates"))).alias("i", "c")
    )
    pts = F.transform("c.points_px_tile", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select(
        "tile",
        "error",
        F.coalesce("c.cand_id", F.col("i").cast("long")).alias("cand"),
        F.coalesce("c.confidence", F.lit(1.0)).alias("confidence"),
        pts.alias("pts")
    )


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """path, sha256, content of all images below a folder: a run for each. Other files are not opened."""
    either = lambda x: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.{" + ",".join(map(either, suffixes)) + "}"
    ).load(path)
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.col("length"), "content")


def cached_responses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Model responses that the cache has, and what is missing from it."""
    return wanted.join(cache, key), wanted.join(cache.select(*key), key, "left_anti")


def read_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pixels (tile, row, col, gray) of images that Spark decodes, and files that it does not (tile, error).

    tile is the file's name without its ending. Colours become gray by their luma. Bytes are told apart by their place in
    hexadecimal digits of a row, so nothing leaves the JVM and no array is as long as an image.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    name = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), "\\.[^.]*$", "")
    known = F.col("nChannels").isin(1, 3, 4) & (F.col("width") > 0)
    rows = images.where(known).select(
        name.alias("tile"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row")
    )
    n = F.col("width") * F.col("nChannels")
    rows = rows.select("tile", "row", "width", "nChannels", F.hex(F.substring("data", F.col("row") * n + 1, n)).alias("digits"))
    cols = rows.select("tile", "row", "nChannels", "digits", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    at = lambda k: F.conv(
        F.substring("digits", 2 * (F.col("col") * F.col("nChannels") + k) + 1, F.lit(2)), 16, 10
    ).cast("int")
    gray = F.when(F.col("nChannels") == 1, at(0)).otherwise(grayscale(at(2), at(1), at(0)))  # blue, green, red
    bad = images.where(~known).select(
        name.alias("tile"), F.concat(F.lit("no image that can be decoded: "), F.element_at(F.split("origin", "/"), -1)).alias("error")
    )
    return cols.select("tile", "row", "col", gray.alias("gray")), bad
