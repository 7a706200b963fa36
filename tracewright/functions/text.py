"""Labels, slugs, sort keys, list specifications and fenced JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.columns import let

# A printed number.
NUMBER = "-?\\d+(?:[.,]\\d+)?"


def lenient_number(label: Column) -> Column:
    """The first number in a label, with a comma or a point."""
    return F.replace(F.regexp_extract(label, f"({NUMBER})", 1), F.lit(","), F.lit(".")).try_cast("double")


def slug(name: Column, most: int = 40) -> Column:
    cut = F.left(F.trim(F.regexp_replace(name, "[^A-Za-z0-9_-]+", "-"), F.lit("-")), F.lit(most))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("run"))


def natural_key(name: Column) -> Column:
    """Sorts as the name does with its runs of digits taken as numbers: each run without leading zeros, after its length."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("(\\d+|[^\\d]+)"), F.lit(1))
    number = lambda p: F.ltrim(p, F.lit("0"))
    return F.array_join(
        F.transform(
            parts, lambda p: F.when(p.rlike("^\\d+$"), F.concat(F.lpad(F.length(number(p)).cast("string"), 9, "0"), number(p))).otherwise(p)
        ),
        ""
    )


def month_list(spec: Column) -> Column:
    """'1-3,6' to the sorted distinct months."""
    return F.array_sort(F.array_distinct(_ranges(F.split(spec, ","))))


def _ranges(parts: Column) -> Column:
    number = lambda x, i: F.try_element_at(F.split(F.trim(x), "-"), F.lit(i)).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.sequence(number(p, 1), F.coalesce(number(p, 2), number(p, 1)))))


def gauge_months(spec: Column) -> Column:
    """'210018:1839:1-3+6,...' to (scan, year, month) entries, in their order, repeats kept."""
    part = lambda p, i: F.element_at(F.split(F.trim(p), ":"), i)
    one = lambda p: F.transform(
        _ranges(F.split(part(p, 3), "\\+")),
        lambda m: F.struct(part(p, 1).alias("scan"), part(p, 2).cast("int").alias("year"), m.alias("month"))
    )
    return F.flatten(F.transform(F.split(spec, ","), one))


def clean_json(text: Column) -> Column:
    """The JSON of a model's answer: out of its code fence, from the first brace or bracket on."""
    fence = "(?s)```(?:json)?\\s*(.*?)\\s*```"
    bare = F.trim(text, F.lit(" \n\r\t"))
    inner = F.when(bare.rlike(fence), F.regexp_extract(bare, fence, 1)).otherwise(bare)
    first = F.greatest(F.least(*(F.nullif(F.instr(inner, c), F.lit(0)) for c in "{[")), F.lit(1))
    return inner.substr(F.coalesce(first, F.lit(1)), F.length(inner))


def tile_key(series_key: Column) -> Column:
    return F.split_part(series_key, F.lit("_s"), F.lit(1))


def gauge_id(scan: Column) -> Column:
    return F.concat(F.lit("DE_BY_DAN_"), F.substring(scan, 1, 2))


def general(v: Column, digits: int) -> Column:
    """A number with so many significant digits, without trailing zeros; very large and very small ones with an exponent (as %g in C)."""
    v = v.cast("double")
    parts = F.struct(
        F.regexp_replace(
            F.regexp_extract(F.format_string(f"%.{digits - 1}e", F.abs(v)), "^(.*)e", 1), "\\.", ""
        ).alias("d"), F.regexp_extract(F.format_string(f"%.{digits - 1}e", F.abs(v)), "e(.*)$", 1).cast("int").alias("x")
    )
    short = lambda s: F.regexp_replace(F.regexp_replace(s, "(\\.\\d*?)0+$", "$1"), "\\.$", "")

    def shown(p: Column) -> Column:
        d, x = p["d"], p["x"]
        above = F.concat(F.substring(d, F.lit(1), x + 1), F.lit("."), F.substring(d, x + 2, F.lit(digits)))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), d)
        power = F.concat(
            short(F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, 2, digits))),
            F.when(x < 0, "e-").otherwise("e+"),
            F.when(F.abs(x) < 10, "0").otherwise(""),
            F.abs(x).cast("string")
        )
        return F.when((x < -4) | (x >= digits), power).when(x >= 0, short(above)).otherwise(short(below))

    return F.when(v == 0, "0").when(v.isNotNull(), F.concat(F.when(v < 0, "-").otherwise(""), let(parts, shown)))
