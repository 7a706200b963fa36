"""Queries over the driver tables, one for each operator, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.config import GENERIC, Gates
from tracewright.functions import dates, text, units
from tracewright.functions import geometry as g
from tracewright.operators import boxes as bx
from tracewright.operators import candidates as cd
from tracewright.operators import fit, metrics, months, raster, resample
from tracewright.operators import series as sr
from tracewright.plans import bindings as b

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def flat(c: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{c}.{k}").alias(prefix + k) for k in "xywh"]


# --- geometry --------------------------------------------------------------------------------------------------


@query(f"""WITH {b.BOXES}, e AS (SELECT page, pos, x * 5.37 AS x0, y * 3.1 AS y0, x * 5.37 + w - 75 AS x1, y * 3.1 + h * 4 AS y1 FROM bx),
s AS (SELECT page, pos, greatest(0, round_even(least(x0, x1) / 1000.0 * 2000, 0)::BIGINT) AS xl, least(2000, round_even(greatest(x0, x1) / 1000.0 * 2000, 0)::BIGINT) AS xh,
  greatest(0, round_even(least(y0, y1) / 1000.0 * 1500, 0)::BIGINT) AS yl, least(1500, round_even(greatest(y0, y1) / 1000.0 * 1500, 0)::BIGINT) AS yh FROM e),
m AS (SELECT page, pos, CASE WHEN xh - xl < 20 THEN least(2000, xl + 20) ELSE xh END AS xe, CASE WHEN yh - yl < 20 THEN least(1500, yl + 20) ELSE yh END AS ye, xl, yl, xh, yh FROM s)
SELECT page, pos, CASE WHEN xh - xl < 20 THEN greatest(0, xe - 20) ELSE xl END AS x, CASE WHEN yh - yl < 20 THEN greatest(0, ye - 20) ELSE yl END AS y,
  xe - CASE WHEN xh - xl < 20 THEN greatest(0, xe - 20) ELSE xl END AS w, ye - CASE WHEN yh - yl < 20 THEN greatest(0, ye - 20) ELSE yl END AS h FROM m""")
def norm_box_to_px(spark: SparkSession, d: str) -> DataFrame:
    q = b.boxes(spark, d)
    x0, y0 = F.col("box.x") * 5.37, F.col("box.y") * 3.1
    out = g.box_from_norm(x0, y0, x0 + F.col("box.w") - 75, y0 + F.col("box.h") * 4, F.lit(2000), F.lit(1500), 20)
    return q.select("page", "pos", out.alias("b")).select("page", "pos", *flat("b"))


@query(
    f"WITH {b.BOXES} SELECT a.page, a.pos AS pos_a, c.pos AS pos_b, round({b.iou_sql('a', 'c')}, 12) AS iou FROM bx a JOIN bx c ON a.page = c.page AND a.pos < c.pos"
)
def box_iou_pairs(spark, d):
    q = b.boxes(spark, d)
    one, two = q.select(
        "page", F.col("pos").alias("pos_a"), F.col("box").alias("a")
    ), q.select("page", F.col("pos").alias("pos_b"), F.col("box").alias("c"))
    return one.join(two, "page").where("pos_a < pos_b").select("page", "pos_a", "pos_b", r(g.iou(F.col("a"), F.col("c")), 12).alias("iou"))


@query(f"""WITH {b.BOXES}, c AS (SELECT *, trunc(0.12 * w)::BIGINT AS mx, trunc(0.12 * h)::BIGINT AS my, trunc(0.05 * w)::BIGINT AS nx FROM bx),
p AS (SELECT *, least(greatest(x + 10, x), x + w - 1) AS px0, least(greatest(y - 5, y), y + h - 1) AS py0, x + 10 + w // 2 AS pr, y - 5 + (h * (pos % 3)) // 3 AS pb FROM c),
k AS (SELECT *, greatest(least(pr, x + w), px0 + 1) AS px1, greatest(least(pb, y + h), py0 + 1) AS py1 FROM p)
SELECT page, pos, greatest(0, x - mx) AS crop_x, greatest(0, y - my) AS crop_y, least(220, x + w + mx) - greatest(0, x - mx) AS crop_w, least(400, y + h + my) - greatest(0, y - my) AS crop_h,
  CASE WHEN pos = 1 THEN 0 ELSE greatest(0, x - nx) END AS edge_x, CASE WHEN pos = 1 THEN least(220, x + w + nx) ELSE 220 - greatest(0, x - nx) END AS edge_w,
  CASE WHEN (px1 - px0) * (py1 - py0) < 0.25 * w * h THEN x ELSE px0 END AS plot_x, CASE WHEN (px1 - px0) * (py1 - py0) < 0.25 * w * h THEN w ELSE px1 - px0 END AS plot_w,
  CASE WHEN (px1 - px0) * (py1 - py0) < 0.25 * w * h THEN h ELSE py1 - py0 END AS plot_h FROM k""")
def box_expand_clamp(spark, d):
    q = b.boxes(spark, d)
    w, h, own = F.lit(220).cast("long"), F.lit(400).cast("long"), F.col("box")
    half = lambda v, n: F.floor(v / n).cast("long")
    plot = g.box(own["x"] + 10, own["y"] - 5, half(own["w"], 2), half(own["h"] * (F.col("pos") % 3), 3))
    edge = g.margin_crop_box(own, w, h, F.when(F.col("pos") == 1, "left").otherwise("right"))
    out = q.select("page", "pos", g.crop_box(own, w, h).alias("c"), edge.alias("e"), g.clamp_plot(plot, own).alias("p"))
    return out.select(
        "page",
        "pos",
        *flat("c", "crop_"),
        F.col("e.x").alias("edge_x"),
        F.col("e.w").alias("edge_w"),
        F.col("p.x").alias("plot_x"),
        F.col("p.w").alias("plot_w"),
        F.col("p.h").alias("plot_h")
    )


@query(
    f"WITH {b.POINTS} SELECT ord, round((x - cand % 7) * 2, 6) AS tile_x, round((y - 3) * 1, 6) AS tile_y, round((x - cand % 7) * 2 / 2 + cand % 7, 6) AS page_x FROM pt"
)
def affine_roundtrip(spark, d):
    q = b.points(spark, d)
    crop = (F.col("cand") % 7).cast("double")
    x = g.page_to_tile(F.col("x"), crop, F.lit(2.0))
    return q.select(
        "ord",
        r(x).alias("tile_x"),
        r(g.page_to_tile(F.col("y"), F.lit(3.0), F.lit(1.0))).alias("tile_y"),
        r(g.tile_to_page(x, crop, F.lit(2.0))).alias("page_x")
    )


# --- labels ----------------------------------------------------------------------------------------------------

UNIT_LABELS = [
    "mm", "Millimeter", "cm.", "Meter", "m", "bayer. Fuß", "Pariser Fuss", "Schuh", "Zoll", " Klafter", "", "CM", "Zentimeter", "meters"
]
_UNIT_SQL = """CASE WHEN raw = '' THEN 'unknown' WHEN regexp_matches(trim(raw), '(?i)^m(illi)?m(eter)?s?\\.?$') THEN 'mm' WHEN regexp_matches(trim(raw), '(?i)^c(enti)?m(eter)?s?\\.?$') THEN 'cm'
  WHEN regexp_matches(trim(raw), '(?i)^m(eter)?s?\\.?$') THEN 'm' WHEN regexp_matches(trim(raw), '(?i)fu(ß|ss)') THEN 'bavarian_foot' WHEN regexp_matches(trim(raw), '(?i)schuh') THEN 'bavarian_foot'
  WHEN regexp_matches(trim(raw), '(?i)zoll') THEN 'bavarian_zoll' ELSE trim(raw) END"""
_FACTOR_SQL = "CASE unit WHEN 'mm' THEN 1.0 WHEN 'cm' THEN 10.0 WHEN 'm' THEN 1000.0 WHEN 'bavarian_foot' THEN 291.859 WHEN 'bavarian_zoll' THEN 291.859 / 12 END"


@query(
    f"WITH l AS (SELECT o_orderkey, o_totalprice, {b.pick_sql(UNIT_LABELS, 'o_orderkey')} AS raw FROM orders), u AS (SELECT *, {_UNIT_SQL} AS unit FROM l) SELECT o_orderkey, raw, unit, round(o_totalprice * ({_FACTOR_SQL})::DOUBLE, 2) AS mm FROM u"
)
def unit_canonicalize(spark, d):
    q = b.table(spark, d, "orders").withColumn(
        "raw", b.pick(UNIT_LABELS, F.col("o_orderkey"))
    ).withColumn("unit", units.canonical(F.col("raw")))
    return q.select("o_orderkey", "raw", "unit", r(units.to_mm(F.col("o_totalprice"), F.col("unit")), 2).alias("mm"))


@query(f"""WITH l AS (SELECT o_orderkey, o_orderdate::DATE AS day, {b.pick_sql(UNIT_LABELS, 'o_orderkey')} AS raw FROM orders), u AS (SELECT *, {_UNIT_SQL} AS unit FROM l)
SELECT o_orderkey, day, CASE WHEN unit IN ('mm', 'cm', 'm', 'bavarian_foot', 'bavarian_zoll') THEN unit WHEN day < DATE '1996-04-01' THEN 'bavarian_foot' ELSE 'mm' END AS unit FROM u""")
def unit_by_date(spark, d):
    q = b.table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), b.pick(UNIT_LABELS, F.col("o_orderkey")).alias("raw")
    )
    return q.select("o_orderkey", "day", units.in_force(F.col("raw"), F.col("day").cast("string"), True, date(1996, 4, 1)).alias("unit"))


DATE_LABELS = [
    "1849-07-03",
    "1849-02-30",
    "Juli 1849",
    "Jänner 1850",
    "3. Juli 1849",
    "3. Juli",
    "31. Feb. 1849",
    "12 Sept. 1871",
    "Okt 1844",
    "Xyz 1844",
    "17",
    "",
    "29. Februar 1852",
    "Mai 1839",
    "ma 1840",
    "1. December 1840",
    " März 1841 "
]
_MONTHS_SQL = "CASE " + " ".join(f"WHEN k = '{n}' THEN {m}" for n, m in dates.MONTHS) + " " + " ".join(
    f"WHEN length(k) >= 3 AND starts_with('{n}', k) THEN {m}" for n, m in dates.MONTHS
) + " END"


@query(rf"""WITH l AS (SELECT o_orderkey, {b.pick_sql(DATE_LABELS, 'o_orderkey')} AS label FROM orders),
x AS (SELECT *, trim(label) AS t, regexp_extract(trim(label), '^([A-Za-zäöüÄÖÜ]+\.?)\s+(\d{{4}})$', ['a', 'b']) AS my, regexp_extract(trim(label), '^(\d{{1,2}})\.?\s*([A-Za-zäöüÄÖÜ]+\.?)\s*(\d{{4}})?$', ['a', 'b', 'c']) AS dm FROM l),
m AS (SELECT *, (SELECT {_MONTHS_SQL} FROM (SELECT lower(regexp_replace(x.my.a, '\.+$', '')) AS k)) AS m1, (SELECT {_MONTHS_SQL} FROM (SELECT lower(regexp_replace(x.dm.b, '\.+$', '')) AS k)) AS m2 FROM x)
SELECT o_orderkey, label, CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_cast(t AS DATE) WHEN my.a <> '' AND m1 IS NOT NULL THEN make_date(try_cast(my.b AS INT), m1, 1)
  WHEN dm.a <> '' AND m2 IS NOT NULL THEN try_cast(printf('%04d-%02d-%02d', coalesce(try_cast(dm.c AS INT), 1900), m2, try_cast(dm.a AS INT)) AS DATE) END AS day FROM m""")
def date_label_parse(spark, d):
    q = b.table(spark, d, "orders").select("o_orderkey", b.pick(DATE_LABELS, F.col("o_orderkey")).alias("label"))
    return q.withColumn("day", dates.parse_label(F.col("label"), F.lit(1900)))


@query(f"WITH {b.MONTHS} SELECT year, mon, first, (first + INTERVAL (days - 1) DAY)::DATE AS last, days, n FROM mp")
def month_calendar(spark, d):
    return b.month_panels(spark, d).select(
        "year", "mon", "first", F.last_day("first").alias("last"), dates.days_in_month(F.col("first")).alias("days"), "n"
    )


NUMBER_LABELS = ["34,5 Zoll", '30"', "-7.25", "no number", "", "1.234,5", "x12y13", "- 4", "1e5", "+3"]


@query(
    rf"WITH l AS (SELECT o_orderkey, {b.pick_sql(NUMBER_LABELS, 'o_orderkey')} AS label FROM orders) SELECT o_orderkey, label, try_cast(replace(nullif(regexp_extract(label, '-?\d+(?:[.,]\d+)?'), ''), ',', '.') AS DOUBLE) AS number FROM l"
)
def lenient_float(spark, d):
    return b.table(spark, d, "orders").select(
        "o_orderkey", b.pick(NUMBER_LABELS, F.col("o_orderkey")).alias("label")
    ).withColumn("number", text.lenient_number(F.col("label")))


@query(
    "SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '-', 'g'), '-'), 40), ''), 'run') AS slug, sha256(coalesce(html, '')) AS sha256, md5(coalesce(html, '')) AS md5 FROM pages"
)
def slug_and_hash(spark, d):
    body = F.coalesce("html", F.lit("")).cast("binary")
    return b.table(spark, d, "pages").select(
        "page_id", text.slug(F.col("url")).alias("slug"), F.sha2(body, 256).alias("sha256"), F.md5(body).alias("md5")
    )


@query("""WITH k AS (SELECT c_custkey, c_name || '-' || (c_custkey * 7919 % 1000) || c_mktsegment || c_custkey % 13 AS name FROM customer)
SELECT c_custkey, name, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(name), '\\d+|[^\\d]+'), lambda p: CASE WHEN regexp_matches(p, '^\\d+$') THEN lpad(p, 20, '0') ELSE p END), ''), c_custkey) AS place FROM k""")
def natural_sort_rank(spark, d):
    c = b.table(spark, d, "customer")
    name = F.concat(
        "c_name", F.lit("-"), (F.col("c_custkey") * 7919 % 1000).cast("string"), "c_mktsegment", (F.col("c_custkey") % 13).cast("string")
    )
    q = c.select("c_custkey", name.alias("name")).withColumn("key", text.natural_key(F.col("name")))
    return metrics.global_rank(q, ["key", "c_custkey"]).select("c_custkey", "name", "place")


@query("""WITH s AS (SELECT r_regionkey, r_regionkey || '70405:18' || (51 + r_regionkey) || ':1-3+6,481516:1862:' || (r_regionkey + 1) || '+' || (r_regionkey + 1) AS spec FROM region),
p AS (SELECT r_regionkey, i AS part, string_split(string_split(spec, ',')[i], ':') AS f FROM s, unnest(range(1, 3)) AS r(i)),
c AS (SELECT r_regionkey, part, f, j, string_split(string_split(f[3], '+')[j], '-') AS ab FROM p, unnest(range(1, len(string_split(f[3], '+')) + 1)) AS r(j))
SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY part, j, m) - 1 AS at, f[1] AS scan, f[2]::INT AS year, m::INT AS mon FROM c, unnest(range(ab[1]::INT, coalesce(ab[2], ab[1])::INT + 1)) AS r(m)""")
def month_spec_expand(spark, d):
    k = F.col("r_regionkey")
    spec = F.concat(
        k.cast("string"),
        F.lit("70405:18"),
        (k + 51).cast("string"),
        F.lit(":1-3+6,481516:1862:"),
        (k + 1).cast("string"),
        F.lit("+"),
        (k + 1).cast("string")
    )
    q = b.table(spark, d, "region").select("r_regionkey", F.posexplode(text.gauge_months(spec)).alias("at", "m"))
    return q.select("r_regionkey", F.col("at").cast("long").alias("at"), "m.scan", "m.year", F.col("m.month").alias("mon"))


@query("SELECT event_id, props AS json, (props::JSON ->> 'k')::INT AS k FROM events")
def json_extract_clean(spark, d):
    e = b.table(spark, d, "events")
    told = F.when(
        F.col("event_id") % 3 == 0, F.concat(F.lit("Sure, here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    ).when(F.col("event_id") % 3 == 1, F.concat(F.lit("The answer: "), "props")).otherwise(F.col("props"))
    return e.select("event_id", text.clean_json(told).alias("json")).withColumn("k", F.from_json("json", "k int")["k"])


# --- axis fits -------------------------------------------------------------------------------------------------


@query(
    f"WITH {b.TICKS} SELECT panel, ord, pixel, value FROM (SELECT *, row_number() OVER (PARTITION BY panel, round_even(pixel / 10, 0), floor(value / 100) ORDER BY ord) AS n FROM tk) WHERE n = 1"
)
def dedupe_ticks(spark, d):
    q = b.ticks(spark, d).withColumns(
        {"exact": F.col("pixel"), "whole": F.col("value"), "pixel": F.col("pixel") / 10, "value": F.floor(F.col("value") / 100)}
    )
    return fit.dedupe_ticks(q, ["panel"]).select("panel", "ord", F.col("exact").alias("pixel"), F.col("whole").alias("value"))


@query(
    f"WITH {b.TICKS} SELECT panel, round(regr_slope(value, pixel), 6) AS slope, round(regr_intercept(value, pixel), 4) AS intercept, count(*) AS n_ticks FROM tk GROUP BY panel"
)
def ols_axis_fit(spark, d):
    return fit.ols(b.ticks(spark, d), ["panel"]).select(
        "panel", r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept"), "n_ticks"
    )


@query(f"""WITH {b.TICKS}, e AS (SELECT panel, arg_min(pixel, ord) AS c0, arg_min(value, ord) AS v0, arg_max(pixel, ord) AS c1, arg_max(value, ord) AS v1 FROM tk GROUP BY panel),
l AS (SELECT *, (v1 - v0) / nullif(c1 - c0, 0) AS slope FROM e), m AS (SELECT *, v0 - slope * c0 AS intercept FROM l)
SELECT panel, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(slope * 100 + intercept, 4) AS at_100, round((1000 - intercept) / nullif(slope, 0), 4) AS px_1000, round(c0 - v0 / nullif(v1 - v0, 0) * (c1 - c0), 4) AS zero_px FROM m""")
def two_anchor_map(spark, d):
    e = b.ticks(spark, d).groupBy("panel").agg(
        F.min(F.struct("ord", "pixel", "value")).alias("a"), F.max(F.struct("ord", "pixel", "value")).alias("z")
    )
    c0, v0, c1, v1 = F.col("a.pixel"), F.col("a.value"), F.col("z.pixel"), F.col("z.value")
    slope, intercept = fit.two_anchor(c0, v0, c1, v1)
    q = e.select("panel", slope.alias("slope"), intercept.alias("intercept"), r(fit.zero_pixel(c0, v0, c1, v1), 4).alias("zero_px"))
    s, i = F.col("slope"), F.col("intercept")
    return q.select(
        "panel",
        r(s).alias("slope"),
        r(i, 4).alias("intercept"),
        r(fit.value_at(s, i, F.lit(100.0)), 4).alias("at_100"),
        r(fit.pixel_at(s, i, F.lit(1000.0)), 4).alias("px_1000"),
        "zero_px"
    )


def _robust_sql(source: str, key: str, rounds: int = 5) -> str:
    """Chained rounds over a table (key, ord, pixel, value): k{rounds} has every tick with its last `keep`."""
    out = [f"k0 AS (SELECT {key}, ord, pixel, value, true AS keep, false AS done FROM {source})"]
    for i in range(rounds):
        out.append(f"""l{i} AS (SELECT {key}, regr_slope(value, pixel) AS s, regr_intercept(value, pixel) AS c FROM k{i} WHERE keep GROUP BY {key}),
q{i} AS (SELECT k.*, value - (s * pixel + c) AS res FROM k{i} k JOIN l{i} USING ({key})),
m{i} AS (SELECT {key}, median(res) AS med FROM q{i} WHERE keep GROUP BY {key}),
g{i} AS (SELECT {key}, 1.4826 * median(abs(res - med)) AS sigma FROM q{i} JOIN m{i} USING ({key}) WHERE keep GROUP BY {key}),
n{i} AS (SELECT q.*, sigma, abs(res - med) <= 3.5 * sigma AS fresh FROM q{i} q JOIN m{i} USING ({key}) JOIN g{i} USING ({key})),
h{i} AS (SELECT {key}, count(*) FILTER (WHERE fresh) AS n_fresh, bool_and(fresh = keep) AS same FROM n{i} GROUP BY {key}),
k{i + 1} AS (SELECT n.{key.replace(', ', ', n.')}, ord, pixel, value, CASE WHEN done OR sigma <= 0 OR n_fresh < 2 OR same THEN keep ELSE fresh END AS keep, done OR sigma <= 0 OR n_fresh < 2 OR same AS done FROM n{i} n JOIN h{i} USING ({key}))""")
    last = f"k{rounds}"
    out.append(f"""fl AS (SELECT {key}, regr_slope(value, pixel) AS slope, regr_intercept(value, pixel) AS intercept, avg(value) AS vm, count(*) AS n_used, max(value) - min(value) AS vrange FROM {last} WHERE keep GROUP BY {key}),
fs AS (SELECT {key}, sum(pow(value - (slope * pixel + intercept), 2)) FILTER (WHERE keep) AS ss_res, sum(pow(value - vm, 2)) FILTER (WHERE keep) AS ss_tot, count(*) AS n_ticks FROM {last} JOIN fl USING ({key}) GROUP BY {key}),
ft AS (SELECT {key}, slope, intercept, CASE WHEN ss_tot > 0 THEN 1 - ss_res / ss_tot WHEN ss_res = 0 THEN 1 ELSE 0 END AS r2, sqrt(ss_res / n_used) AS rmse, n_ticks, n_used, n_ticks - n_used AS n_rejected, vrange FROM fl JOIN fs USING ({key}))""")
    return ",\n".join(out)


def _fit_columns() -> list[Column]:
    return [
        r(F.col("slope")).alias("slope"),
        r(F.col("intercept"), 4).alias("intercept"),
        r(F.col("r2")).alias("r2"),
        r(F.col("rmse"), 4).alias("rmse"),
        F.col("n_ticks").cast("long").alias("n_ticks"),
        F.col("n_used").cast("long").alias("n_used"),
        F.col("n_rejected").cast("long").alias("n_rejected")
    ]


_FIT_SQL = "round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(rmse, 4) AS rmse, n_ticks, n_used, n_rejected"


@query(f"WITH {b.TICKS}, {_robust_sql('tk', 'panel')} SELECT panel, {_FIT_SQL} FROM ft")
def robust_axis_fit(spark, d):
    return fit.robust_fit(b.ticks(spark, d), ["panel"]).select("panel", *_fit_columns())


_SCALES = "sc AS (SELECT panel, 'linear' AS scale, ord, pixel, value FROM tk UNION ALL SELECT panel, 'log', ord, pixel, log10(value) FROM tk)"


@query(f"""WITH {b.TICKS}, {_SCALES}, {_robust_sql('sc', 'panel, scale')},
o AS (SELECT f.*, hash_pick AS declared, max(r2) FILTER (WHERE scale = CASE WHEN hash_pick = 'log' THEN 'log' ELSE 'linear' END) OVER (PARTITION BY panel) AS own FROM ft f JOIN (SELECT DISTINCT panel, CASE length(panel) % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'linear' ELSE 'unknown' END AS hash_pick FROM tk) USING (panel)),
p AS (SELECT *, scale <> CASE WHEN declared = 'log' THEN 'log' ELSE 'linear' END AS other, declared IN ('linear', 'log') AS known FROM o),
w AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY CASE WHEN other AND known AND r2 - own < 0.05 THEN -1 ELSE r2 END DESC, other) AS n FROM p)
SELECT panel, scale, declared, other AND known AS scale_auto, {_FIT_SQL} FROM w WHERE n = 1""")
def robust_fit_log(spark, d):
    declared = F.when(F.length("panel") % 3 == 0, "log").when(F.length("panel") % 3 == 1, "linear").otherwise("unknown")
    return fit.fit_both_scales(b.ticks(spark, d), ["panel"], declared).select("panel", "scale", "declared", "scale_auto", *_fit_columns())


@query(
    f"""WITH {b.TICKS}, {_robust_sql('tk', 'panel')} SELECT panel, array_to_string(list_filter([CASE WHEN r2 < 0.995 THEN printf('low_r2:%.4f', r2) END, CASE WHEN rmse / nullif(vrange, 0) > 0.02 THEN 'high_residual' END], lambda x: x IS NOT NULL), ',') AS flags, round(rmse / nullif(vrange, 0), 6) AS relative FROM ft"""
)
def axis_fit_gates(spark, d):
    q = fit.gate_flags(fit.robust_fit(b.ticks(spark, d), ["panel"]))
    return q.select(
        "panel", F.array_join("flags", ",").alias("flags"), r(F.try_divide("rmse", F.nullif("value_range", F.lit(0.0)))).alias("relative")
    )


@query(f"""WITH {b.TICKS}, sd AS (SELECT panel, ord, pixel, CASE WHEN ord // 20 % 2 = 0 THEN value * 1000 ELSE value END AS value, CASE ord // 20 % 5 WHEN 4 THEN 'unknown' ELSE CASE WHEN ord // 20 % 2 = 0 THEN 'right' ELSE 'left' END END AS tag FROM tk),
e AS (SELECT panel, s AS side, ord, pixel, value FROM sd, unnest(['left', 'right']) AS u(s) WHERE tag = s OR tag = 'unknown'), {_robust_sql('e', 'panel, side')},
w AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY round(r2 * least(1.0, n_used / 3.0), 12) DESC, side) AS n FROM ft) SELECT panel, side, {_FIT_SQL} FROM w WHERE n = 1""")
def dual_axis_pick(spark, d):
    even = F.floor(F.col("ord") / 20) % 2 == 0
    q = b.ticks(spark, d).withColumn("value", F.when(even, F.col("value") * 1000).otherwise(F.col("value")))
    q = q.withColumn("side", F.when(F.floor(F.col("ord") / 20) % 5 == 4, "unknown").when(even, "right").otherwise("left"))
    return fit.pick_side(q, ["panel"]).select("panel", "side", *_fit_columns())


@query(f"""WITH {b.TICKS}, {_robust_sql('tk', 'panel')}, p AS (SELECT *, substr(panel, 4)::INT // 5 AS page, substr(panel, 4)::INT % 5 <> 3 AS usable FROM ft),
o AS (SELECT *, arg_max(struct_pack(panel := panel, slope := slope, intercept := intercept), CASE WHEN usable THEN r2 * least(1.0, n_used / 3.0) END) OVER (PARTITION BY page) AS best FROM p)
SELECT page, panel, best.panel AS donor, NOT usable AS shared, usable AND panel <> best.panel AND abs(slope - best.slope) / abs(best.slope) > 0.03 AS inconsistent, round(CASE WHEN usable THEN slope ELSE best.slope END, 6) AS slope, round(CASE WHEN usable THEN intercept ELSE best.intercept END, 4) AS intercept FROM o""")
def donor_fit_share(spark, d):
    n = F.substring("panel", 4, 9).cast("int")
    q = fit.robust_fit(b.ticks(spark, d), ["panel"]).withColumn("page", F.floor(n / 5).cast("int")).withColumn("ok", n % 5 != 3)
    return fit.share_donor(q, ["page"], "panel", F.col("ok")).select(
        "page", "panel", "donor", "shared", "inconsistent", r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept")
    )


# --- resampling and candidates ---------------------------------------------------------------------------------

_LAST = f"""{b.POINTS}, sl AS (SELECT *, least(greatest(floor(x / 30.0 * 30)::INT, 0), 29) AS slice FROM pt WHERE x >= 0 AND x <= 30),
ls AS (SELECT tile, cand, slice, x, y, ord FROM (SELECT *, row_number() OVER (PARTITION BY tile, cand, slice ORDER BY x DESC, ord DESC) AS n FROM sl) WHERE n = 1)"""
_SCORED = f"""{_LAST}, cov AS (SELECT tile, cand, count(*) / 30.0::DOUBLE AS coverage FROM ls GROUP BY 1, 2), cf AS (SELECT tile, cand, max(confidence) AS confidence FROM pt GROUP BY 1, 2),
sc AS (SELECT tile, cand, confidence, coverage, 0.31 * confidence + 0.69 * coverage AS s_alpha, coverage >= 0.90 AS viable FROM cov JOIN cf USING (tile, cand))"""


def _last(spark, d):
    return resample.last_per_slice(b.points(spark, d), ["tile", "cand"], F.lit(0.0), F.lit(b.EXTENT), F.lit(b.SLICES), ("confidence",))


def _scored(spark, d):
    return resample.scored(_last(spark, d), ["tile", "cand"], F.lit(b.SLICES), GENERIC.alpha, GENERIC.viable_coverage)


@query(f"WITH {_LAST} SELECT tile, cand, slice, round(x, 6) AS x, round(y, 6) AS y, ord FROM ls")
def last_per_slice(spark, d):
    return _last(spark, d).select("tile", "cand", "slice", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "ord")


@query(
    f"WITH {_SCORED} SELECT tile, cand, round(coverage, 6) AS coverage, round(s_alpha, 6) AS s_alpha, viable, row_number() OVER (PARTITION BY tile ORDER BY round(s_alpha, 9) DESC, cand) AS rank FROM sc"
)
def coverage_scores(spark, d):
    q = _scored(spark, d).withColumn("s_alpha", r(F.col("s_alpha"), 9))
    return cd.rank(q, ["tile"]).select(
        "tile",
        "cand",
        r(F.col("coverage")).alias("coverage"),
        r(F.col("s_alpha")).alias("s_alpha"),
        "viable",
        F.col("rank").cast("long").alias("rank")
    )


@query(f"""WITH {_SCORED}, rk AS (SELECT tile, cand, round(s_alpha, 9) AS s, viable, row_number() OVER (PARTITION BY tile ORDER BY round(s_alpha, 9) DESC, cand) AS n FROM sc),
vi AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n) AS vn FROM rk WHERE viable),
t AS (SELECT tile, (SELECT cand FROM rk q WHERE q.tile = k.tile AND n = 1) AS best, (SELECT s FROM vi q WHERE q.tile = k.tile AND vn = 1) AS s1, (SELECT s FROM vi q WHERE q.tile = k.tile AND vn = 2) AS s2, (SELECT cand FROM vi q WHERE q.tile = k.tile AND vn = 2) AS second FROM (SELECT DISTINCT tile FROM rk) k),
u AS (SELECT *, coalesce(s1 - s2 < 0.05, false) AS near_tie FROM t), z AS (SELECT *, CASE WHEN near_tie AND tile % 2 = 0 THEN second END AS pick FROM u)
SELECT tile, coalesce(pick, best) AS cand, near_tie, CASE WHEN pick <> best THEN 'pick' ELSE 's_alpha' END AS method, pick = best AS agreement FROM z""")
def near_tie_pick(spark, d):
    q = _scored(spark, d).withColumn("s_alpha", r(F.col("s_alpha"), 9))
    second = cd.rank(q.where("viable"), ["tile"]).where("rank = 2 AND tile % 2 = 0").select("tile", F.col("cand").alias("pick"))
    return cd.select_single(q, second, ["tile"], GENERIC)


@query(f"""WITH {_LAST}, ke AS (SELECT tile, cand, s AS slice FROM (SELECT DISTINCT tile, cand FROM ls), range(30) AS r(s))
SELECT tile, cand, slice::INT AS slice, (DATE '2024-01-01' + slice::INT)::VARCHAR AS x_key, round(y, 6) AS y, x IS NULL AS flagged FROM ke LEFT JOIN ls USING (tile, cand, slice)""")
def series_densify_gaps(spark, d):
    q = resample.densify(_last(spark, d), ["tile", "cand"], b.SLICES, F.lit(date(2024, 1, 1)))
    return q.select("tile", "cand", "slice", "x_key", r(F.col("y")).alias("y"), "flagged")


_KNOTS = "kn AS (SELECT tile, x, max(y) AS y FROM pt JOIN (SELECT tile, min(cand) AS cand FROM pt GROUP BY 1) USING (tile, cand) GROUP BY 1, 2)"


@query(f"""WITH {b.POINTS}, {_KNOTS}, sg AS (SELECT tile, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM kn WINDOW o AS (PARTITION BY tile ORDER BY x)), fi AS (SELECT tile, min(x) AS fx, arg_min(y, x) AS fy FROM kn GROUP BY 1),
j AS (SELECT p.tile, p.cand, p.ord, p.x, p.y, s.x AS a, s.y AS ya, s.x2, s.y2, fy FROM pt p ASOF LEFT JOIN sg s ON p.tile = s.tile AND p.x >= s.x LEFT JOIN fi ON p.tile = fi.tile)
SELECT tile, cand, ord, round(base, 6) AS base, round(y - (base - 50), 6) AS corrected FROM (SELECT *, CASE WHEN a IS NULL THEN fy WHEN x2 IS NULL OR x = a THEN ya ELSE ya + (y2 - ya) * (x - a) / (x2 - a) END AS base FROM j)""")
def baseline_interp(spark, d):
    p = b.points(spark, d)
    first = p.groupBy("tile").agg(F.min("cand").alias("cand"))  # a tile's baseline curve: all of its points are knots
    knots = p.join(first, ["tile", "cand"], "left_semi").select("tile", "x", "y")
    q = resample.interpolate(p.select("tile", "x", "cand", "ord", "y"), knots, ["tile"])
    return q.select(
        "tile",
        "cand",
        "ord",
        r(F.col("base")).alias("base"),
        r(resample.correct(F.col("y"), F.col("base"), F.lit(50.0))).alias("corrected")
    )


@query(f"""WITH {b.POINTS}, pl AS (SELECT tile, cand, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM pt WINDOW o AS (PARTITION BY tile, cand ORDER BY x, ord)),
ex AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cand * 37 % 101 DESC, cand) AS n FROM (SELECT tile, cand, min(x) AS a, max(x) AS z FROM pt GROUP BY 1, 2)),
pr AS (SELECT a.tile, a.cand AS cand_a, c.cand AS cand_b, greatest(a.a, c.a) AS lo, least(a.z, c.z) AS hi FROM ex a JOIN ex c ON a.tile = c.tile AND a.n < c.n),
sm AS (SELECT *, lo + (hi - lo) * i / 63 AS sx FROM pr, range(64) AS r(i) WHERE hi > lo),
ya AS (SELECT sm.*, CASE WHEN p.x2 IS NULL THEN p.y ELSE p.y + (p.y2 - p.y) * ((sx - p.x) / (p.x2 - p.x)) END AS y_a FROM sm ASOF JOIN pl p ON sm.tile = p.tile AND sm.cand_a = p.cand AND sm.sx >= p.x),
yb AS (SELECT ya.*, CASE WHEN p.x2 IS NULL THEN p.y ELSE p.y + (p.y2 - p.y) * ((sx - p.x) / (p.x2 - p.x)) END AS y_b FROM ya ASOF JOIN pl p ON ya.tile = p.tile AND ya.cand_b = p.cand AND ya.sx >= p.x)
SELECT tile, cand_a, cand_b, round(median(abs(y_a - y_b)), 6) AS separation FROM yb GROUP BY 1, 2, 3 UNION ALL SELECT tile, cand_a, cand_b, 'infinity'::DOUBLE FROM pr WHERE hi <= lo""")
def polyline_separation(spark, d):
    lines = cd.as_polylines(b.points(spark, d), ["tile", "cand"])
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("tile").orderBy(F.desc(F.col("cand") * 37 % 101), "cand")))
    return cd.separations(ranked, ["tile"], "rank").select("tile", "cand_a", "cand_b", r(F.col("separation")).alias("separation"))


def _ranked_curves(spark, d):
    lines = cd.as_polylines(b.curves(spark, d), ["tile", "cand"])
    return lines.withColumn("rank", F.row_number().over(Window.partitionBy("tile").orderBy(F.desc(F.col("cand") * 37 % 101), "cand")))


@query(f"""WITH RECURSIVE {b.CURVES}, rk AS (SELECT tile, cand, row_number() OVER (PARTITION BY tile ORDER BY cand * 37 % 101 DESC, cand) AS n FROM (SELECT DISTINCT tile, cand FROM cv)), u AS (SELECT tile, cand, n, x, y FROM cv JOIN rk USING (tile, cand)),
sp AS (SELECT a.tile, a.n AS na, c.n AS nb, median(abs(a.y - c.y)) AS s FROM u a JOIN u c ON a.tile = c.tile AND a.n < c.n AND a.x = c.x GROUP BY 1, 2, 3),
cl AS (SELECT tile, nb AS n, list(na) AS close FROM sp WHERE s <= 120 GROUP BY 1, 2), it AS (SELECT tile, n, cand, coalesce(close, []) AS close FROM rk LEFT JOIN cl USING (tile, n)),
st AS (SELECT tile, 1 AS n, [1::BIGINT] AS acc FROM (SELECT DISTINCT tile FROM rk) UNION ALL SELECT st.tile, st.n + 1, CASE WHEN len(acc) < 6 AND NOT list_has_any(acc, close) THEN list_append(acc, it.n) ELSE acc END FROM st JOIN it ON it.tile = st.tile AND it.n = st.n + 1)
SELECT st.tile, i::INT AS place, rk.cand FROM (SELECT tile, arg_max(acc, n) AS acc FROM st GROUP BY 1) st, unnest(range(1, len(acc) + 1)) AS r(i) JOIN rk ON rk.tile = st.tile AND rk.n = acc[i]""")
def distinct_topk(spark, d):
    q = cd.distinct_polylines(_ranked_curves(spark, d), ["tile"], "rank", 6, cd.threshold(8000.0))
    return q.select("tile", F.posexplode("accepted").alias("place", "cand")).select("tile", (F.col("place") + 1).alias("place"), "cand")


@query(f"""WITH {_SCORED}, fb AS (SELECT tile, cand % 7 AS cand, max(y) AS top FROM pt GROUP BY 1, 2), mx AS (SELECT tile, max(cand) + 1 AS off FROM sc GROUP BY 1)
SELECT tile, cand, 'primary' AS pool FROM sc UNION ALL SELECT tile, fb.cand + off, 'fallback' FROM fb JOIN mx USING (tile)""")
def candidate_pool_union(spark, d):
    own = _scored(spark, d).select("tile", "cand")
    other = b.points(spark, d).select("tile", (F.col("cand") % 7).alias("cand")).distinct()
    return cd.merge_pools(own, other, ["tile"])


_VERDICT = "CASE WHEN (cand * 31 + tile) % 4 = 0 THEN 'major' WHEN cand % 4 = 1 THEN 'minor' ELSE 'ok' END"


@query(f"""WITH {_SCORED}, rk AS (SELECT tile, cand, {_VERDICT} AS verdict, row_number() OVER (PARTITION BY tile ORDER BY viable DESC, round(s_alpha, 9) DESC, cand) AS n FROM sc),
b1 AS (SELECT tile, cand FROM (SELECT tile, cand, row_number() OVER (PARTITION BY tile ORDER BY round(s_alpha, 9) DESC, cand) AS n FROM sc) WHERE n = 1), x1 AS (SELECT b1.tile, b1.cand, verdict = 'major' AS veto FROM b1 JOIN rk USING (tile, cand)),
b2 AS (SELECT x.tile, CASE WHEN veto THEN coalesce((SELECT arg_min(cand, n) FROM rk WHERE rk.tile = x.tile AND rk.cand <> x.cand), cand) ELSE cand END AS cand, CASE WHEN veto THEN [cand] ELSE [] END AS rejected FROM x1 x), x2 AS (SELECT b2.*, verdict = 'major' AND NOT list_contains(rejected, cand) AS veto FROM b2 JOIN rk USING (tile, cand)),
b3 AS (SELECT x.tile, CASE WHEN veto THEN coalesce((SELECT arg_min(cand, n) FROM rk WHERE rk.tile = x.tile AND NOT list_contains(list_append(x.rejected, x.cand), rk.cand)), cand) ELSE cand END AS cand, len(rejected) + CASE WHEN veto THEN 1 ELSE 0 END AS n_rejected FROM x2 x)
SELECT tile, cand, n_rejected, {_VERDICT} AS verdict, CASE {_VERDICT} WHEN 'ok' THEN 'accept' WHEN 'major' THEN 'reextract' ELSE 'review' END AS action FROM b3""")
def qc_reselect_round(spark, d):
    q = _scored(spark, d).withColumn("s_alpha", r(F.col("s_alpha"), 9))
    verdict = F.when((F.col("cand") * 31 + F.col("tile")) % 4 == 0, "major").when(F.col("cand") % 4 == 1, "minor").otherwise("ok")
    current = cd.rank(q, ["tile"]).where("rank = 1").select("tile", "cand")
    out = cd.reselect(
        q.select("tile", "cand", "s_alpha", "viable"), current, q.select("tile", "cand", verdict.alias("verdict")), ["tile"], rounds=2
    )
    return out.select(
        "tile", "cand", F.size("rejected").cast("long").alias("n_rejected"), verdict.alias("verdict")
    ).withColumn("action", sr.qc_action(F.col("verdict")))


# --- boxes and months ------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {b.BOXES}, od AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY conf DESC, pos) AS n, struct_pack(pos := pos, x := x, y := y, w := w, h := h) AS s FROM bx),
st AS (SELECT page, n, [s] AS kept FROM od WHERE n = 1 UNION ALL SELECT st.page, od.n, CASE WHEN len(list_filter(st.kept, lambda k: {b.iou_sql('k', 'od')} > 0.3)) > 0 THEN st.kept ELSE list_append(st.kept, od.s) END FROM st JOIN od ON od.page = st.page AND od.n = st.n + 1),
la AS (SELECT page, arg_max(kept, n) AS kept FROM st GROUP BY page)
SELECT page, s.pos AS pos FROM la, unnest(kept) AS u(s)""")
def box_nms(spark, d):
    return bx.suppress(b.boxes(spark, d), ["page"], 0.3).select("page", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH RECURSIVE {b.BOXES}, od AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY y + h / 2, pos) AS n, struct_pack(pos := pos, x := x, y := y, h := h, mid := y + h / 2) AS s FROM bx),
st AS (SELECT page, n, [[s]] AS rs FROM od WHERE n = 1 UNION ALL SELECT page, n, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(rs, [s]) ELSE list_transform(rs, lambda l, i: CASE WHEN i = hit THEN list_append(l, s) ELSE l END) END
  FROM (SELECT st.page, od.n, rs, s, list_position(list_transform(rs, lambda l: len(list_filter(l, lambda a: least(a.y + a.h, od.s.y + od.s.h) - greatest(a.y, od.s.y) > 0.5 * least(a.h, od.s.h))) > 0), true) AS hit FROM st JOIN od ON od.page = st.page AND od.n = st.n + 1)),
la AS (SELECT page, arg_max(rs, n) AS rs FROM st GROUP BY page), fl AS (SELECT page, i AS line, list_min(list_transform(rs[i], lambda a: a.mid)) AS top, unnest(rs[i]) AS s FROM la, unnest(range(1, len(rs) + 1)) AS u(i)),
pl AS (SELECT page, s.pos AS pos, (dense_rank() OVER (PARTITION BY page ORDER BY top, line))::INT AS "row", (row_number() OVER (PARTITION BY page ORDER BY top, line, s.x, s.mid, s.pos))::INT AS place FROM fl)
SELECT *, printf('p%02d', place) AS panel_id FROM pl""")
def reading_order(spark, d):
    q = bx.reading_order(b.boxes(spark, d), ["page"])
    return q.select("page", "pos", "row", "place", F.format_string("p%02d", F.col("place")).alias("panel_id"))


def _match(spark, d):
    q = b.boxes(spark, d)
    truth = q.where("pos % 2 = 0").select("page", F.col("pos").alias("ord"), "box")
    m = bx.greedy_match(truth, q.where("pos % 2 = 1").select("page", "pos", "box"), ["page"])
    days = F.lit(30.0)
    left = g.days_off(F.col("hit.x"), F.col("box.x"), F.col("box.w"), days)
    right = g.days_off(g.right(F.col("hit")), g.right(F.col("box")), F.col("box.w"), days)
    return m.withColumn("left_err", left).withColumn("right_err", right)


_MATCH = f"""{b.BOXES}, tr AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM bx WHERE pos % 2 = 0),
cn AS (SELECT t.page, t.n, list(struct_pack(pos := f.pos, iou := {b.iou_sql('t', 'f')}, x := f.x, w := f.w) ORDER BY {b.iou_sql('t', 'f')} DESC, f.pos) FILTER (WHERE {b.iou_sql('t', 'f')} >= 0.2) AS cs FROM tr t JOIN bx f ON f.page = t.page AND f.pos % 2 = 1 GROUP BY 1, 2),
ch AS (SELECT t.page, t.n, coalesce(c.cs, []) AS cs FROM tr t LEFT JOIN cn c USING (page, n)),
st AS (SELECT page, n, cs[1] AS hit, [cs[1].pos] AS used FROM ch WHERE n = 1 UNION ALL SELECT page, n, hit, list_append(used, hit.pos) FROM (SELECT st.page, ch.n, used, list_filter(ch.cs, lambda c: NOT coalesce(list_contains(used, c.pos), false))[1] AS hit FROM st JOIN ch ON ch.page = st.page AND ch.n = st.n + 1)),
mt AS (SELECT t.page, t.pos AS ord, hit.pos AS pos, hit IS NOT NULL AS detected, hit.iou AS iou, (hit.x - t.x) / (t.w / 30.0::DOUBLE) AS le, (hit.x + hit.w - t.x - t.w) / (t.w / 30.0::DOUBLE) AS re FROM tr t JOIN st USING (page, n))"""


@query(
    f"WITH RECURSIVE {_MATCH} SELECT page, ord, pos, detected, round(iou, 6) AS iou, round(le, 6) AS left_err_days, round(re, 6) AS right_err_days FROM mt"
)
def box_greedy_match(spark, d):
    return _match(spark, d).select(
        "page",
        "ord",
        "pos",
        "detected",
        r(F.col("iou")).alias("iou"),
        r(F.col("left_err")).alias("left_err_days"),
        r(F.col("right_err")).alias("right_err_days")
    )


@query(f"""WITH RECURSIVE {_MATCH}, er AS (SELECT page // 500 AS run, true AS one, detected, iou, abs(le) AS e FROM mt UNION ALL SELECT page // 500, false, detected, iou, abs(re) FROM mt)
SELECT run, count(*) FILTER (WHERE one) AS n, count(*) FILTER (WHERE one AND detected) AS n_detected, round(avg(iou) FILTER (WHERE one), 6) AS mean_iou, round(median(e), 6) AS pooled_median, round(greatest(median(e) FILTER (WHERE one), median(e) FILTER (WHERE NOT one)), 6) AS worse_median FROM er GROUP BY run""")
def fullpage_summary(spark, d):
    q = _match(spark, d).withColumn("run", F.floor(F.col("page") / 500))
    return metrics.summarize(q, ["run"]).select(
        "run", "n", "n_detected", *(r(F.col(c)).alias(c) for c in ("mean_iou", "pooled_median", "worse_median"))
    )


_MONTH_NAMES = ["Januar", "Feb.", "März", "April", "Mai", "Juni", "Juli", "Aug.", "Sept.", "Oktober", "Xxx", "Dezember"]


@query(f"""WITH {b.MONTHS}, p AS (SELECT year, mon AS place, CASE WHEN mon <> 11 AND NOT (year % 3 = 0 AND mon % 2 = 0) THEN mon END AS label_month, CASE WHEN mon = 11 AND year % 2 = 0 THEN 11 END AS hint_month FROM mp),
o AS (SELECT *, coalesce(hint_month, label_month) AS own FROM p), c AS (SELECT *, count(*) OVER y AS n, count(own) OVER y AS k FROM o WINDOW y AS (PARTITION BY year))
SELECT year, place, (CASE WHEN n > 1 AND k < greatest(1, round_even(0.66 * n, 0)) THEN row_number() OVER (PARTITION BY year ORDER BY place) ELSE own END)::INT AS mon, n > 1 AND k < greatest(1, round_even(0.66 * n, 0)) AS positional FROM c""")
def month_assign(spark, d):
    names = F.array(*map(F.lit, _MONTH_NAMES))
    label = F.when((F.col("year") % 3 == 0) & (F.col("mon") % 2 == 0), "??").otherwise(
        F.concat(F.lit("Pegel\n"), F.element_at(names, F.col("mon")))
    )
    q = b.month_panels(spark, d).withColumn("label_month", dates.label_month(label)).withColumn(
        "hint_month", F.when((F.col("mon") == 11) & (F.col("year") % 2 == 0), F.lit(11))
    )
    q = q.withColumn("at", F.col("mon")).withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy("mon")))
    return months.assign(q, ["year"]).select("year", F.col("at").alias("place"), F.col("month").alias("mon"), "positional")


@query(f"""WITH {b.MONTHS}, m AS (SELECT *, median(width / days) OVER (PARTITION BY year) AS med, count(*) OVER (PARTITION BY year) AS k FROM mp)
SELECT year, mon, round(width / med, 6) AS days_est, k >= 3 AND abs(width / med - days) > 0.5 AS outlier FROM m""")
def month_width_outliers(spark, d):
    return months.width_outliers(b.month_panels(spark, d), ["year"]).select(
        "year", "mon", r(F.col("days_est")).alias("days_est"), "outlier"
    )


_PANELS = "pn AS (SELECT year AS page, mon AS pos, (CASE WHEN (year + mon) % 5 = 0 THEN width * 2 WHEN (year + mon) % 7 = 0 THEN width // 5 ELSE width END)::BIGINT AS w FROM mp WHERE (year + mon) % 11 <> 0)"


@query(f"""WITH {b.MONTHS}, {_PANELS}, md AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, median(w) OVER (PARTITION BY page) AS med FROM pn), kp AS (SELECT * FROM md WHERE n <= 12 OR w >= 0.3 * med),
x AS (SELECT *, pos * 300 AS x, round_even(w / med, 0)::INT AS k, greatest(12 - count(*) OVER (PARTITION BY page), 0) AS missing FROM kp),
t AS (SELECT *, coalesce(sum(CASE WHEN k >= 2 THEN k - 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM x),
p AS (SELECT *, 1 + greatest(least(CASE WHEN k >= 2 THEN k - 1 ELSE 0 END, missing - taken), 0) AS parts FROM t)
SELECT page, pos, i::INT AS part, (x + round_even((i - 1) * w / parts, 0))::BIGINT AS x, (round_even(i * w / parts, 0) - round_even((i - 1) * w / parts, 0))::BIGINT AS w, row_number() OVER (PARTITION BY page ORDER BY x + round_even((i - 1) * w / parts, 0), pos, i) AS place FROM p, unnest(range(1, parts::INT + 1)) AS r(i)""")
def panel_split_slivers(spark, d):
    k = F.col("year") + F.col("mon")
    w = F.when(k % 5 == 0, F.col("width") * 2).when(k % 7 == 0, F.floor(F.col("width") / 5)).otherwise(F.col("width")).cast("long")
    q = b.month_panels(spark, d).where(k % 11 != 0).select(
        F.col("year").alias("page"), F.col("mon").alias("pos"), g.box(F.col("mon") * 300, F.lit(0), w, F.lit(100)).alias("box")
    )
    q = bx.split_wide(bx.drop_slivers(q, ["page"], F.lit(12)), ["page"], F.lit(12))
    return q.select("page", "pos", "part", F.col("box.x").alias("x"), F.col("box.w").alias("w"), F.col("place").cast("long").alias("place"))


_STRENGTH = f"""{b.RASTER}, dx AS (SELECT *, coalesce(lead(gray) OVER a - lag(gray) OVER a, 0) AS d FROM rs WINDOW a AS (PARTITION BY tile, "row" ORDER BY col)),
dy AS (SELECT *, lag(d) OVER v AS u, lead(d) OVER v AS e FROM dx WINDOW v AS (PARTITION BY tile, col ORDER BY "row")), cs AS (SELECT tile, col, sum(abs(coalesce(u, e, d) + 2 * d + coalesce(e, u, d))) AS s FROM dy GROUP BY 1, 2)"""


@query(f"""WITH {_STRENGTH}, nb AS (SELECT c.tile, col, s, g AS edge, lag(s) OVER o AS bf, lead(s) OVER o AS af, max(s) OVER (PARTITION BY c.tile, g) AS top FROM cs c, unnest([16, 32, 48]) AS t(g) WHERE abs(col - g) <= 9 WINDOW o AS (PARTITION BY c.tile, g ORDER BY col)),
pk AS (SELECT tile, edge, min(abs(col - edge) * 1000 + col) AS k FROM nb WHERE s >= 0.5 * top AND s >= bf AND s >= af GROUP BY 1, 2)
SELECT tile, edge::INT AS edge, coalesce(k % 1000, edge)::INT AS snapped FROM (SELECT DISTINCT tile, edge FROM nb) JOIN pk USING (tile, edge)""")
def edge_snap(spark, d):
    s = raster.column_strength(b.raster(spark, d), ["tile"]).withColumn("edge", F.explode(F.array(F.lit(16), F.lit(32), F.lit(48))))
    return months.nearest_peak(s, ["tile", "edge"], F.col("edge"), F.lit(9)).select(
        "tile", "edge", F.col("snapped").cast("int").alias("snapped")
    )


@query(f"""WITH {b.RASTER}, sd AS (SELECT tile, col AS seed, col AS x, 20.4::DOUBLE AS y FROM rs WHERE "row" = 20),
pf AS (SELECT s.tile, seed, y, "row", avg(gray) AS v, row_number() OVER (PARTITION BY s.tile, seed ORDER BY "row") - 1 AS i, count(*) OVER (PARTITION BY s.tile, seed) AS n, min("row") OVER (PARTITION BY s.tile, seed) AS top FROM sd s JOIN rs ON rs.tile = s.tile AND col BETWEEN x - 2 AND x + 2 AND "row" BETWEEN 8 AND 32 GROUP BY 1, 2, 3, 4),
sm AS (SELECT a.tile, a.seed, a.y, a.i, a.n, a.top, sum(b.v * w) / 16 AS s FROM pf a, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS k(o, w) JOIN pf b ON a.tile = b.tile AND a.seed = b.seed AND b.i = (a.n - 1) - abs((a.n - 1) - abs(a.i + o)) GROUP BY ALL),
st AS (SELECT tile, seed, y, n, top, avg(s) AS mean, min(s) AS low, stddev_pop(s) AS spread, list(s ORDER BY i) AS ss FROM sm GROUP BY ALL),
dp AS (SELECT *, list_position(ss, low) AS m, ss[list_position(ss, low) - 1] AS a, low AS b, ss[list_position(ss, low) + 1] AS c FROM st)
SELECT tile, seed, round(y, 6) AS y, round(CASE WHEN n >= 3 AND spread >= 1e-3 AND mean - low >= 0.5 * spread THEN top + m - 1 + CASE WHEN m > 1 AND m < n AND abs(a - 2 * b + c) > 1e-9 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END ELSE y END, 6) AS new_y FROM dp""")
def ridge_refine(spark, d):
    """A seed in every column, on a line along row 20."""
    q = b.raster(spark, d)
    seeds = q.where("row = 20").select(
        "tile", F.col("col").alias("seed"), F.col("col").cast("double").alias("x"), (F.col("row") + 0.4).alias("y")
    )
    return raster.refine_ridges(q, seeds, ["tile"], 12, 2).select(
        "tile", "seed", r(F.col("y")).alias("y"), r(F.col("new_y")).alias("new_y")
    )


@query(f'WITH {b.RASTER} SELECT tile, col AS x, round(avg("row"), 6) AS y, count(*) AS n FROM rs WHERE gray > 10 GROUP BY 1, 2')
def mask_to_polyline(spark, d):
    return raster.mask_to_polyline(b.raster(spark, d), ["tile"], 10.0).select(
        "tile", F.col("x").cast("long").alias("x"), r(F.col("y")).alias("y"), "n"
    )


@query(
    f"WITH {b.MONTHS} SELECT year, mon, coalesce(sum(width) OVER (PARTITION BY year ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x, max(n) OVER y - n AS y, (sum(width) OVER y)::BIGINT AS page_w FROM mp WINDOW y AS (PARTITION BY year)"
)
def running_layout(spark, d):
    q = b.month_panels(spark, d).select("year", F.col("mon").alias("month"), F.col("width").alias("w"), F.col("n").alias("h"))
    return months.layout(q, ["year"]).select("year", F.col("month").alias("mon"), "x", "y", "page_w")


_EXTENTS = "ex AS (SELECT tile, m AS mon, m * 5 - 6.0 AS x0, m * 5 + 0.5 AS x1 FROM (SELECT DISTINCT tile FROM pt), range(1, 7) AS c(m))"


@query(
    f"WITH {b.POINTS}, {_EXTENTS} SELECT tile, ord, mon::INT AS mon, round(x0 * 10 + (x - x0), 6) AS moved FROM (SELECT p.tile, ord, x, mon, x0, row_number() OVER (PARTITION BY p.tile, ord ORDER BY mon) AS n FROM pt p JOIN ex ON p.tile = ex.tile AND x BETWEEN x0 AND x1) WHERE n = 1"
)
def range_month_lookup(spark, d):
    q = b.points(spark, d).select("tile", "ord", F.col("x").alias("px"))
    extents = q.select("tile").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumns(
        {"x0": F.col("month") * 5 - 6.0, "x1": F.col("month") * 5 + 0.5}
    )
    return months.month_of(q, extents, ["tile"]).select(
        "tile", "ord", F.col("month").alias("mon"), r(F.col("x0") * 10 + (F.col("px") - F.col("x0"))).alias("moved")
    )


# --- series and evaluation -------------------------------------------------------------------------------------


@query(f"""WITH {_LAST}, rw AS (SELECT tile, cand % 3 AS panel, (DATE '2024-01-01' + slice)::VARCHAR AS x_key, max(y) AS value FROM ls WHERE slice // 10 <> (cand + 1) % 3 GROUP BY 1, 2, 3),
kp AS (SELECT tile, x_key, arg_max(value, panel) AS value, count(*) - 1 AS again FROM rw GROUP BY 1, 2)
SELECT tile, min(x_key) AS first_key, max(x_key) AS last_key, count(*) AS n, (max(x_key)::DATE - min(x_key)::DATE + 1 - count(*))::BIGINT AS missing, sum(again)::BIGINT AS "overlaps", round(sum(value), 4) AS total FROM kp GROUP BY 1 HAVING (SELECT count(DISTINCT panel) FROM rw WHERE rw.tile = kp.tile) >= 2""")
def annual_stitch(spark, d):
    q = _last(spark, d).where(F.floor(F.col("slice") / 10) != (F.col("cand") + 1) % 3)
    rows = q.groupBy(
        "tile", (F.col("cand") % 3).alias("panel_ord"), F.date_add(F.lit(date(2024, 1, 1)), F.col("slice")).cast("string").alias("x_key")
    ).agg(F.max("y").alias("value"))
    st = sr.stitch(rows, ["tile"])
    total = st.groupBy("tile").agg(r(F.sum("value"), 4).alias("total"))
    return sr.continuity(st, ["tile"]).drop("gaps").join(total, "tile").select(
        "tile", "first_key", "last_key", "n", F.col("missing").cast("long").alias("missing"), "overlaps", "total"
    )


def _pairs(spark, d):
    pred, truth = b.daily(spark, d)
    return metrics.align(pred, truth, ["day"]).withColumn("mon", F.trunc("day", "MM"))


_METRICS = f"""{b.DAILY}, ix AS (SELECT *, row_number() OVER (PARTITION BY mon ORDER BY day) AS i FROM pr),
me AS (SELECT mon, count(*) AS n, sqrt(avg(pow(p - t, 2))) AS rmse, avg(abs(p - t)) AS mae, max(abs(p - t)) AS maxae, CASE WHEN count(*) < 2 OR min(t) = max(t) OR min(p) = max(p) THEN 0 ELSE corr(p, t) END AS pearson_r, max(t) AS mt, max(p) AS mp FROM ix GROUP BY mon),
pk AS (SELECT mon, abs(min(i) FILTER (WHERE t = mt) - min(i) FILTER (WHERE p = mp)) AS off FROM ix JOIN me USING (mon) GROUP BY mon),
fm AS (SELECT *, coalesce(1 - abs(mt - mp) / nullif(mt, 0), 0) AS sv, greatest(0, 1 - off / n) AS stm FROM me JOIN pk USING (mon))"""


@query(
    f"WITH {_METRICS} SELECT mon, n, round(rmse, 2) AS rmse, round(mae, 2) AS mae, round(maxae, 2) AS maxae, round(pearson_r, 6) AS pearson_r FROM fm"
)
def aligned_metrics(spark, d):
    q = metrics.aligned_metrics(_pairs(spark, d), ["mon"], ["day"])
    return q.select("mon", "n", *(r(F.col(c), 2).alias(c) for c in ("rmse", "mae", "maxae")), r(F.col("pearson_r")).alias("pearson_r"))


@query(
    f"WITH {_METRICS} SELECT mon, off AS peak_offset, round(sv, 6) AS s_peak_val, round(stm, 6) AS s_peak_time, round(0.4 * pearson_r + 0.4 * sv + 0.2 * stm, 6) AS peak_score FROM fm"
)
def peak_aware_score(spark, d):
    q = metrics.aligned_metrics(_pairs(spark, d), ["mon"], ["day"])
    return q.select(
        "mon",
        F.col("peak_offset").cast("long").alias("peak_offset"),
        *(r(F.col(c)).alias(c) for c in ("s_peak_val", "s_peak_time", "peak_score"))
    )


@query(f"WITH {b.DAILY} SELECT mon, round(median(t / p), 6) AS ratio FROM pr WHERE abs(p) > 1e-6 GROUP BY mon")
def scale_check(spark, d):
    return metrics.scale_ratio(_pairs(spark, d), ["mon"]).select("mon", r(F.col("ratio")).alias("ratio"))


@query(
    """SELECT o_custkey, mon, o_orderkey FROM (SELECT o_custkey, month(o_orderdate)::INT AS mon, o_orderkey, row_number() OVER (PARTITION BY o_custkey, month(o_orderdate) ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def best_row_per_group(spark, d):
    q = b.table(spark, d, "orders").withColumn("mon", F.month("o_orderdate"))
    return metrics.best_rows(
        q, ["o_custkey", "mon"], F.col("o_orderstatus") == "F", [F.desc("o_totalprice"), F.col("o_orderkey")]
    ).select("o_custkey", "mon", "o_orderkey")


@query(f"""WITH {b.TICKS}, {_robust_sql('tk', 'panel')}, ol AS (SELECT panel, regr_slope(value, pixel) AS s, regr_intercept(value, pixel) AS c FROM tk GROUP BY panel)
SELECT panel, round(sqrt(avg(pow((slope * pixel + intercept) - (s * pixel + c), 2))), 4) AS rmse, round(avg(abs((slope * pixel + intercept) - (s * pixel + c))), 4) AS mae, round(max(abs(slope - s) / abs(s)) * 100, 6) AS slope_err_pct FROM tk JOIN ft USING (panel) JOIN ol USING (panel) GROUP BY panel""")
def induced_calibration_error(spark, d):
    t = b.ticks(spark, d)
    one = fit.robust_fit(t, ["panel"]).select("panel", F.col("slope").alias("s1"), F.col("intercept").alias("c1"))
    two = fit.ols(t, ["panel"]).select("panel", F.col("slope").alias("s2"), F.col("intercept").alias("c2"))
    q = t.join(one, "panel").join(two, "panel")
    e = fit.value_at(F.col("s1"), F.col("c1"), F.col("pixel")) - fit.value_at(F.col("s2"), F.col("c2"), F.col("pixel"))
    return q.groupBy("panel").agg(
        r(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        r(F.avg(F.abs(e)), 4).alias("mae"),
        r(F.max(F.abs(F.col("s1") - F.col("s2")) / F.abs(F.col("s2"))) * 100).alias("slope_err_pct")
    )


@query(
    """SELECT week, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS click, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS view, round(avg(value), 6) AS mean_value, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS kinds FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 604800000000 AS week FROM events) GROUP BY week"""
)
def bench_pivot(spark, d):
    week = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(604800000000.0))
    e = b.table(spark, d, "events").withColumn("week", week)
    p = e.groupBy("week").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)))
    rest = e.groupBy("week").agg(
        r(F.avg("value")).alias("mean_value"), F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("kinds")
    )
    return p.join(rest, "week").select(
        "week",
        F.coalesce("click", F.lit(0)).cast("long").alias("click"),
        F.coalesce("view", F.lit(0)).cast("long").alias("view"),
        "mean_value",
        "kinds"
    )


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE c_mktsegment END AS station, n_nationkey % 3 = 0 AND c_mktsegment <> '' AND n_name <> c_mktsegment AS mismatch, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE c_nationkey END AS year,
coalesce(n_nationkey % 3 = 0 AND c_nationkey <> 0 AND n_regionkey <> c_nationkey, false) AS year_mismatch FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def hint_override_flags(spark, d):
    n = b.table(spark, d, "nation")
    given = F.col("n_nationkey") % 3 == 0
    q = b.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    station, off = sr.override(F.when(given, F.col("n_name")), F.col("c_mktsegment"))
    year, year_off = sr.override(F.when(given, F.col("n_regionkey")), F.col("c_nationkey"))
    return q.select("c_custkey", station.alias("station"), off.alias("mismatch"), year.alias("year"), year_off.alias("year_mismatch"))


@query(f"""WITH {_SCORED}, {_robust_sql('tk', 'panel').replace('k0 AS', b.TICKS + ', k0 AS', 1)}
SELECT 'select' AS stage, cand::VARCHAR AS ref, 'coverage below viability gate' AS reason, 'warning' AS severity FROM sc WHERE NOT viable
UNION ALL SELECT 'calibrate', panel, printf('low_r2:%.4f', r2), 'warning' FROM ft WHERE r2 < 0.995 UNION ALL SELECT 'calibrate', panel, 'high_residual', 'warning' FROM ft WHERE rmse / nullif(vrange, 0) > 0.02""")
def review_flags(spark, d):
    one = _scored(spark, d).where("NOT viable").select(
        F.lit("select").alias("stage"),
        F.col("cand").cast("string").alias("ref"),
        F.lit("coverage below viability gate").alias("reason"),
        F.lit("warning").alias("severity")
    )
    two = fit.gate_flags(fit.robust_fit(b.ticks(spark, d), ["panel"]))
    two = two.select(
        F.lit("calibrate").alias("stage"),
        F.col("panel").alias("ref"),
        F.explode("flags").alias("reason"),
        F.lit("warning").alias("severity")
    )
    return sr.flag_rows(one, two)


def flagship(spark: SparkSession, d: str, gates: Gates = GENERIC) -> DataFrame:
    """Candidates to one selected, densified daily series for each tile, in one plan."""
    scored = _scored(spark, d).withColumn("s_alpha", r(F.col("s_alpha"), 9))
    chosen = cd.select_single(scored, None, ["tile"], gates).select("tile", "cand")
    series = _last(spark, d).join(chosen, ["tile", "cand"], "left_semi")
    return resample.densify(series, ["tile", "cand"], b.SLICES, F.lit(date(2024, 1, 1))).select(
        "tile", "cand", "x_key", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "flagged"
    )


QUERIES["selected_series"] = flagship
SQL["selected_series"] = f"""WITH {_SCORED}, bs AS (SELECT tile, cand FROM (SELECT tile, cand, row_number() OVER (PARTITION BY tile ORDER BY round(s_alpha, 9) DESC, cand) AS n FROM sc) WHERE n = 1)
SELECT b.tile, b.cand, (DATE '2024-01-01' + s::INT)::VARCHAR AS x_key, round(x, 6) AS x, round(y, 6) AS y, x IS NULL AS flagged FROM (SELECT * FROM bs, range(30) AS r(s)) b LEFT JOIN ls ON ls.tile = b.tile AND ls.cand = b.cand AND ls.slice = b.s"""
