"""Panel boxes of a page: duplicates, reading order, matching, and repair toward an expected count.

A page has few boxes, so each operator gathers a page's boxes into one array and folds over it in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates
from tracewright.functions import geometry as g
from tracewright.operators import months


def suppress(boxes: DataFrame, page: list[str], limit: float = Gates.iou_duplicate) -> DataFrame:
    """Boxes in falling confidence (ties by pos), without those that overlap a kept one by more than the limit.

    boxes: page, pos, conf, box (x, y, w, h).
    """
    rows = boxes.select(*page, F.struct((-F.col("conf")).alias("key"), "pos", "box").alias("b"))
    grouped = rows.groupBy(*page).agg(F.array_sort(F.collect_list("b")).alias("bs"))

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: g.iou(k["box"], b["box"]) > limit), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate(F.slice("bs", 2, F.greatest(F.size("bs") - 1, F.lit(0))), F.slice("bs", 1, 1), step)
    return grouped.select(*page, F.explode(kept).alias("b")).select(*page, "b.pos", (-F.col("b.key")).alias("conf"), "b.box")


def reading_order(boxes: DataFrame, page: list[str], overlap: float = Gates.row_overlap) -> DataFrame:
    """boxes with row and place: rows by vertical overlap with any member of a row, then from left to right.

    Boxes come by their middle (ties by pos); the first row with a member that overlaps by more than half of the lower
    of the two heights takes a box. Rows are ordered by their highest middle, their boxes by x (ties by middle, pos).
    """
    middle = F.col("box.y") + F.col("box.h") / 2
    rows = boxes.select(*page, F.struct(middle.alias("mid"), "pos", "box").alias("b"))
    grouped = rows.groupBy(*page).agg(F.array_sort(F.collect_list("b")).alias("bs"))

    def meets(a: Column, b: Column) -> Column:
        return F.least(
            g.bottom(a["box"]), g.bottom(b["box"])
        ) - F.greatest(a["box"]["y"], b["box"]["y"]) > overlap * F.least(a["box"]["h"], b["box"]["h"])

    def step(lines: Column, b: Column) -> Column:
        # A row is an array of boxes; the first one that b meets takes it.
        hits = F.transform(lines, lambda line: F.exists(line, lambda a: meets(a, b)))
        found = F.array_position(hits, F.lit(True))
        grown = F.transform(lines, lambda line, i: F.when(i + 1 == found, F.concat(line, F.array(b))).otherwise(line))
        return F.when(found > 0, grown).otherwise(F.concat(lines, F.array(F.array(b))))

    lines = F.aggregate(F.slice("bs", 2, F.greatest(F.size("bs") - 1, F.lit(0))), F.array(F.slice("bs", 1, 1)), step)
    flat = grouped.select(*page, F.posexplode(lines).alias("line", "members")).select(
        *page, "line", F.array_min(F.transform("members", lambda m: m["mid"])).alias("top"), F.explode("members").alias("b")
    )
    order = Window.partitionBy(*page).orderBy("top", "line", F.col("b.box.x"), F.col("b.mid"), F.col("b.pos"))
    line_no = F.dense_rank().over(Window.partitionBy(*page).orderBy("top", "line"))
    return flat.select(
        *page, F.col("b.pos").alias("pos"), F.col("b.box").alias("box"), line_no.alias("row"), F.row_number().over(order).alias("place")
    )


def greedy_match(truth: DataFrame, found: DataFrame, page: list[str], least: float = Gates.match_iou) -> DataFrame:
    """truth (page, ord, box) with its best found box (page, pos, box) by overlap, in order, each found box once.

    A truth box without one at `least` is undetected; of equal overlaps the first found box stands.
    """
    t = truth.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("ord", "box"))).alias("ts"))
    d = found.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("pos", "box"))).alias("ds"))
    both = t.join(d, page, "left").withColumn("ds", F.coalesce("ds", F.array().cast(d.schema["ds"].dataType)))
    kind = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
    none = F.array().cast(f"array<struct<ord:bigint,box:{kind},pos:bigint,iou:double,hit:{kind}>>")
    start = F.struct(
        F.transform(
            F.col("ds"), lambda x: F.struct(x["pos"].cast("long").alias("pos"), x["box"].alias("box"))
        ).cast(f"array<struct<pos:bigint,box:{kind}>>").alias("left"),
        none.alias("out")
    )

    def step(acc: Column, t: Column) -> Column:
        scored = F.transform(
            acc["left"], lambda x: F.struct(g.iou(t["box"], x["box"]).alias("iou"), (-x["pos"]).alias("first"), x["box"].alias("box"))
        )
        best = F.array_max(scored)
        hit = F.coalesce((best["iou"] >= least) & (best["iou"] > 0), F.lit(False))

        def with_hit(h: Column) -> Column:
            row = F.struct(
                t["ord"].cast("long").alias("ord"),
                t["box"].alias("box"),
                F.when(h["ok"], -h["best"]["first"]).alias("pos"),
                F.when(h["ok"], h["best"]["iou"]).otherwise(F.lit(None).cast("double")).alias("iou"),
                F.when(h["ok"], h["best"]["box"]).alias("hit")
            )
            return F.struct(
                F.filter(acc["left"], lambda x: ~(h["ok"] & (x["pos"] == -h["best"]["first"]))).alias("left"),
                F.concat(acc["out"], F.array(row)).alias("out")
            )

        return F.element_at(F.transform(F.array(F.struct(hit.alias("ok"), best.alias("best"))), with_hit), 1)

    out = F.aggregate("ts", start, step, lambda acc: acc["out"])
    return both.select(*page, F.explode(out).alias("m")).select(
        *page, "m.ord", "m.box", "m.pos", "m.hit", F.col("m.pos").isNotNull().alias("detected"), "m.iou"
    )


def drop_slivers(boxes: DataFrame, page: list[str], expected: Column, share: float = Gates.sliver) -> DataFrame:
    """On pages with more boxes than expected, those far narrower than the median go. Adds n and median_w of the page."""
    w = Window.partitionBy(*page)
    out = boxes.withColumn("n", F.count("*").over(w)).withColumn("median_w", F.median("box.w").over(w))
    return out.where((F.col("n") <= expected) | (F.col("box.w") >= share * F.col("median_w")))


def split_wide(boxes: DataFrame, page: list[str], expected: Column) -> DataFrame:
    """On pages with fewer boxes than expected, boxes of several median widths are cut into equal parts, until none is missing.

    The budget is a running total: a box k median widths wide gives up to k parts, but no more than are still missing
    when its turn comes (by pos). boxes: page, pos, box, median_w. Adds part and place (from left to right).
    """
    w = Window.partitionBy(*page)
    k = F.rint(F.try_divide(F.col("box.w"), F.col("median_w"))).cast("int")
    out = boxes.withColumn("k", k).withColumn("missing", F.greatest(expected - F.count("*").over(w), F.lit(0)))
    want = F.when(F.col("k") >= 2, F.col("k") - 1).otherwise(0)
    taken = F.coalesce(F.sum(want).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.least(want.cast("long"), F.col("missing") - taken), F.lit(0))
    out = out.withColumn("parts", (extra + 1).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    cut = lambda j: F.col("box.x") + F.rint(j * F.col("box.w") / F.col("parts")).cast("long")
    piece = g.box(cut(F.col("part") - 1), F.col("box.y"), cut(F.col("part")) - cut(F.col("part") - 1), F.col("box.h"))
    out = out.withColumn("box", piece)
    return out.withColumn("place", F.row_number().over(w.orderBy(F.col("box.x"), "pos", "part"))).drop("k", "missing")


# Fixed value: the flag of a panel that was cut out of a wider box.
SPLIT_FLAG = "split_from_multimonth_box"


def repair_count(
    panels: DataFrame, page: list[str], expected: Column, strength: DataFrame | Callable[[Column], Column], share: float = Gates.sliver
) -> tuple[DataFrame, DataFrame]:
    """panels brought towards the expected count, and the flags that this raises.

    panels: page, pos, box, plot, flags and more, which parts inherit. strength: page, pos, col, s, the column strengths of
    each box's rows; or, where a panel's own row tells them, a function of a column's number that gives its strength from
    that row, which is asked of the few columns near a cut only: no table of columns is made or joined then. On pages with too many panels those far narrower than the median go. On pages with too few, boxes of
    several median widths are cut at their seams, in the order of pos, until none is missing; the plot area is cut along
    with its box. Then panels are numbered from left to right, as `panel` (p01, ...). Pages of the right count, or where
    none is expected, stay as they are but for the numbers.
    """
    own = [*page, "pos"]
    w = Window.partitionBy(*page)
    known = panels.withColumn(
        "_expected", F.coalesce(expected, F.lit(0)).cast("long")
    ).withColumn("_n", F.count("*").over(w)).withColumn("_median", F.median("box.w").over(w))
    sliver = (F.col("_expected") > 0) & (F.col("_n") > F.col("_expected")) & (F.col("box.w") < share * F.col("_median"))
    kept = known.where(~sliver).withColumn("_left", F.count("*").over(w))
    k = F.rint(F.try_divide(F.col("box.w"), F.col("_median"))).cast("long")
    missing = F.when(F.col("_expected") > 0, F.greatest(F.col("_expected") - F.col("_left"), F.lit(0))).otherwise(0)
    want = F.when(F.col("_k") >= 2, F.col("_k") - 1).otherwise(0)
    before = F.coalesce(F.sum(want).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("_k", k).withColumn("_missing", missing)
    kept = kept.withColumn("parts", (F.greatest(F.least(want, F.col("_missing") - before), F.lit(0)) + 1).cast("int"))
    x, width = F.col("box.x"), F.col("box.w")
    if callable(strength):
        edges = kept.withColumn("_edges", months.seam_edges(x, width, F.col("parts"), strength))
        joined = edges.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts")))).withColumn(
            "_x", F.get("_edges", F.col("part") - 1)
        ).withColumn("_w", F.get("_edges", F.col("part")) - F.col("_x")).drop("_edges")
    else:
        cut = months.cut_at_seams(kept.select(*own, x.alias("x"), width.alias("w"), "parts"), page, strength, of_box=True)
        joined = kept.join(cut.select(*own, "part", F.col("x").alias("_x"), F.col("w").alias("_w")), own)
    piece = g.box(F.col("_x"), F.col("box.y"), F.col("_w"), F.col("box.h"))
    left, right = F.greatest(F.col("plot.x"), F.col("_x")), F.least(F.col("plot.x") + F.col("plot.w"), F.col("_x") + F.col("_w"))
    area = F.when(right - left > 4, g.box(left, F.col("plot.y"), right - left, F.col("plot.h"))).otherwise(piece)
    split = F.col("parts") > 1
    order = w.orderBy(F.col("_x"), "pos", "part")
    number = F.row_number().over(order).cast("string")
    name = F.concat(F.lit("p"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    out = joined.withColumn("panel", name).withColumn("box", F.when(split, piece).otherwise(F.col("box"))).withColumn(
        "plot", F.when(split, area).otherwise(F.col("plot"))
    )
    out = out.withColumn("flags", F.when(split, F.array_append("flags", F.lit(SPLIT_FLAG))).otherwise(F.col("flags")))

    ref = F.concat_ws("/", *page)
    told = lambda rows, reason, severity: rows.select(
        F.lit("triage").alias("stage"), ref.alias("ref"), reason.alias("reason"), F.lit(severity).alias("severity")
    )
    gone = told(known.where(sliver).groupBy(*page).agg(F.count("*").alias("n")), F.format_string("dropped %d sliver panel(s)", "n"), "info")
    cuts = told(kept.where("parts > 1"), F.format_string("split a %d-month-wide box into %d panels", "_k", "parts"), "info")
    count = out.groupBy(*page).agg(F.count("*").alias("n"), F.max("_expected").alias("e"), F.max("_n").alias("was"))
    off = told(
        count.where("e > 0 AND n <> e AND was <> e"),
        F.format_string("panel count %d != expected %d after repair; hints can draw the boxes", "n", "e"),
        "blocking"
    )
    return out.select("panel", *panels.columns), gone.unionByName(cuts).unionByName(off)
