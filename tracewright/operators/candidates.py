"""Candidate polylines: ranking, near ties, mutual separation, greedy distinct choice, pools and reselection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import Gates


def rank(candidates: DataFrame, by: list[str], score: str = "s_alpha", id_: str = "cand") -> DataFrame:
    """rank from 1, best score first; ties by id."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_)))


def select_single(scored: DataFrame, picks: DataFrame | None, by: list[str], gates: Gates = Gates()) -> DataFrame:
    """One candidate for each group: the best of all; where the two best viable ones are close, the pick stands.

    scored: by, cand, s_alpha, viable. picks: by, pick (a viable candidate). Adds near_tie, method, agreement.
    """
    best = rank(scored, by).groupBy(*by).agg(
        F.min_by("cand", "rank").alias("best"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("viable"), F.struct("rank", "s_alpha", "cand")))), 1, 2).alias("top"),
        F.collect_set(F.when(F.col("viable"), F.col("cand"))).alias("viable"),
    )
    near = (F.size("top") >= 2) & (F.get("top", F.lit(0))["s_alpha"] - F.get("top", F.lit(1))["s_alpha"] < gates.tie_margin)
    best = best.withColumn("near_tie", near)
    best = best.join(picks, by, "left") if picks is not None else best.withColumn("pick", F.lit(None).cast("long"))
    best = best.withColumn("pick", F.when(F.col("near_tie") & F.array_contains("viable", F.col("pick")), F.col("pick")))
    chosen = F.coalesce("pick", "best")
    return best.select(
        *by,
        chosen.alias("cand"),
        "near_tie",
        F.when(F.col("pick") != F.col("best"), "pick").otherwise("s_alpha").alias("method"),
        (F.col("pick") == F.col("best")).alias("agreement")
    )


def as_polylines(points: DataFrame, by: list[str]) -> DataFrame:
    """by, pts: each polyline as an array of (x, y) along x; of points with one x the first (ord) stands at each end of a query."""
    pts = F.array_sort(
        F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("ord").alias("ord"), F.col("y").cast("double").alias("y")))
    )
    return points.groupBy(*by).agg(pts.alias("pts"))


def at(pts: Column, x: Column) -> Column:
    """A polyline's y at x, by a search for its segment; end values beyond the ends."""

    def around(i: Column) -> Column:
        a, b = F.get(pts, i - 1), F.get(pts, i)
        return F.when(i == 0, F.get(pts, F.lit(0))["y"]).when(i == F.size(pts), a["y"]).otherwise(
            a["y"] + (b["y"] - a["y"]) * F.try_divide(x - a["x"], b["x"] - a["x"])
        )

    before = F.size(pts) - F.size(F.filter(pts, lambda p: p["x"] > x))
    return F.element_at(F.transform(F.array(before), around), 1)


def _median(xs: Column) -> Column:
    return F.element_at(
        F.transform(
            F.array(F.array_sort(xs)),
            lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
        ),
        1
    )


def separation(a: Column, b: Column, samples: int = 64) -> Column:
    """The median distance of two polylines at evenly spaced x of their common extent; infinite without one."""
    lo = F.greatest(F.get(a, F.lit(0))["x"], F.get(b, F.lit(0))["x"])
    hi = F.least(F.element_at(a, -1)["x"], F.element_at(b, -1)["x"])
    steps = F.sequence(F.lit(0), F.lit(samples - 1))
    gaps = lambda span: F.transform(
        steps,
        lambda i: F.element_at(
            F.transform(F.array(span["lo"] + (span["hi"] - span["lo"]) * i / (samples - 1)), lambda x: F.abs(at(a, x) - at(b, x))), 1
        )
    )
    measured = F.element_at(F.transform(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), lambda span: _median(gaps(span))), 1)
    return F.when(hi > lo, measured).otherwise(F.lit(float("inf")))


def separations(polylines: DataFrame, tile: list[str], order: str, samples: int = 64, within: int | None = None) -> DataFrame:
    """Every pair of a tile's polylines (order_a before order_b) with its separation; of the first `within` by order, if given.

    The pairs of a tile are a result the operator is asked for; `within` is the top-k that bounds them.
    """
    used = polylines if within is None else polylines.where(F.col(order) <= within)
    a = used.select(*tile, F.col(order).alias("order_a"), F.col("cand").alias("cand_a"), F.col("pts").alias("pts_a"))
    b = used.select(*tile, F.col(order).alias("order_b"), F.col("cand").alias("cand_b"), F.col("pts").alias("pts_b"))
    a = a.repartition(4 * a.sparkSession.sparkContext.defaultParallelism)  # a tile's pairs are many: its curves are dealt out
    pairs = a.join(b, tile).where(F.col("order_a") < F.col("order_b"))
    return pairs.select(
        *tile, "order_a", "order_b", "cand_a", "cand_b", separation(F.col("pts_a"), F.col("pts_b"), samples).alias("separation")
    )


def threshold(tile_height: Column | float, gates: Gates = Gates()) -> Column:
    return F.greatest(F.lit(gates.separation_least), F.lit(gates.separation_share) * tile_height)


def distinct_candidates(ranked: DataFrame, pairs: DataFrame, tile: list[str], most: int, limit: Column) -> DataFrame:
    """tile, accepted: up to `most` candidates in rank order, each farther than `limit` from all accepted before it.

    ranked: tile, rank, cand. pairs: order_a < order_b (ranks) and their separation. A candidate carries the ranks that
    are too close to it, so the fold over ranks needs no look-up.
    """
    close = pairs.where(F.col("separation") <= limit).groupBy(*tile, F.col("order_b").alias("rank")).agg(
        F.collect_list("order_a").alias("close")
    )
    rows = ranked.join(close, [*tile, "rank"], "left").select(
        *tile, F.struct("rank", "cand", F.coalesce("close", F.array().cast("array<int>")).alias("close")).alias("c")
    )
    grouped = rows.groupBy(*tile).agg(F.array_sort(F.collect_list("c")).alias("cs"))

    def step(acc: Column, c: Column) -> Column:
        free = (F.size(acc) < most) & ~F.arrays_overlap(F.transform(acc, lambda a: a["rank"]), c["close"])
        return F.when(F.coalesce(free, F.lit(False)), F.concat(acc, F.array(c))).otherwise(acc)

    return grouped.select(*tile, F.transform(F.aggregate("cs", F.slice("cs", 1, 0), step), lambda c: c["cand"]).alias("accepted"))


def _accept(cs: Column, most: Column | int, limit: Column) -> Column:
    """Of candidates (rank, cand, pts) in order up to `most`, each farther than `limit` from all accepted before it.

    A candidate is compared with the accepted ones alone, and with none once `most` are accepted.
    """

    def step(acc: Column, c: Column) -> Column:
        far = lambda: F.forall(acc, lambda a: separation(a["pts"], c["pts"]) > limit)
        return F.when(F.size(acc) >= most, acc).when(far(), F.concat(acc, F.array(c))).otherwise(acc)

    return F.aggregate(cs, F.slice(cs, 1, 0), step)


def distinct_polylines(
    polylines: DataFrame, tile: list[str], order: str, most: int, limit: Column, exclude: Column | None = None
) -> DataFrame:
    """tile, accepted: as distinct_candidates, straight from all polylines of a tile (order, cand, pts) but those that `exclude` marks."""
    used = polylines if exclude is None else polylines.where(~exclude)
    grouped = used.groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("rank"), "cand", "pts"))).alias("cs"))
    return grouped.select(*tile, F.transform(_accept(F.col("cs"), most, limit), lambda c: c["cand"]).alias("accepted"))


def census(page_n: Column, page_labels: Column, panel_n: Column, panel_labels: Column) -> tuple[Column, Column]:
    """How many series a panel has and their labels: its own count and labels beat its page's; without labels they are numbered."""
    n = F.greatest(F.lit(1), F.coalesce(F.nullif(panel_n, F.lit(0)), page_n, F.lit(1)))
    given = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    labels = F.when(F.size(given(panel_labels)) > 0, given(panel_labels)).when(F.size(given(page_labels)) > 0, given(page_labels))
    numbered = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("series "), i.cast("string")))
    return n, F.slice(F.coalesce(labels, numbered), F.lit(1), n)


def select_multi(polylines: DataFrame, tile: list[str]) -> DataFrame:
    """tile, n_series, chosen: the series (series, cand, label) of tiles with several curves, and too_few.

    polylines: tile, rank, cand, pts, and for the whole tile n_series, labels, height and assigned (candidate to label,
    or null). Distinct candidates are taken in rank order; if there are too few, once more with half the height's
    threshold. Those assigned 'artifact' give way to the next candidates that are distinct among themselves, if any are
    left at all. Labels that are missing or taken are replaced (name_series).
    """
    about = ["n_series", "labels", "height", "assigned"]
    grouped = polylines.groupBy(*tile).agg(
        F.array_sort(F.collect_list(F.struct("rank", "cand", "pts"))).alias("cs"), *(F.first(c, ignorenulls=True).alias(c) for c in about)
    )
    once = lambda df, name, value: df.withColumn(  # noqa: E731  keeps a fold from being written out wherever it is used
        name, F.explode(F.array(value))
    )
    first = once(grouped, "first", _accept(F.col("cs"), F.col("n_series"), threshold(F.col("height"))))
    second = _accept(F.col("cs"), F.col("n_series"), threshold(F.floor(F.col("height") / 2)))
    taken = once(first, "accepted", F.when(F.size("first") < F.col("n_series"), second).otherwise(F.col("first")))
    label = lambda c: F.lower(F.coalesce(F.try_element_at("assigned", c["cand"]), F.lit("")))
    kept = taken.withColumn(
        "keep", F.when(F.col("assigned").isNull(), F.col("accepted")).otherwise(F.filter("accepted", lambda c: label(c) != "artifact"))
    )
    rest = F.filter("cs", lambda c: ~F.array_contains(F.transform("accepted", lambda a: a["cand"]), c["cand"]))
    refill = F.when(
        F.size("keep") < F.size("accepted"), _accept(rest, F.col("n_series") - F.size("keep"), threshold(F.col("height")))
    ).otherwise(F.slice("cs", 1, 0))
    kept = once(kept, "both", F.concat("keep", refill))
    final = kept.withColumn(
        "final", F.transform(F.when(F.size("both") > 0, F.col("both")).otherwise(F.col("accepted")), lambda c: c["cand"])
    )
    named = name_series(
        F.col("final"),
        F.coalesce("assigned", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>"))),
        F.col("labels")
    )
    return once(final, "chosen", named).select(*tile, "n_series", "chosen", (F.size("final") < F.col("n_series")).alias("too_few"))


def name_series(accepted: Column, assigned: Column, labels: Column) -> Column:
    """(series, cand, label) of accepted candidates: the assigned label if it is free, else the first free one, else 'series i'.

    assigned: map of candidate to label; 'artifact' names no series.
    """

    def step(acc: Column, c: Column) -> Column:
        i = F.size(acc) + 1
        used = F.transform(acc, lambda s: s["label"])
        free = F.array_except(labels, used)
        own = F.try_element_at(assigned, c)
        good = own.isNotNull() & (own != "") & (F.lower(own) != "artifact") & ~F.array_contains(used, own)
        label = F.when(good, own).otherwise(F.coalesce(F.get(free, F.lit(0)), F.concat(F.lit("series "), i.cast("string"))))
        return F.concat(
            acc, F.array(F.struct(F.concat(F.lit("s"), i.cast("string")).alias("series"), c.alias("cand"), label.alias("label")))
        )

    empty = F.filter(
        F.transform(accepted, lambda c: F.struct(F.lit("").alias("series"), c.alias("cand"), F.lit("").alias("label"))),
        lambda s: F.lit(False)
    )
    return F.aggregate(accepted, empty, step)


def merge_pools(primary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """Both pools; the fallback's candidates are numbered on from the primary's highest."""
    top = primary.groupBy(*by).agg((F.max("cand") + 1).alias("offset"))
    moved = fallback.join(top, by, "left").withColumn(
        "cand", F.col("cand") + F.coalesce("offset", F.lit(0))
    ).drop("offset").withColumn("pool", F.lit("fallback"))
    return primary.withColumn("pool", F.lit("primary")).unionByName(moved)


def reselect(scored: DataFrame, current: DataFrame, verdicts: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """Current selections after up to `rounds` vetoes: each 'major' verdict on the held candidate rejects it for the next best.

    scored: by, cand, s_alpha, viable. current: by, cand. verdicts: by, cand, verdict. A viable candidate is taken before
    others; a group without one left keeps its last and is marked exhausted. Rounds are unrolled: two joins each.
    """
    state = current.select(*by, "cand", F.array().cast("array<bigint>").alias("rejected"), F.lit(False).alias("exhausted"))
    for _ in range(rounds):
        judged = state.join(verdicts, [*by, "cand"], "left").withColumn(
            "veto", F.coalesce(F.col("verdict") == "major", F.lit(False)) & ~F.col("exhausted")
        )
        vetoed = judged.where("veto").select(*by, F.array_append("rejected", F.col("cand").cast("long")).alias("rejected"))
        left = scored.join(vetoed, by).where(~F.array_contains("rejected", F.col("cand").cast("long")))
        following = left.groupBy(*by).agg(F.max_by("cand", F.struct("viable", "s_alpha", -F.col("cand"))).alias("next"))
        state = judged.join(following, by, "left").select(
            *by, F.when(F.col("veto"), F.coalesce("next", "cand")).otherwise(F.col("cand")).alias("cand"), F.when(
                F.col("veto"), F.array_append("rejected", F.col("cand").cast("long"))
            ).otherwise(F.col("rejected")).alias("rejected"),
            (F.col("exhausted") | (F.col("veto") & F.col("next").isNull())).alias("exhausted"),
        )
    return state
