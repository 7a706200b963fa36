import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import boxes as bx
from tracewright.operators import candidates as cd
from tracewright.operators import fit, metrics, months, raster, resample
from tracewright.operators import series as sr


def points(spark, rows):
    return spark.createDataFrame([("t", i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "t string, ord int, x double, y double")


def sampled(spark, rows, x0, x1, n):
    df = resample.last_per_slice(points(spark, rows), ["t"], F.lit(float(x0)), F.lit(float(x1)), F.lit(n))
    return {r.slice: (r.x, r.y) for r in df.collect()}


def test_last_per_slice(spark):
    assert sampled(spark, [(1, 11), (4, 22), (7, 33)], 0, 10, 2) == {0: (4, 22), 1: (7, 33)}
    assert sampled(spark, [(31, 1), (-1, 2), (32, 3)], 0, 31, 31) == {30: (31, 1)}
    assert sampled(spark, [(5, 1), (5, 2)], 0, 10, 1) == {0: (5, 2)}  # ties: the later input
    assert sampled(spark, [(5, 1)], 10, 10, 3) == {}


def test_densify_marks_gaps(spark):
    df = resample.last_per_slice(points(spark, [(0.5, 1), (2.5, 3)]), ["t"], F.lit(0.0), F.lit(4.0), F.lit(4))
    rows = resample.densify(df, ["t"], 4).orderBy("slice").collect()
    assert [r.flagged for r in rows] == [False, True, False, True]
    assert [r.x_key for r in rows] == ["1", "2", "3", "4"]


def test_interpolate_like_numpy(spark):
    rng = random.Random(3)
    knots = [(float(rng.randrange(50)), rng.random()) for _ in range(12)]
    first = {}
    for x, y in knots:
        first[x] = max(first.get(x, -1), y)
    xs = sorted(first)
    q = [rng.uniform(-10, 60) for _ in range(40)] + xs
    kd = spark.createDataFrame([("a", x, y) for x, y in knots], "k string, x double, y double")
    qd = spark.createDataFrame([("a", x, i) for i, x in enumerate(q)], "k string, x double, i int")
    got = {r.i: r.base for r in resample.interpolate(qd, kd, ["k"]).collect()}
    want = np.interp(q, xs, [first[x] for x in xs])
    assert [got[i] for i in range(len(q))] == pytest.approx(list(want))


def kept_line(ticks, kept):
    """Slope and intercept over the kept indices, from sums in whole fractions."""
    own = [(Fraction(ticks[i][0]), Fraction(ticks[i][1])) for i in kept]
    n, sx, sy = len(own), sum(x for x, _ in own), sum(y for _, y in own)
    slope = (n * sum(x * y for x, y in own) - sx * sy) / (n * sum(x * x for x, _ in own) - sx * sx)
    return slope, (sy - slope * sx) / n


def surviving(ticks, rounds=5, cut=3.5):
    """The kept indices as a walk over sets: a set leads to those ticks that lie within its own spread, and the walk ends where it stands still."""
    walk = [frozenset(range(len(ticks)))]
    while len(walk) <= rounds:
        slope, intercept = kept_line(ticks, walk[-1])
        off = [float(Fraction(y) - slope * Fraction(x) - intercept) for x, y in ticks]
        centre = statistics.median(off[i] for i in walk[-1])
        spread = 1.4826 * statistics.median(abs(off[i] - centre) for i in walk[-1])
        following = frozenset(i for i, o in enumerate(off) if abs(o - centre) <= cut * spread)
        if spread == 0 or len(following) < 2 or following == walk[-1]:
            break
        walk.append(following)
    return walk[-1]


def test_robust_fit(spark):
    rng = np.random.default_rng(42)
    rows, want = [], {}
    for k in range(25):
        n = int(rng.integers(3, 14))
        p = rng.choice(900, n, replace=False) + 50.0
        v = -0.02 * p + 25 + rng.normal(0, 0.01, n)
        for j in range(int(rng.integers(0, 3))):
            v[j] += rng.normal(0, 4)
        ticks = list(zip(p.tolist(), v.tolist(), strict=True))
        kept = surviving(ticks)
        want[k] = (*map(float, kept_line(ticks, kept)), len(kept))
        rows += [(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, v))]
    rows += [(100, 0, 800.0, 2.0), (100, 1, 200.0, 10.0), (101, 0, 5.0, 1.0)]
    got = {r.k: r for r in fit.robust_fit(spark.createDataFrame(rows, "k int, ord int, pixel double, value double"), ["k"]).collect()}
    for k, (s, c, used) in want.items():
        assert (got[k].slope, got[k].intercept) == pytest.approx((s, c), rel=1e-6) and got[k].n_used == used
    two = got[100]
    assert (two.method, two.r2, two.rmse, two.n_rejected) == ("two_anchor", 1.0, 0.0, 0)
    assert two.slope * 500 + two.intercept == pytest.approx(6)
    assert all(t.residual is None for t in two.ticks) and 101 not in got


def test_scale_fallback_and_sides(spark):
    rows = [("log", i, 900.0 - 200 * i + i * i % 3, 10.0**i) for i in range(5)] + [
        ("neg", i, 10.0 * i, -1.0 + 2 * i + 0.01 * (i % 2)) for i in range(5)
    ]
    df = spark.createDataFrame(rows, "k string, ord int, pixel double, value double")
    got = {r.k: r for r in fit.fit_both_scales(df, ["k"], F.lit("linear")).collect()}
    assert got["log"].scale == "log" and got["log"].scale_auto
    assert got["neg"].scale == "linear" and not got["neg"].scale_auto
    mixed = [("m", i, 100.0 * i, 20.0 * i + 1 + 0.1 * (i % 2), "?") for i in range(5)] + [
        ("m", 5 + i, 100.0 * i + 7, 5e5 + 3e5 * i + 10 * (i % 2), "?") for i in range(5)
    ]
    side = fit.pick_side(spark.createDataFrame(mixed, "k string, ord int, pixel double, value double, side string"), ["k"]).collect()
    assert len(side) == 1 and side[0].side in ("left", "right") and side[0].n_ticks == 5 and side[0].r2 > 0.99


def test_donor(spark):
    rows = [(1, "p01", -0.02, 25.0, 0.999, 9), (1, "p02", 9.0, 0.0, 0.1, 1), (1, "p03", -0.025, 24.0, 0.99, 9)]
    df = spark.createDataFrame(rows, "page int, panel string, slope double, intercept double, r2 double, n_used int")
    got = {r.panel: r for r in fit.share_donor(df, ["page"], "panel", F.col("n_used") > 1).collect()}
    assert got["p02"].shared and got["p02"].slope == -0.02 and got["p03"].inconsistent and not got["p01"].inconsistent


def test_separation_and_distinct(spark):
    flat = lambda y, lo=0, hi=100: [(float(x), float(y)) for x in range(lo, hi, 3)]
    rows = [
        ("t", c, i, x, y) for c,
        line in {0: flat(10), 1: flat(12), 2: flat(70), 3: flat(40, 200, 300)}.items() for i,
        (x, y) in enumerate(line)
    ]
    lines = cd.as_polylines(
        spark.createDataFrame(rows, "tile string, cand int, ord int, x double, y double"), ["tile", "cand"]
    ).withColumn("rank", F.col("cand") + 1)
    pairs = cd.separations(lines, ["tile"], "rank")
    got = {(r.cand_a, r.cand_b): r.separation for r in pairs.collect()}
    assert got[0, 1] == pytest.approx(2) and got[0, 2] == pytest.approx(60) and got[0, 3] == math.inf
    chosen = cd.distinct_candidates(lines.select("tile", "rank", "cand"), pairs, ["tile"], 3, cd.threshold(F.lit(400.0))).first()
    assert chosen.accepted == [0, 2, 3]


def test_name_series(spark):
    df = spark.range(1).select(
        cd.name_series(
            F.array(*map(F.lit, (4, 7, 9))),
            F.create_map(F.lit(4), F.lit("b"), F.lit(7), F.lit("artifact"), F.lit(9), F.lit("b")),
            F.array(F.lit("a"), F.lit("b"))
        ).alias("s")
    )
    assert [tuple(x) for x in df.first().s] == [("s1", 4, "b"), ("s2", 7, "a"), ("s3", 9, "series 3")]


def boxes_frame(spark, pages):
    rows = [(p, i, c, (x, y, w, h)) for p, own in pages.items() for i, (x, y, w, h, c) in enumerate(own)]
    return spark.createDataFrame(rows, "page int, pos int, conf double, box struct<x:bigint,y:bigint,w:bigint,h:bigint>")


def iou(a, b):
    ix, iy = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])), max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return ix * iy / (a[2] * a[3] + b[2] * b[3] - ix * iy)


def random_pages(seed, n):
    rng = random.Random(seed)
    return {
        p: [
            (
                rng.randrange(60), rng.randrange(60), rng.randrange(10, 50), rng.randrange(10, 50), rng.randrange(10) / 10
            ) for _ in range(rng.randrange(1, 9))
        ] for p in range(n)
    }


def test_suppress_brute_force(spark):
    pages = random_pages(1, 60)
    got = {}
    for r in bx.suppress(boxes_frame(spark, pages), ["page"], 0.3).collect():
        got.setdefault(r.page, set()).add(r.pos)
    for p, own in pages.items():
        kept = []
        for i in sorted(range(len(own)), key=lambda i: (-own[i][4], i)):
            if all(iou(own[i], own[k]) <= 0.3 for k in kept):
                kept.append(i)
        assert got[p] == set(kept)


def test_reading_order(spark):
    heights = [454, 947, 592, 548, 754, 394, 359, 457, 335, 371, 359, 273]
    pages = random_pages(2, 60) | {
        900: [(100 * i, 1000 - h, 90, h, 1.0) for i, h in enumerate(heights)], 901: [(0, 0, 50, 40, 1.0), (0, 100, 50, 40, 1.0)]
    }
    got = {}
    for r in bx.reading_order(boxes_frame(spark, pages), ["page"]).collect():
        got.setdefault(r.page, {})[r.place] = (r.pos, r.row)
    for p, own in pages.items():
        lines = []
        mid = lambda b: b[1] + b[3] / 2
        for i in sorted(range(len(own)), key=lambda i: (mid(own[i]), i)):
            b = own[i]
            for line in lines:
                if any(min(b[1] + b[3], own[k][1] + own[k][3]) - max(b[1], own[k][1]) > 0.5 * min(b[3], own[k][3]) for k in line):
                    line.append(i)
                    break
            else:
                lines.append([i])
        lines.sort(key=lambda line: min(mid(own[i]) for i in line))
        want = [i for line in lines for i in sorted(line, key=lambda i: (own[i][0], mid(own[i]), i))]
        assert [got[p][k + 1][0] for k in range(len(own))] == want
    assert {row for _, row in got[900].values()} == {1} and {row for _, row in got[901].values()} == {1, 2}


def test_greedy_match(spark):
    truth, found = random_pages(3, 50), random_pages(4, 50)
    found.pop(7)
    t = boxes_frame(spark, truth).withColumnRenamed("pos", "ord")
    got = {(r.page, r.ord): (r.pos, r.iou) for r in bx.greedy_match(t, boxes_frame(spark, found), ["page"]).collect()}
    for p, own in truth.items():
        left = list(range(len(found.get(p, []))))
        for i, b in enumerate(own):
            best = max(left, key=lambda k: (iou(b, found[p][k]), -k), default=None)
            hit = best is not None and iou(b, found[p][best]) >= 0.2
            assert got[p, i][0] == (best if hit else None)
            if hit:
                assert got[p, i][1] == pytest.approx(iou(b, found[p][best]))
                left.remove(best)


def metric_rows(spark, t, p):
    df = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(zip(t, p))], "g string, i int, t double, p double")
    pairs = metrics.align(df.select("g", "i", "p"), df.select("g", "i", "t"), ["g", "i"])
    return metrics.aligned_metrics(pairs, ["g"], ["i"]).first()


def test_metrics(spark):
    t = [float(math.sin(i / 3) * 10 + 20) for i in range(31)]
    same = metric_rows(spark, t, t)
    assert (same.rmse, same.mae, same.maxae, same.peak_offset) == (0, 0, 0, 0) and same.peak_score == pytest.approx(1)
    assert metric_rows(spark, t, [x + 1 for x in t]).rmse == pytest.approx(1)
    assert metric_rows(spark, t, [5.0] * 31).pearson_r == 0.0
    assert metric_rows(spark, t, [x * 3 for x in t]).s_peak_val < -0.5
    late = metric_rows(spark, [9.0 if i == 5 else 1.0 for i in range(31)], [9.0 if i == 25 else 1.0 for i in range(31)])
    assert late.peak_offset == 20 and late.s_peak_time == pytest.approx(1 - 20 / 31)
    assert metric_rows(spark, [1.0, None, 3.0], [1.0, 2.0, float("nan")]).n == 1


def test_months(spark):
    rows = [
        (1, i + 1, None, m) for i, m in enumerate([1, 2, None, 4, 5, 6, 7, 8, 9, 10, 11, 12])
    ] + [(2, i + 1, None, m) for i, m in enumerate([3, 2, 1])] + [(3, 1, 5, 6)]
    df = spark.createDataFrame(rows, "page int, place int, hint_month int, label_month int")
    got = {(r.page, r.place): r for r in months.assign(df, ["page"]).collect()}
    assert got[1, 3].month is None and not got[1, 1].positional and got[1, 12].month == 12
    assert [got[2, i].month for i in (1, 2, 3)] == [1, 2, 3] and got[2, 1].positional
    assert got[3, 1].month == 5 and got[3, 1].mismatch


def test_ridge(spark):
    rows = [
        ("a", r, c, 200.0 - (90.0 if abs(r - 30) < 1 else 40.0 if abs(r - 30) < 2 else 0.0)) for r in range(60) for c in range(20)
    ] + [("b", r, c, 100.0) for r in range(60) for c in range(20)]
    df = spark.createDataFrame(rows, "tile string, row int, col int, gray double")
    seeds = spark.createDataFrame([("a", 0, 10.0, 24.0), ("b", 0, 10.0, 24.0)], "tile string, seed int, x double, y double")
    got = {r.tile: r.new_y for r in raster.refine_ridges(df, seeds, ["tile"]).collect()}
    assert got["a"] == pytest.approx(30, abs=0.01) and got["b"] == 24.0
    s = raster.column_strength(
        df.withColumn("gray", F.when(F.col("col") >= 10, 0.0).otherwise(100.0)), ["tile"]
    ).where("tile = 'a'").orderBy(F.desc("s")).limit(2).collect()
    assert {r.col for r in s} == {9, 10}


def test_stitch_and_hints(spark):
    rows = [
        ("s1", 1, "1849-01-01", 1.0),
        ("s1", 1, "1849-01-02", 2.0),
        ("s1", 2, "1849-01-02", 9.0),
        ("s1", 2, "1849-01-04", None),
        ("s2", 1, "1849-01-01", 5.0)
    ]
    st = sr.stitch(spark.createDataFrame(rows, "sid string, panel_ord int, x_key string, value double"), ["sid"])
    got = {r.x_key: r.value for r in st.collect()}
    assert got == {"1849-01-01": 1.0, "1849-01-02": 9.0, "1849-01-04": None}
    c = sr.continuity(st, ["sid"]).first()
    assert (c.n, c.missing, c.gaps, c.overlaps) == (3, 1, 1, 1)
    panels = spark.createDataFrame([(1, 1, 3), (1, 2, None), (1, 3, 7)], "page int, place int, month int")
    hints = spark.createDataFrame(
        [(1, 3, None, 0, "by month"), (1, None, 2, 1, "by place"), (1, None, 1, 2, "late")],
        "page int, h_month int, h_index int, h_ord int, hint string"
    )
    got = {r.place: (r.hint, r.way) for r in sr.panel_hints(panels, hints, ["page"]).collect()}
    assert got == {1: ("by month", 1), 2: ("by place", 2), 3: (None, None)}


def test_all_curves_are_compared(spark, tmp_path):
    import random
    from statistics import median

    from tracewright.operators import candidates
    from tracewright.plans import queries
    from tracewright.plans.queries import QUERIES

    rng = random.Random(7)
    near = [rng.gauss(0, 1) for _ in range(64)]
    rows = []
    for v in range(60):  # those that rank first are all alike
        first = v * 37 % 101 > 40
        rows.append((v, v % 2, [x + rng.gauss(0, 0.01) for x in near] if first else [rng.gauss(0, 1) for _ in range(64)]))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    apart = lambda a, b: median(abs(x * 1000 - y * 1000) for x, y in zip(a, b, strict=True))
    pairs, top = {}, []
    for tile in (0, 1):
        own = sorted((r for r in rows if r[1] == tile), key=lambda r: (-(r[0] * 37 % 101), r[0]))
        pairs |= {(tile, a[0], b[0]): apart(a[2], b[2]) for i, a in enumerate(own) for b in own[i + 1 :]}
        taken = []
        for r in own:
            if len(taken) < 6 and all(apart(r[2], t[2]) > 120 for t in taken):
                taken.append(r)
        top += [(tile, i + 1, r[0]) for i, r in enumerate(taken)]
    ranked = queries._ranked_curves(spark, str(tmp_path))
    got = {(r.tile, r.cand_a, r.cand_b): r.separation for r in candidates.separations(ranked, ["tile"], "rank").collect()}
    assert len(got) == 2 * 30 * 29 // 2 and got == pytest.approx(pairs, abs=2e-6)
    assert sorted(tuple(r) for r in QUERIES["distinct_topk"](spark, str(tmp_path)).collect()) == sorted(top) and len(top) == 12


def test_every_point_gets_a_baseline(spark, tmp_path):
    from datetime import datetime, timedelta

    from tracewright.plans.queries import QUERIES

    rng = random.Random(8)
    minutes = rng.sample(range(43_000), 400)
    rows = [(i, rng.randrange(10, 30), datetime(2024, 1, 1) + timedelta(minutes=m), rng.random() * 100) for i, m in enumerate(minutes)]
    spark.createDataFrame(
        rows, "event_id long, user_id long, ts timestamp_ntz, value double"
    ).write.parquet(str(tmp_path / "events.parquet"))
    x = {i: m / 1440 for i, m in enumerate(minutes)}
    want = {}
    for i, user, _, y in rows:
        knots = sorted((x[j], v) for j, u, _, v in rows if u == 10 + user % 10)
        base = float(np.interp(x[i], *zip(*knots, strict=True)))
        want[user % 10, user, i] = (base, y - (base - 50))
    got = {(r.tile, r.cand, r.ord): (r.base, r.corrected) for r in QUERIES["baseline_interp"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_repeated_points_keep_their_months(spark):
    from tracewright.operators import months

    points = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 9.0), (2, 2.0)], "page int, px double")
    extents = spark.createDataFrame([(1, 1, 0.0, 3.0), (1, 2, 2.0, 5.0)], "page int, month int, x0 double, x1 double")
    assert [tuple(r) for r in months.month_of(points, extents, ["page"]).collect()] == [(1, 2.0, 1, 0.0, 3.0)] * 2


def test_global_rank_and_long_digits(spark):
    from tracewright.functions import text
    from tracewright.operators.metrics import global_rank

    names = ["p2", "p10", "p" + "9" * 30, "p1" + "0" * 30, "p007", "p"]
    rows = spark.createDataFrame([(n,) for n in names * 1], "name string").withColumn("key", text.natural_key(F.col("name")))
    got = [r.name for r in global_rank(rows, ["key", "name"], parts=4).orderBy("place").collect()]
    assert got == ["p", "p2", "p007", "p10", "p" + "9" * 30, "p1" + "0" * 30]


def test_seeds_outside_the_image(spark):
    from tracewright.operators import raster

    image = spark.createDataFrame(
        [(1, r, c, 10.0 if r == 3 else 100.0) for r in range(8) for c in range(5)], "tile int, row int, col int, gray double"
    )
    seeds = spark.createDataFrame([(1, 0, 40.0, -3.0)], "tile int, seed int, x double, y double")
    assert raster.refine_ridges(image, seeds, ["tile"], 6, 1).first().new_y == pytest.approx(3.0)
