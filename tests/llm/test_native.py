"""Winnowing, line rules, license scans and mixing: against brute force on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import line_rules, mixing, winnowing
from tracewright.llm.licenses import NOTICES, PHRASES, scan_licenses

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def words(t):
    return _WORD.findall(lower(t))


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def brute_hits(rows, items):
    windows = {}
    for item, t in items:
        ws = words(t)
        if item is not None and ws:
            n = min(10, len(ws))
            for s in range(len(ws) - n + 1):
                windows.setdefault(tuple(ws[s : s + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        ws, hit, ids = words(t), set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= own
        out.append((str(i), len(ws), len(hit), len(ids), ",".join(sorted(ids))))
    return sorted(out)


def test_winnowing_like_brute_force(spark, odd, odd_rows, empty):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)]  # few words: many chance matches, ties and overlaps
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(10, 30))) for k in range(30)] + [
        (100, "one two three"),
        (101, ""),
        (102, None),
        (None, "no id at all in this item of ten words yes"),
        (103, "v1"),
        (11, "seven wizards vex quietly beneath")
    ]
    rows = [(r[0], r[1]) for r in odd_rows]
    for k in range(200):
        _, t = items[k % 30]
        own = t.split()
        a = rng.randrange(len(own) - 9)
        rows.append((1000 + k, " ".join([text(rng.randrange(40)), *own[a : a + rng.randrange(8, 14)], text(rng.randrange(20))])))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, places string, window string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = winnowing.decontaminate(df, bench)
    assert no_python(out)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in out.collect()) == brute_hits(rows, items)
    assert winnowing.decontaminate(empty, bench).count() == 0
    assert winnowing.decontaminate(odd, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_every_shared_span_has_a_fingerprint(spark):
    rng = random.Random(8)
    rows = []
    for k in range(100):
        span = [f"s{rng.randrange(50)}" for _ in range(10)]
        pad = lambda: [f"p{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        rows.append((k, " ".join([*pad(), *span, *pad()]), " ".join([*pad(), *span, *pad()])))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    from tracewright.llm.common import words as cut

    f = lambda c: F.transform(winnowing.fingerprints(cut(F.col(c)), 6, 5), lambda x: x["h"])
    assert df.where(F.arrays_overlap(f("a"), f("b"))).count() == 100


def brute_lines(t):
    ws = re.findall("[^\x20\x09-\x0d]+", t or "")
    at = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    repeated = {j for i in range(len(ws) - 2) if at[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(repeated), failed


def test_line_counts(spark, odd, odd_rows, empty):
    rng = random.Random(2)
    more = [
        " ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(40)
    ] + ["x y\nx y\n \nx y\nz#|<\n", "a b a b a b", "a a a a"]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(None, t) for t in more], "doc_id long, text string"))
    out = line_rules.clean_lines(df)
    assert no_python(out)
    got = sorted(
        tuple(r) for r in out.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    )
    assert got == sorted(brute_lines(t) for t in [r[1] for r in odd_rows] + more)
    assert line_rules.clean_lines(odd).count() == len(odd_rows) and line_rules.clean_lines(empty).count() == 0


def test_line_rules(spark):
    prose = "The river rose again in spring, and the gauge at the old bridge read four feet.\n"
    rows = [
        ("clean", prose * 2 + " ".join(f"word{i}" for i in range(60)) + ". End."),
        (
            "menu",
            "\n".join(["Home > News > All", "Log in", "Read more", "Next page"] * 20) + "\n" + " ".join(f"item{i}" for i in range(29))
        ),
        ("marks", " ".join(f"w{i}&&&&" for i in range(80)))
    ]
    got = {
        r.doc_id: r for r in spark.createDataFrame(
            [(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"
        ).transform(line_rules.clean_lines).collect()
    }
    assert got[0].kept and not got[1].kept and not got[2].kept and got[1].n_failed_lines == 80 and "Home" not in got[1].kept_text


def test_line_rules_in_four_languages(spark):
    prose = "Der Fluss stieg im Frühjahr wieder, und der Pegel zeigte vier Fuß, " + " ".join(f"wort{i}" for i in range(150)) + ".\n"
    lines = [
        "Lire la suite »",
        "ÜBER UNS",
        "Leer MÁS",
        "Tous droits RÉSERVÉS, une maison de la ville.",
        "Nous lisons la suite.",
        "Datenschutzerklärung der alten Stadt am Fluss.",
        "Política de Cookies de la ciudad.",
        "inicios",
        "weiter unten im Text"
    ]
    r = spark.createDataFrame([(1, prose + "\n".join(lines))], "doc_id long, text string").transform(line_rules.clean_lines).first()
    assert r.kept and r.n_failed_lines == 6 and r.kept_text.split("\n")[-3:] == ["Nous lisons la suite.", "inicios", "weiter unten im Text"]
    english = line_rules.Rules(phrases=tuple(p for p in line_rules.PHRASES if p[0] == "en"))
    assert line_rules.clean_lines(
        spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), rules=english
    ).first().n_failed_lines == 0
    assert line_rules.clean_lines(
        spark.createDataFrame([(1, "Home\nlorem ipsum")], "doc_id long, text string"), rules=line_rules.Rules(phrases=())
    ).first().n_failed_lines == 0


def test_licenses(spark, odd, odd_rows, empty):
    mit, gpl = NOTICES[0][1].split(), NOTICES[4][1].split()
    broken = " ".join([*mit[:12], "xx", "yy", *mit[12:30], *mit[33:]])  # words put in and left out
    texts = [
        f"a MIT License b mit, license {' '.join(gpl)} x",
        f"foo {broken} bar",
        "Apache\nLicense general PUBLIC license",
        "mit licenses of the software in the",
        " ".join(mit[:10]),
        "mit license " * 3
    ]
    rows = [(r[0], r[1]) for r in odd_rows] + [(2000 + k, t) for k, t in enumerate(texts)]
    out = scan_licenses(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, h string"))
    assert no_python(out)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out.collect())
    want = []
    for i, t in rows:
        ws = words(t)
        at = [
            (p, label) for phrase,
            label in (
                ("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")
            ) for k in [phrase.split()] for p in range(len(ws)) if ws[p : p + len(k)] == k
        ]
        want.append(
            (
                str(i),
                len(ws),
                len(at),
                str(min((p for p, _ in at), default=None)),
                str(max((p for p, _ in at), default=None)),
                ",".join(sorted({label for _, label in at}))
            )
        )
    assert got == sorted(want)
    by = {r.doc_id: r for r in out.collect()}
    assert by[2000].labels == "gpl,mit" and by[2000].score == 1.0
    assert by[2001].labels == "mit" and 0.8 < by[2001].score < 1 and by[2001].spans[0]["first"] == 1
    assert by[2003].labels == "" and by[2004].labels == "" and by[2005].n_base == 3
    assert scan_licenses(empty).count() == 0


def test_mixing(spark, odd, odd_rows, empty):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(rng.choice(bad if k % 4 == 0 else good) for _ in range(rng.randrange(20, 60)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    labels = spark.createDataFrame(
        [(k, 0 if k % 4 == 0 else 1, 0) for k in range(0, 400, 3)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"
    )
    out = mixing.mix(docs, mixing.label_domains(labels), {"quality1_toxic0": 1.0, "quality0_toxic0": 0.5}).cache()
    got = out.collect()
    assert len(got) == 400 + len(odd_rows) and all(r.rate >= 0 and abs(sum(r.posteriors.values()) - 1) < 1e-6 for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum((r.posteriors["quality0_toxic0"] > 0.5) == (r.doc_id % 4 == 0) for r in own) >= 396
    for name, share in (("quality1_toxic0", 1.0), ("quality0_toxic0", 0.5)):
        now, then = sum(r.n_tokens * r.posteriors[name] for r in got), sum(r.n_tokens * r.posteriors[name] * r.rate for r in got)
        assert then == pytest.approx(share * now, rel=0.02)
    assert mixing.mix(empty, mixing.label_domains(labels), {}).count() == 0
    none = mixing.mix(odd, mixing.label_domains(labels.where("doc_id < 0")), {}).collect()
    assert len(none) == len(odd_rows) and all(r.rate == 1.0 and r.copies == 1 for r in none)


def solved(rows, targets, rounds=400):
    """The nearest nonnegative rates to one that meet the targets, by sweeps: each domain's multiplier in turn, by bisection."""
    a = np.array([[n * x / t for x, t in zip(p, targets, strict=True)] for n, p in rows]).T
    y = np.zeros(len(targets))
    for _ in range(rounds):
        for d in range(len(targets)):
            total = lambda v: np.maximum(0, 1 - a.T @ np.where(np.arange(len(y)) == d, v, y)) @ a[d]  # noqa: B023, E731
            lo, hi = -1.0, 1.0
            while total(lo) < 1:
                lo *= 2
            while total(hi) > 1:
                hi *= 2
            for _ in range(60):
                lo, hi = (mid, hi) if total(mid := (lo + hi) / 2) > 1 else (lo, mid)
            y[d] = (lo + hi) / 2
    return np.maximum(0, 1 - a.T @ y)


def test_rates_like_a_brute_force_solver(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(1, 300)), [float(x) for x in rng.dirichlet([0.4, 0.3, 0.2])]) for _ in range(300)]
    now = [sum(n * p[d] for n, p in rows) for d in range(3)]
    targets = [1.3 * now[0], 0.7 * now[1], 0.15 * now[2]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n_tokens long, p array<double>")
    fitted, totals = mixing.fit_rates(df, targets, tolerance=1e-7)
    got, want = [r.rate for r in fitted.orderBy("k").collect()], solved(rows, targets)
    assert totals == pytest.approx(targets, rel=1e-3) and got == pytest.approx(list(want), abs=1e-3) and min(want) == 0.0


def test_targets_out_of_reach(spark):
    """Nothing of the first domain comes without a third of the second: the totals come as near as they can, relative to their targets."""
    rows = [(30, [2 / 3, 1 / 3]), (60, [2 / 3, 1 / 3]), (0, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    fitted, totals = mixing.fit_rates(df, [100.0, 10.0], steps=200, tolerance=1e-9)
    x = np.array([[n * p[0] / 100, n * p[1] / 10] for n, p in rows]).T  # relative totals are x r: least squares over the one direction
    s = (x[:, 0] / 30).sum() / ((x[:, 0] / 30) @ (x[:, 0] / 30))
    assert totals == pytest.approx([s * 2 / 3, s / 3], rel=1e-2) and all(r.rate >= 0 for r in fitted.collect())
    docs = spark.createDataFrame([(k, "a b c " * 20) for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "doc_id long, domain string")
    out = mixing.mix(docs, labels, {"x": 5.0, "y": 0.0})
    assert no_python(out) and out.first().residual > 0.1


def test_rates_reach_hard_targets(spark):
    rng = random.Random(11)
    rows = []
    for k in range(2000):  # a rare domain that leaks into most documents: many rates end at zero
        bad = rng.random() ** 6 if k % 20 else 1 - 0.2 * rng.random()
        first = rng.random()
        rows.append((rng.randrange(20, 400), [(1 - bad) * first, (1 - bad) * (1 - first), bad]))
    now = [sum(n * p[d] for n, p in rows) for d in range(3)]
    targets = [now[0], 0.9 * now[1], 0.1 * now[2]]
    df = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    fitted, totals = mixing.fit_rates(df, targets)
    assert totals == pytest.approx(targets, rel=1e-3)
    fitted, totals = mixing.snap_rates(fitted, targets, totals, 0.05)
    got = fitted.collect()
    assert min(r.rate for r in got) >= 0 and totals == pytest.approx(targets, rel=1e-3)
    assert [sum(r.rate * r.n_tokens * r.p[d] for r in got) for d in range(3)] == pytest.approx(totals)


def test_looks_of_a_text(spark):
    texts = ["aa bb aa [x] {y} \\ / #", "One. Two, three; four: 12 of 345!", "A", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df = df.withColumn("ws", mixing.tokens_of(F.col("text"))).withColumn("got", mixing.features(F.col("text"), F.col("ws"), 1 << 30))
    for i, t in enumerate(texts):
        n, ws = max(len(t), 1), words(t)
        count = lambda chars: sum(c in chars for c in t)  # noqa: B023, E731
        looks = {
            "symbols": count("#*$%&|<>@^~={}[]\\/") / n,
            "stops": 4 * (count(".,;:!?") / n),
            "capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
            "digits": count("0123456789") / n,
            "distinct": len(set(ws)) / max(len(ws), 1)
        }
        names = [*ws, *(f" {name} {int(10 * x)}" for name, x in looks.items())]
        want = spark.createDataFrame([(x,) for x in names], "x string").select(mixing.bucket(F.col("x"), 1 << 30).alias("b")).distinct()
        assert set(df.collect()[i].got) == {r.b for r in want.collect()}


def licenses_by_hand(ws, k=4, gap=6, least=0.5):
    """labels, score and spans of one text: every k-gram of a notice against every place, diagonal by diagonal."""
    base = {label for phrase, label in PHRASES for p in [phrase.split()] for i in range(len(ws)) if ws[i : i + len(p)] == p}
    spans = []
    for label, text in NOTICES:
        t = text.split()
        n = min(k, len(t))
        hits = [
            (i - j, i, j) for j in range(len(t) - n + 1) for i in range(len(ws) - n + 1) if ws[i] == t[j] and ws[i : i + n] == t[j : j + n]
        ]
        groups, before = [], None
        for d, i, j in sorted(hits):
            if before is None or d - before > gap:
                groups.append([])
            groups[-1].append((i, j))
            before = d
        for g in groups:
            share = len({x for _, j in g for x in range(j, j + n)}) / len(t)
            if share >= least:
                spans.append((label, min(i for i, _ in g), max(i for i, _ in g) + n - 1, share))
    score = max((s[3] for s in spans), default=0.5 if base else 0.0)
    return ",".join(sorted(base | {s[0] for s in spans})), score, sorted(spans)


def test_license_labels_spans_and_scores_by_brute_force(spark):
    rng = random.Random(11)
    filler = "the software is data of this work under a for and lorem ipsum dolor mit license gnu".split()
    rows = []
    for i in range(300):
        own = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(NOTICES)[1].split()
            a = rng.randrange(len(t))
            piece = t[a : a + rng.randrange(3, len(t) + 3)] if rng.random() < 0.5 else list(t)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(piece) + 1)
                piece[at : at + rng.randrange(3)] = rng.choices(filler, k=rng.randrange(4))
            own += rng.choices(filler, k=rng.randrange(12)) + piece
        rows.append((i, " ".join(own)))
    got = {
        r.doc_id: (
            r.labels, pytest.approx(r.score), [tuple(s)[:3] + (pytest.approx(s["share"]),) for s in r.spans]
        ) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    want = {i: licenses_by_hand(t.split()) for i, t in rows}
    assert {i: w for i, w in want.items()} == got and sum(bool(w[2]) for w in want.values()) > 100
