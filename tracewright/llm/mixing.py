"""Mixing sources to target weights by soft membership, in Spark's own expressions.

The labels table names each labelled document's domain. A naive-Bayes classifier over hashed words (its table of
`buckets` x domains log ratios is the only thing that reaches the driver, whatever the input) gives every
document posteriors over the domains.

The objective: with rates r >= 0, one a document, and A r their expected tokens by domain (rate x tokens x posterior,
summed), the least sum of (r - 1)^2 among all r whose A r are the targets; where no rates meet them, of all r whose A r
come nearest to the targets, each domain's error relative to its target. At the solution r is a projected gradient step
from one, max(0, 1 - A'y). Its multipliers y, one a domain, solve the convex dual and are found by Newton steps, each
one aggregate of a few sums over all documents; documents that need no change keep their rate.
"""

from __future__ import annotations

import json
import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common


#: Pseudo-counts for each bucket, shared out as the whole corpus has them, and what is taken off each log ratio (noise).
SMOOTH, SHRINK = 0.02, 0.35


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def tokens_of(text: Column) -> Column:
    """Words in lower case, as the classifier and the token counts take them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), common.NON_WORD), lambda w: w != F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern of one character is found: the pieces between, less one. regexp_count copies every match."""
    return F.size(F.split(F.coalesce(text, F.lit("")), pattern, -1)) - 1


def features(text: Column, words: Column, buckets: int) -> Column:
    """A text's distinct buckets: of its words, and of a few of its looks (symbols, stops, capitals, digits, repeats), each in tenths."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: matches(text, pattern) / F.coalesce(n, F.lit(1))
    distinct = F.array_distinct(F.transform(words, lambda w: bucket(w, buckets)))

    def with_looks(own: Column) -> Column:
        looks = {
            "symbols": share(r"[#*$%&|<>@^~={}\[\]\\/]"),
            "stops": 4 * share("[.,;:!?]"),
            "capitals": share("[A-Z]"),
            "digits": share("[0-9]"),
            "distinct": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
        }
        return F.array_union(
            own, F.array(*(bucket(F.concat(F.lit(f" {name} "), F.floor(10 * x).cast("string")), buckets) for name, x in looks.items()))
        )

    return common.let(distinct, with_looks)


def train_domains(
    docs: DataFrame, labelled: DataFrame, buckets: int = 1 << 15, most_rows: int = 20_000
) -> tuple[list[str], list[float], list[list[float]]]:
    """Domains, their log priors, and each domain's log ratio to the whole corpus by bucket, from at most `most_rows` labelled documents.

    labelled: doc_id, domain, one row an id; those with the least hashes are the sample. Its ids are broadcast (most_rows
    bounds them), so texts are not shuffled. Words are counted in Spark; what is collected has at most buckets rows for
    each domain.
    """
    labelled = F.broadcast(labelled.select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(labelled, "doc_id")
    words = small.select(
        "domain", F.explode(common.let(tokens_of(F.col("text")), lambda ws: features(F.col("text"), ws, buckets))).alias("b")
    )
    counts = words.groupBy("domain", "b").count().collect()
    priors = {r["domain"]: r["count"] for r in small.groupBy("domain").count().collect()}
    domains = sorted(priors)
    total = sum(priors.values())
    seen = [[0] * buckets for _ in domains]
    for r in counts:
        seen[domains.index(r["domain"])][r["b"]] = r["count"]
    share = [(sum(own) + 0.5) for own in zip(*seen, strict=True)] if domains else []
    every = sum(share)
    table = []
    for own in seen:
        n = sum(own)
        ratios = [
            math.log((c + SMOOTH * s / every * buckets) * every / ((n + SMOOTH * buckets) * s)) for c, s in zip(own, share, strict=True)
        ]
        table.append([math.copysign(max(abs(x) - SHRINK, 0.0), x) for x in ratios])
    return domains, [math.log(priors[d] / total) for d in domains], table


def posteriors(docs: DataFrame, model, temperature: float = 1.0) -> DataFrame:
    """doc_id, text_hash, n_tokens and p, the posteriors in the order of the model's domains.

    Each distinct bucket of a text adds its log ratio; a text without words has the priors.
    """
    domains, prior, table = model
    buckets = len(table[0])
    flat = [F.from_json(F.lit(json.dumps([round(x, 4) for x in row])), "array<double>") for row in table]  # folded to a constant

    def scored(ws: Column) -> Column:
        def of(bs: Column) -> Column:
            add = lambda k: lambda acc, b: acc + F.get(flat[k], b)
            return F.array(*(F.lit(prior[k]) + temperature * F.aggregate(bs, F.lit(0.0), add(k)) for k in range(len(domains))))

        return F.struct(F.size(ws).cast("long").alias("n_tokens"), common.let(features(F.col("text"), ws, buckets), of).alias("logs"))

    def normal(logs: Column) -> Column:
        top = F.array_max(logs)
        return common.let(
            F.transform(logs, lambda x: F.exp(x - top)),
            lambda es: F.transform(es, lambda e: e / F.aggregate(es, F.lit(0.0), lambda a, x: a + x))
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        common.let(tokens_of(F.col("text")), scored).alias("x")
    )
    return rows.select("doc_id", "text_hash", "x.n_tokens", common.let(F.col("x.logs"), normal).alias("p"))


def expected_totals(rows: DataFrame, k: int, rate: Column) -> list[float]:
    """Expected tokens of each domain at these rates: one aggregate."""
    sums = rows.agg(
        *(F.coalesce(F.sum(rate * F.col("n_tokens") * F.get("p", F.lit(d))), F.lit(0.0)).alias(f"s{d}") for d in range(k))
    ).first()
    return [float(x) for x in sums]


def fit_rates(rows: DataFrame, targets: list[float], steps: int = 60, tolerance: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """rows with a column rate >= 0, and the totals it gives.

    rows: n_tokens and p, already written. Of the nonnegative rates that meet the targets those nearest to one are a
    projected gradient step from one, rate = max(0, 1 - gradient), whose k multipliers solve the convex dual problem:
    Newton steps on the rates that are not at zero, halved until the dual falls, which converges from anywhere. Each is
    one aggregate. Targets that no rates meet give their least-squares totals, or what `steps` reach: compare the totals.
    """
    k = len(targets)
    scale = [1.0 / max(t, 1.0) for t in targets]
    part = [F.col("n_tokens").cast("double") * F.get("p", F.lit(d)) * scale[d] for d in range(k)]
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    rate_at = lambda y: F.greatest(F.lit(0.0), 1.0 - sum((part[d] * y[d] for d in range(k)), F.lit(0.0)))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)

    def measured(y: list[float]) -> tuple[list[float], list[list[float]], float]:
        at = rows.withColumn("rate", rate_at(y))
        free = F.when(F.col("rate") > 0, 1.0).otherwise(0.0)
        x = at.agg(
            *(total(F.col("rate") * part[d], f"s{d}") for d in range(k)),
            *(total(free * part[a] * part[b], f"m{a}_{b}") for a, b in cells),
            total(F.col("rate") * F.col("rate"), "square")
        ).first()
        return [x[f"s{d}"] - targets[d] * scale[d] for d in range(k)], [
            [x[f"m{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)
        ], x["square"] / 2

    y = [0.0] * k
    residual, normal, square = measured(y)
    little = 1e-9 * max([normal[d][d] for d in range(k)] + [1e-300])  # keeps the multipliers finite where no rates meet the targets
    dual = lambda y, square: square + sum(y[d] * targets[d] * scale[d] + little / 2 * y[d] ** 2 for d in range(k))
    for _ in range(steps):
        slope = [residual[d] - little * y[d] for d in range(k)]
        if max(map(abs, residual)) <= tolerance or max(map(abs, slope)) <= 1e-12:
            break
        inverse = _preconditioner([[normal[a][b] + (little if a == b else 0.0) for b in range(k)] for a in range(k)])
        move = [sum(inverse[a][b] * slope[b] for b in range(k)) for a in range(k)]
        fall, now = sum(m * g for m, g in zip(move, slope, strict=True)), dual(y, square)
        for half in range(30):
            there = [v + m / 2**half for v, m in zip(y, move, strict=True)]
            found = measured(there)
            if dual(there, found[2]) <= now - 1e-4 * fall / 2**half + 1e-12 * abs(now):
                break
        else:
            break  # no fall that doubles can show
        y, (residual, normal, square) = there, found
    return rows.withColumn("rate", rate_at(y)), [residual[d] / scale[d] + targets[d] for d in range(k)]


def snap_rates(
    rows: DataFrame, targets: list[float], totals: list[float], snap: float, tolerance: float = 1e-3
) -> tuple[DataFrame, list[float]]:
    """rows with rates within `snap` of a whole number at that number, and the totals that they give then.

    snap is halved as often as it takes to keep the totals within tolerance of the targets (or as near as they were).
    """
    k, widths = len(targets), [*(snap / 2**i for i in range(8)), 0.0]
    near = F.rint("rate")
    snapped = lambda width: F.when(F.abs(F.col("rate") - near) <= width, near).otherwise(F.col("rate"))
    worst = lambda sums: max((abs(x - t) / max(t, 1.0) for x, t in zip(sums, targets, strict=True)), default=0.0)
    most = max(tolerance, worst(totals) * (1 + 1e-9))
    x = rows.agg(
        *(
            F.coalesce(F.sum(snapped(w) * F.col("n_tokens") * F.get("p", F.lit(d))), F.lit(0.0)).alias(f"s{i}_{d}") for i,
            w in enumerate(widths) for d in range(k)
        )
    ).first()
    sums = [[x[f"s{i}_{d}"] for d in range(k)] for i in range(len(widths))]
    i = next((i for i, own in enumerate(sums) if worst(own) <= most), len(widths) - 1)
    return rows.withColumn("rate", snapped(widths[i])), sums[i]


def _preconditioner(m: list[list[float]]) -> list[list[float]]:
    """Inverse of a small positive matrix with a little on its diagonal: the step for each direction of the residual."""
    k = len(m)
    top = max([m[i][i] for i in range(k)] + [1e-300])
    a = [[m[i][j] + (1e-9 * top if i == j else 0.0) for j in range(k)] + [float(i == j) for j in range(k)] for i in range(k)]
    for i in range(k):
        p = max(range(i, k), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(k):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[k:] for row in a]


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], buckets: int = 1 << 15, tokens: float | None = None, snap: float = 0.05
) -> DataFrame:
    """doc_id, text_hash, n_tokens, domain posteriors (map), rate, copies, residual of each row of docs (doc_id, text).

    weights: each domain's share of the mix, relative to its present expected tokens if `tokens` is None (1.0 keeps a
    domain as it is), else to `tokens` in all. copies: the rate with its fraction decided by a hash of the id; a rate
    within `snap` of a whole number is that number, as far as totals stay within a thousandth of their targets (else `snap`
    is halved). residual, the same in all rows: the largest error of a domain's total relative to its target, after
    snapping; above a thousandth no rates met the targets, and the totals reached are logged. Null texts have no tokens and
    keep rate 1. Texts count whole, however long. Without labelled rows there is one domain, "", and every rate is 1.
    Repeated rows get equal rates, an empty table gives an empty result. Other columns of docs are ignored.
    """
    model = train_domains(docs, labelled, buckets)
    domains = model[0]
    if not domains:
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            F.size(tokens_of(F.col("text"))).cast("long").alias("n_tokens")
        )
        return rows.withColumn(
            "posteriors", F.create_map(F.lit(""), F.lit(1.0))
        ).withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1)).withColumn("residual", F.lit(0.0))
    rows = common.written(posteriors(docs, model), "posteriors")
    now = expected_totals(rows, len(domains), F.lit(1.0))
    targets = [weights.get(d, 1.0) * (now[i] if tokens is None else tokens) for i, d in enumerate(domains)]
    rows, totals = fit_rates(rows, targets, tolerance=1e-4)
    rows, totals = snap_rates(rows, targets, totals, snap)
    if missed := {d: (round(x), round(t)) for d, x, t in zip(domains, totals, targets, strict=True) if abs(x - t) > 1e-3 * max(t, 1.0)}:
        logging.getLogger(__name__).warning("expected tokens that miss their targets (reached, target): %s", missed)
    residual = max((abs(x - t) / max(t, 1.0) for x, t in zip(totals, targets, strict=True)), default=0.0)
    rate = F.col("rate")
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")
    named = F.map_from_arrays(F.array(*map(F.lit, domains)), F.col("p"))
    return rows.select(
        "doc_id",
        "text_hash",
        "n_tokens",
        named.alias("posteriors"),
        rate.alias("rate"),
        copies.alias("copies"),
        F.lit(residual).alias("residual")
    )


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: its quality and toxicity marks together. Rows without an id are left out; of several for an id the least domain stands."""
    name = F.concat(
        F.lit("quality"),
        F.coalesce(F.col("quality").cast("string"), F.lit("?")),
        F.lit("_toxic"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("?"))
    )
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(name).alias("domain"))
