"""Benchmark decontamination by winnowing, in Spark's own expressions.

Texts are cut into words; every `k` consecutive words have a hash, and of every `w` consecutive hashes the least is
kept as a fingerprint, with its place. Any span of k + w - 1 words that two texts share holds a fingerprint of both at
the same place of the span, so with k + w - 1 = SPAN no shared span of SPAN words is missed. Fingerprints of documents
and items are joined on the hash; each hit is extended to the spans that hold it, and these are compared word for word
with the items' spans. Items shorter than SPAN are one window; for their few lengths (at most SPAN - 1) the hashes of
all places of the documents are probed, and strings are made of hits only.

The fingerprints (a third of the words) are exploded, and a hash for each place and short length that the benchmark has;
only hits are shuffled, and the benchmark's side is broadcast only where Spark's own size limit
(spark.sql.autoBroadcastJoinThreshold) admits it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

SPAN = 10


def gram_hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def fingerprints(words: Column, k: int, w: int) -> Column:
    """Array of (h, i): hashes that are the least of some window of w, with their places; of ties all are kept."""
    empty = F.array().cast("array<struct<h:bigint,i:int>>")

    def chosen(h: Column) -> Column:
        least = F.when(
            F.size(h) >= w, F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.least(*(F.get(h, i + j) for j in range(w))))
        ).otherwise(F.array(F.array_min(h)))

        def pick(m: Column) -> Column:
            is_least = lambda j: F.coalesce(
                *(F.when(F.get(m, j - d) == F.get(h, j), F.lit(True)) for d in range(w)), F.lit(False)
            )
            own = F.filter(
                F.sequence(F.lit(0), F.size(h) - 1),
                lambda j: F.when(F.size(h) >= w, is_least(j)).otherwise(F.get(m, F.lit(0)) == F.get(h, j))
            )
            return F.transform(own, lambda j: F.struct(F.get(h, j).alias("h"), j.alias("i")))

        return common.let(least, pick)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: gram_hash(words, i, k))
    return F.when(F.size(words) >= k, common.let(hashes, chosen)).otherwise(empty)


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, length and text of each item's distinct windows."""
    cut = items.select(
        F.col("item_id").cast("string").alias("item_id"), common.words(F.col("text")).alias("words")
    ).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    length = F.least(F.size("words"), F.lit(span))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    made = F.transform(starts, lambda i: F.array_join(F.slice(F.col("words"), i + 1, length), " "))
    return cut.select("item_id", length.alias("length"), F.explode(F.array_distinct(made)).alias("window"))


def find_hits(docs: DataFrame, items: DataFrame, short: list[int], k: int, w: int) -> DataFrame:
    """doc_id, text_hash, and the places `at` (n, i) at which a document has an item's fingerprint (n = 0) or, by hash, a short item of n words."""
    cut = items.where(F.col("item_id").isNotNull()).select(common.words(F.col("text")).alias("words"))
    long = cut.where(F.size("words") >= k + w - 1).select(
        F.lit(0).alias("n"), F.explode(fingerprints(F.col("words"), k, w)["h"]).alias("h")
    )
    marks = [
        long,
        *(cut.where(F.size("words") == n).select(F.lit(n).alias("n"), gram_hash(F.col("words"), F.lit(0), n).alias("h")) for n in short)
    ]
    marks = reduce(DataFrame.unionByName, marks).distinct()

    def probes(ws: Column) -> Column:
        entry = lambda n, h, i: F.struct(F.lit(n).alias("n"), h.alias("h"), i.alias("i"))
        probe = lambda n: lambda i: entry(n, gram_hash(ws, i, n), i)
        own = [F.transform(fingerprints(ws, k, w), lambda f: entry(0, f["h"], f["i"]))]
        for n in short:
            places = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
            own.append(F.transform(places, probe(n)))
        return F.concat(*own)

    own = docs.select(
        "doc_id", "text_hash", F.explode(common.let(common.words(F.col("text")), probes)).alias("f")
    ).select("doc_id", "text_hash", "f.*")
    return own.join(marks, ["n", "h"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("n", "i")).alias("at"))


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 6, span: int = SPAN) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids of each row of docs (doc_id, text; others are ignored).

    Null texts have no words, hence no hits. Items without words or with a null id are ignored; repeated items count
    by their distinct ids. Repeated rows give equal rows, one each; a null doc_id is a value like any other. An empty
    benchmark and an empty table contaminate nothing. Texts are whole however long they are. Only documents with hits have their spans cut and compared; the others meet them at
    the end, by their own keys.
    """
    w = span - k + 1
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    windows = item_windows(items, span)
    short = sorted(  # at most span - 1 numbers
        r.length for r in windows.where(F.col("length") < span).select("length").distinct().collect()
    )
    hits = find_hits(docs, items, short, k, w).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "at")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))

    def candidates(ws: Column) -> Column:
        """The spans around fingerprints' hits, and the short ones that were hit."""
        entry = lambda s, n: F.struct(
            s.cast("int").alias("s"), n.cast("int").alias("length"), F.array_join(F.slice(ws, s + 1, n), " ").alias("window")
        )
        around = F.flatten(F.transform(F.filter("at", lambda p: p["n"] == 0), lambda p: F.sequence(p["i"] - (w - 1), p["i"])))
        starts = F.filter(F.array_distinct(around), lambda s: (s >= 0) & (s <= F.size(ws) - span))
        return F.concat(
            F.transform(starts, lambda s: entry(s, F.lit(span))),
            F.transform(F.filter("at", lambda p: p["n"] > 0), lambda p: entry(p["i"], p["n"]))
        )

    spans = docs.join(hits, same).select(
        "doc_id", "text_hash", F.explode(common.let(common.words(F.col("text")), candidates)).alias("c")
    ).select("doc_id", "text_hash", "c.*")
    known = windows.groupBy("length", "window").agg(F.collect_set("item_id").alias("item_ids"))
    checked = spans.join(known, ["length", "window"])
    # Spans in order: each adds the words that those before it have not covered.
    one = F.struct(F.col("s"), (F.col("s") + F.col("length")).alias("e"))
    grouped = checked.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(one)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n")
    )
    found = grouped.select(
        F.col("doc_id").alias("hit_id"),
        F.col("text_hash").alias("hit_hash"),
        F.aggregate("spans", zero, step, lambda acc: acc["n"]).cast("long").alias("n_hit"),
        "item_ids"
    )
    rows = docs.select("doc_id", "text_hash", F.size(common.words(F.col("text"))).cast("long").alias("n_words")).join(found, same, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        ids.alias("item_ids"),
        F.size(ids).cast("long").alias("n_items")
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[j:j + least(len(ws), 10) - 1], ' ') AS k FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(j) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT uid, s, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM d, ns, unnest(range(1, len(ws) - n + 2)) AS r(s)),
h AS (SELECT uid, s, n, item_id FROM dw JOIN iw USING (n, k)),
c AS (SELECT uid, count(DISTINCT s + j) AS n_hit FROM (SELECT DISTINCT uid, s, n FROM h), unnest(range(n)) AS r(j) GROUP BY uid),
t AS (SELECT uid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY uid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (uid) LEFT JOIN t USING (uid)
"""
