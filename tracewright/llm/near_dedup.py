"""Near duplicates by banded MinHash, odd sketches, and exact confirmation on full shingle sets.

1. Every document gets its distinct shingles' MinHash samples, the samples' bands, and an odd sketch: each sample sets
   or clears (parity) one bit of a bitmap, so the bits in which two bitmaps differ tell how many samples differ, which
   is precise for high similarities. A second, larger odd sketch takes the whole set in: with the sets' sizes its
   differing bits tell the similarity to about a hundredth, or nothing of very large differences: how far they may lie
   above what the threshold allows follows from the sizes. Documents with the same words are one class from here on.
2. Classes that share a band are candidates. In each bucket all members meet a hub, another one in each band; the
   sketches choose each member's best hubs, and only these pairs are confirmed on the full sets.
3. Members that confirmed links have joined are one component and need no comparing. What is left, members of one bucket
   in different components, is compared by sketch (the smaller components' members with the others), the likeliest
   pairs are confirmed, and so on until no pair is left that could link two components: nothing is lost to the hubs.

No bucket is expanded into its pairs: a join's condition holds sketch, size and component, and only survivors leave it.
Joins on several keys are hinted to merge. Broadcast, a table keyed by anything but one long takes a page of 64 MB of the
driver's heap however few its rows are, and keeps it until the driver happens to collect its garbage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.components import components

#: Words in a shingle; bands and rows (a pair at 0.85 is missed once in 4e7); bits of the odd sketch.
WORDS, BANDS, ROWS, BITS = 5, 30, 5, 512
#: Bits of the odd sketch of a whole set, and by how many standard deviations they may differ more than expected at the threshold.
SET_BITS, SET_DEVIATIONS = 2048, 5
#: Texts whose bits and samples are laid out at once, and words whose hashes a task remembers.
AT_ONCE, KNOWN = 512, 50_000
#: Members of a bucket that one task compares with as many others.
GRID = 256
_SCHEMA = "doc_id long, text_hash long, node long, n_shingles long, bands array<long>, sketch array<long>, parity array<long>"
_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_14)
    return (
        rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1
    ).astype(np.uint32), rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def signatures(texts: list[str], hashes: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """For each text: a hash of its words, its number of distinct shingles, its bands' hashes and its two odd sketches. hashes: the words seen so far.

    However short the texts of a block are, and so however many, only AT_ONCE of them are laid out as counts of bits.
    """
    parts = [_signatures(texts[i : i + AT_ONCE], hashes) for i in range(0, len(texts) or 1, AT_ONCE)]
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _signatures(texts: list[str], hashes: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    if len(hashes) > KNOWN:
        hashes.clear()
    cut = [x.encode().lower().split() for x in texts]  # bytes: ASCII letters and ASCII white space only
    for w in set().union(*cut).difference(hashes):
        hashes[w] = xxhash.xxh3_64_intdigest(w)
    get = hashes.__getitem__
    own, whole = [], np.zeros(len(texts), dtype=np.int64)
    with np.errstate(over="ignore"):
        for i, words in enumerate(cut):
            whole[i] = np.int64(xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63)
            h = np.fromiter(map(get, words), dtype=np.uint64, count=len(words))
            if len(h) >= WORDS:
                n = len(h) - WORDS + 1
                s = h[:n].copy()
                for j in range(1, WORDS):
                    s = s * _C + h[j : j + n]
                own.append(np.unique(_mix(s)))
            elif len(h):
                own.append(np.array([whole[i]]).view(np.uint64))
            else:
                own.append(np.zeros(0, dtype=np.uint64))
        counts = np.array([len(x) for x in own])
        full = np.flatnonzero(counts)
        bands, sketch = np.zeros((len(texts), BANDS), dtype=np.int64), np.zeros((len(texts), BITS // 64), dtype=np.int64)
        parity = np.zeros((len(texts), SET_BITS // 64), dtype=np.int64)
        if len(full):
            every = np.concatenate(own)
            bit = np.repeat(np.arange(len(full)), counts[full]) * SET_BITS + (every % np.uint64(SET_BITS)).astype(np.int64)
            parity[full] = np.packbits(
                (np.bincount(bit, minlength=len(full) * SET_BITS) & 1).astype(np.uint8).reshape(len(full), SET_BITS), axis=1
            ).view(np.int64)
            x = (every >> np.uint64(32)).astype(np.uint32)
            starts = (np.cumsum(counts) - counts)[full]
            a, b = _permutations()
            least = np.empty((len(full), BANDS * ROWS), dtype=np.uint64)
            for k in range(BANDS * ROWS):
                least[:, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
            grid = least.reshape(len(full), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _C, grid.shape[:2]).copy()
            for r in range(ROWS):
                key = _mix(key * _C + grid[:, :, r])
            bands[full] = key.view(np.int64)
            at = _mix(least * _C + np.arange(BANDS * ROWS, dtype=np.uint64)) % np.uint64(BITS)
            odd = np.bincount((np.arange(len(full))[:, None] * BITS + at.astype(np.int64)).ravel(), minlength=len(full) * BITS) & 1
            sketch[full] = np.packbits(odd.astype(np.uint8).reshape(len(full), BITS), axis=1).view(np.int64)
    return whole, counts, bands, sketch, parity


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (the words' hash), n_shingles, bands, sketch, parity of each row."""

    def run(batches):
        hashes: dict[bytes, int] = {}
        for table in common.text_blocks(batches, 1 << 20):
            node, n, bands, sketch, parity = signatures(table.column("text").to_pylist(), hashes)
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.int64()))
            yield from pa.table(
                {
                    "doc_id": table.column("doc_id"),
                    "text_hash": table.column("text_hash"),
                    "node": node,
                    "n_shingles": pa.array(n, pa.int64()),
                    "bands": lists(bands),
                    "sketch": lists(sketch),
                    "parity": lists(parity)
                }
            ).to_batches()

    return docs.mapInArrow(run, _SCHEMA)


def set_differ(a: Column, b: Column) -> Column:
    """The bits in which the whole sets' odd sketches differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SET_BITS // 64)), F.lit(0))


def set_estimate(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Similarity from the whole sets' odd sketches: their differing bits tell the size of the difference. Noise near saturation: it orders pairs only."""
    size = -SET_BITS / 2.0 * F.log(F.greatest(1.0 - 2.0 * set_differ(a, b) / SET_BITS, F.lit(1e-3)))
    sizes = (n_a + n_b).cast("double")
    return (sizes - size) / (sizes + size)


def set_may_reach(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether the whole sets' odd sketches leave it open that two sets are this similar.

    The sizes give the largest difference that the threshold allows, and that gives mean and variance of the differing
    bits (of d throws into k bits those hit oddly often). More than five deviations above the mean rules a pair out, and
    so does more than the difference itself. With differences much over k nothing is ruled out: half of the bits differ.
    """
    k, most = float(SET_BITS), F.floor((n_a + n_b) * (100 - percent) / (100 + percent)).cast("double")
    left = F.exp(most * math.log(1 - 2 / k))
    mean, variance = k / 2 * (1 - left), (k + k * (k - 1) * F.exp(most * math.log(1 - 4 / k)) - k * k * left * left) / 4
    return set_differ(a, b) <= F.least(most, F.ceil(mean + SET_DEVIATIONS * F.sqrt(F.greatest(variance, F.lit(0.0)))))


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two texts from the bits in which their odd sketches differ: 1 + (bits / 4k) ln(1 - 2 d / bits)."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    left = F.greatest(1.0 - 2.0 * differ / BITS, F.lit(1e-3))
    return 1.0 + BITS / (4.0 * BANDS * ROWS) * F.log(left)


def alike_sizes(a: Column, b: Column, percent: int) -> Column:
    """Two sets can only be this similar if the smaller one has its share of the larger one."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def shingles(text: Column) -> Column:
    """The distinct shingles' hashes of a text, as the definition has them."""

    def made(ws: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(ws) - WORDS), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(WORDS))))
        return F.when(F.size(ws) >= WORDS, F.array_distinct(cut)).otherwise(F.array(F.xxhash64(F.array_join(ws, " "))))

    return common.let(common.space_words(common.lowered(text)), made)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, most: int = 64) -> DataFrame:
    """pairs (a, b), already written, with linked: whether 100 * intersection >= percent * union of the full sets.

    The text of a travels to b. An end of many pairs has its text in a place for each `most` of them, so no task holds
    all pairs of a hub.
    """
    both, places = pairs.select("a", "b"), {}
    for end, other in (("a", "b"), ("b", "a")):
        places[end] = pairs.groupBy(end).agg(F.ceil(F.count("*") / most).cast("int").alias("places"))
        both = both.join(places[end], end).withColumn(f"at_{end}", F.pmod(F.xxhash64(other), F.col("places")).cast("int")).drop("places")
    for end in ("a", "b"):
        own = texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")).join(places[end], end)
        own = own.withColumn(f"at_{end}", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
        both = both.join(own.hint("merge"), [end, f"at_{end}"])
    sets = both.select("a", "b", shingles(F.col("text_a")).alias("x"), shingles(F.col("text_b")).alias("y"))
    common_n = F.size(F.array_intersect("x", "y"))
    return sets.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), common_n.alias("n")).select(
        "a", "b", (100 * F.col("n") >= percent * (F.col("nx") + F.col("ny") - F.col("n"))).alias("linked")
    )


def _best(pairs: DataFrame, by: list[str], most: int) -> DataFrame:
    """The likeliest pairs of each group; one row a pair."""
    order = Window.partitionBy(*by).orderBy(F.desc("estimate"), "b")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after these further links: components of the labels that they join, not of all links again."""
    if label is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(
            label.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left"
        ).withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    ends = common.written(ends.select("label_a", "label_b"), "label-links")
    moved = components(ends, "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("to"))
    ends = ends.select(F.explode(F.array("label_a", "label_b")).alias("label")).distinct().select(F.col("label").alias("node"), "label")
    every = label.unionByName(ends.join(label, "node", "left_anti"))  # nodes that had no link before are their own labels
    return common.written(every.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def find_components(classes: DataFrame, texts_of, percent: int, least: float, rounds: int = 1) -> DataFrame | None:
    """node, label of all classes that confirmed links join (None without any link): all that bands and full sets link.

    classes: node, n_shingles, bands, sketch, parity, already written. texts_of(nodes): node and text of these. The first
    `rounds` take each member's two likeliest pairs with every other component, the last round takes all that are left.
    """
    members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bucket", "node").alias("order"), "node")).alias("hub")
    ).where(F.col("n") > 1)
    shared = common.written(members.join(buckets.select("bucket", F.col("hub.node").alias("hub")), "bucket"), "shared-buckets")
    texts = common.written(texts_of(shared.select("node").distinct()), "candidate-texts")
    about = classes.select("node", "n_shingles", "sketch", "parity")
    side = lambda name: about.select(
        F.col("node").alias(name),
        F.col("n_shingles").alias(f"n_{name}"),
        F.col("sketch").alias(f"sketch_{name}"),
        F.col("parity").alias(f"parity_{name}")
    )
    met = shared.where(F.col("node") != F.col("hub")).select(
        F.col("node").alias("a"), F.col("hub").alias("b")
    ).distinct().join(side("a"), "a").join(side("b"), "b")
    met = met.where(alike_sizes(F.col("n_a"), F.col("n_b"), percent)).where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= least)
    sets = set_estimate(F.col("parity_a"), F.col("parity_b"), F.col("n_a"), F.col("n_b"))
    may_reach = set_may_reach(F.col("parity_a"), F.col("parity_b"), F.col("n_a"), F.col("n_b"), percent)
    met = met.where(may_reach).select("a", "b", sets.alias("estimate"))
    tested = more = common.written(confirm(common.written(_best(met, ["a"], 1).select("a", "b"), "pairs"), texts, percent), "tested")
    label = None
    for turn in range(rounds + 1):
        links = more.where("linked").select("a", "b")
        if links.take(1):
            label = joined(label, links)
        if turn == 0 or links.take(1):
            labelled = shared.select("bucket", "node")
            labelled = labelled.join(label, "node", "left").select(
                "bucket", "node", F.coalesce("label", "node").alias("label")
            ) if label is not None else labelled.withColumn("label", F.col("node"))
            labelled = common.written(labelled, "labelled-buckets")
            # The buckets whose members are in several components, and the component that most are in.
            sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
            mixed = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where(F.col("k") > 1).select(
                "bucket", F.col("top.label").alias("top"), F.ceil(F.col("n") / GRID).cast("int").alias("parts")
            )
            left = common.written(
                labelled.join(mixed, "bucket").join(classes.select("node", "n_shingles", "sketch", "parity", "bands"), "node"),
                "mixed-buckets"
            )
            # A large bucket is a grid: its members are dealt into parts, and each part of a meets each part of b in a task of its own.
            part, every = F.pmod(
                F.xxhash64("bucket", "node"), F.col("parts")
            ).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            a = left.where(F.col("label") != F.col("top")).select(
                "bucket",
                part.alias("i"),
                every.alias("j"),
                F.col("node").alias("a"),
                F.col("label").alias("label_a"),
                F.col("top"),
                F.col("n_shingles").alias("n_a"),
                F.col("sketch").alias("sketch_a"),
                F.col("parity").alias("parity_a"),
                F.col("bands").alias("bands_a")
            )
            b = left.select(
                "bucket",
                every.alias("i"),
                part.alias("j"),
                F.col("node").alias("b"),
                F.col("label").alias("label_b"),
                F.col("n_shingles").alias("n_b"),
                F.col("sketch").alias("sketch_b"),
                F.col("parity").alias("parity_b"),
                F.col("bands").alias("bands_b")
            )
            once = (F.col("label_b") == F.col("top")) | (F.col("a") < F.col("b"))  # two members outside the top component meet once
            first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True))
            here = F.get(  # a pair that meets in several buckets leaves the first of them alone
                "bands_a", first.cast("int") - 1
            ) == a.bucket
            close = a.join(
                b.hint("merge"),
                (a.bucket == b.bucket) & (a.i == b.i) & (a.j == b.j) & (F.col("label_a") != F.col("label_b")) & once & alike_sizes(F.col("n_a"), F.col("n_b"), percent) & (
                    estimate(F.col("sketch_a"), F.col("sketch_b")) >= least
                ) & may_reach & here
            )
            # Dealt by pair: later joins read what tasks wrote, and a grid's tasks find very different numbers of pairs.
            close = common.written(
                close.select("a", "b", "label_b", sets.alias("estimate")).repartition(common.partitions(close.sparkSession), "a", "b"),
                "close-pairs"
            )
        known = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        fresh = close.join(known.hint("merge"), ["a", "b"], "left_anti")
        fresh = _best(fresh, ["a", "label_b"], 2) if turn < rounds else fresh
        more = common.written(confirm(common.written(fresh.select("a", "b"), "pairs"), texts, percent), "tested")
        if not more.take(1):
            break
        tested = tested.unionByName(more)
    links = more.where("linked").select("a", "b")
    return joined(label, links) if links.take(1) else label


def near_duplicates(docs: DataFrame, percent: int = 85, margin: float = 0.15) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each row of docs (doc_id, text; others are ignored).

    component_id: the least doc_id that links reach; kept: whether it is the row's own. Texts without words, null ones
    too, have an empty set and are linked with nothing, each its own component. Repeated rows are copies of each
    other and share component and verdict. A null doc_id comes after all others: such a row gives way to any row with an
    id, and where links reach no id the component_id is null and all of its rows are kept. margin: how far a sketch's
    estimate may fall below the threshold before a pair is left unconfirmed (five standard deviations). An empty table
    gives an empty result.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    signed = common.written(sign(docs), "signatures")
    classes = signed.where(F.col("n_shingles") > 0).groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("text_hash", "doc_id", "n_shingles", "bands", "sketch", "parity")).alias("x")
    )
    classes = common.written(
        classes.select("node", "first", F.col("x.doc_id").alias("one"), "x.text_hash", "x.n_shingles", "x.bands", "x.sketch", "x.parity"),
        "classes"
    )

    def texts_of(nodes: DataFrame) -> DataFrame:
        """One row of each class gives its text, so a text of many copies is no hot key."""
        wanted = classes.join(nodes, "node", "left_semi").select("one", F.col("text_hash").alias("hash"), "node")
        return docs.join(
            wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("one")) & (F.col("text_hash") == F.col("hash"))
        ).groupBy("node").agg(F.min("text").alias("text"))

    label = find_components(classes, texts_of, percent, percent / 100 - margin)
    firsts = classes.select("node", "first")
    if label is not None:
        both = firsts.join(label, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
        least = both.groupBy("label").agg(F.min("first").alias("component_id"))
        firsts = both.join(least, "label").select("node", "component_id")
    else:
        firsts = firsts.withColumnRenamed("first", "component_id")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(firsts, "node", "left")
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
