"""Product codes of vectors: a codebook for each part of the vectors, learnt by filtering Lloyd rounds.

Components are integers (floor of scale times x), so every sum, distance and tie is exact. Each block of rows (bounded)
builds a kd-tree over the pieces of each part once: every node keeps its bounding box, its count and its sums. A round
carries the entries that may be nearest down the trees. An entry is dropped where the corner of a node's box that suits it
best still is closer to the entry nearest to the box's middle; where one entry is left, the whole subtree is its own at
once. Only sums for each part and entry leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

#: Components beyond this could overflow the sums of squared distances, in parts of up to 1,024 components.
MOST = 1 << 24
#: Labels that are sent to every task; where there are more, rows and labels are shuffled.
FEW_LABELS = 50_000


class Tree:
    """A balanced kd-tree over points (n x d integers). Nodes of a level are runs of about equally many points, kept in that order."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        points = points.astype(np.int64)
        self.order = np.arange(len(points))
        self.cuts = [np.array([0, len(points)])]
        while np.diff(self.cuts[-1]).max() > leaf:
            cuts = self.cuts[-1]
            own = points[self.order]
            node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            low, high = np.minimum.reduceat(own, cuts[:-1]), np.maximum.reduceat(own, cuts[:-1])
            widest = (high - low).argmax(axis=1)
            self.order = self.order[np.lexsort((own[np.arange(len(own)), widest[node]], node))]
            self.cuts.append(np.append(np.stack([cuts[:-1], (cuts[:-1] + cuts[1:]) // 2], axis=1).ravel(), len(points)))
        self.points = points[self.order]
        self._cache()

    def _cache(self) -> None:
        heads = [c[:-1] for c in self.cuts]
        self.low = [np.minimum.reduceat(self.points, h) for h in heads]
        self.high = [np.maximum.reduceat(self.points, h) for h in heads]
        self.sums = [np.add.reduceat(self.points, h) for h in heads]

    def nearest(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of points with the entry nearest to all of them (of several, the first): where they begin and end in self.order, the entry, and their sums."""
        nodes, pairs_of, pair = np.array([0]), np.zeros(len(entries), np.int64), np.arange(len(entries))
        for level, cuts in enumerate(self.cuts):
            low, high = self.low[level][nodes], self.high[level][nodes]
            own = entries[pair]
            # Twice the middle, so that it is whole; pairs stand by node, and by entry within a node.
            far = ((2 * own - (low + high)[pairs_of]) ** 2).sum(axis=1)
            first = np.searchsorted(pairs_of, np.arange(len(nodes)))
            best = pair[_least(far, first)]
            rival = entries[best][pairs_of]
            corner = np.where(own > rival, high[pairs_of], low[pairs_of])
            behind = ((own - corner) ** 2).sum(axis=1) - ((rival - corner) ** 2).sum(axis=1)
            stay = (pair == best[pairs_of]) | (behind < 0) | ((behind == 0) & (pair < best[pairs_of]))
            pairs_of, pair = pairs_of[stay], pair[stay]
            left = np.bincount(pairs_of, minlength=len(nodes))
            done = left == 1
            if done.any():
                n = nodes[done]
                yield cuts[n], cuts[n + 1], pair[done[pairs_of]], self.sums[level][n]
            open_ = ~done
            keep = open_[pairs_of]
            rank = np.cumsum(open_) - 1
            nodes, pairs_of, pair = nodes[open_], rank[pairs_of[keep]], pair[keep]
            if level + 1 < len(self.cuts):
                # Both halves inherit what is left.
                count = np.bincount(pairs_of, minlength=len(nodes))
                starts = np.cumsum(count) - count
                again = np.repeat(count, 2)
                at = common.spread(np.repeat(starts, 2), again)
                nodes, pairs_of, pair = np.stack(
                    [2 * nodes, 2 * nodes + 1], axis=1
                ).ravel(), np.repeat(np.arange(2 * len(count)), again), pair[at]
        if len(nodes):
            yield self._leaves(nodes, pairs_of, pair, entries)

    def _leaves(
        self, nodes: np.ndarray, pairs_of: np.ndarray, pair: np.ndarray, entries: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Point by point, what the boxes of the leaves have left open."""
        cuts = self.cuts[-1]
        size, count = (cuts[nodes + 1] - cuts[nodes]), np.bincount(pairs_of, minlength=len(nodes))
        points = common.spread(cuts[nodes], size)
        of = np.repeat(np.arange(len(nodes)), size)
        at = common.spread((np.cumsum(count) - count)[of], count[of])
        far = ((np.repeat(self.points[points], count[of], axis=0) - entries[pair[at]]) ** 2).sum(axis=1)
        ends = np.cumsum(count[of])
        return points, points + 1, pair[at][_least(far, ends - count[of])], self.points[points]


def _least(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the least value of each run stands, the first of several; first: where the runs begin."""
    least = np.minimum.reduceat(values, first)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    at = np.flatnonzero(values == least[run])
    return at[np.unique(run[at], return_index=True)[1]]


def _whole(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """vec_id, label and the vector's integer components, of rows whose vector holds finite numbers only."""
    kept = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(vector).cast("array<double>").alias("v")
    ).where(kept)
    bound = F.lit(MOST / scale)
    refuse = F.raise_error(F.lit(f"components must lie within {MOST // scale}"))
    return found.select(
        "vec_id",
        "label",
        F.transform("v", lambda x: F.when(F.abs(x) <= bound, F.floor(x * scale).cast("int")).otherwise(refuse.cast("int"))).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} components and of {sizes[sizes != width][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, width)


def _trees(parts: int, width: int, block_rows: int, leaf: int):
    """Blocks of rows with the trees of their parts: the pieces in the trees' order, and that order. Boxes, counts and sums follow from the cuts, which the number of rows gives."""
    schema = pa.schema(
        [
            ("ids", pa.list_(pa.int64())),
            ("labels", pa.list_(pa.string())),
            ("n", pa.int64()),
            ("points", pa.binary()),
            ("orders", pa.binary())
        ]
    )

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(a, block_rows))
                rows += held[-1].num_rows
                if rows >= block_rows:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))

    def block(table):
        v = _matrix(table.column("v").combine_chunks(), width)
        trees = [Tree(x, leaf) for x in np.split(v, parts, axis=1)]
        points, orders = np.stack([t.points for t in trees]), np.stack([t.order for t in trees]).astype("<u4")
        row = {
            "ids": table.column("vec_id").to_pylist(),
            "labels": table.column("label").to_pylist(),
            "n": len(v),
            "points": common.packed(points.astype("<i4")),
            "orders": common.packed(orders)
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    return run, "ids array<long>, labels array<string>, n long, points binary, orders binary"


def _grown(row: dict, parts: int, leaf: int) -> list[Tree]:
    """The trees of a block as written."""
    n = row["n"]
    points = np.frombuffer(common.unpacked(row["points"]), "<i4").reshape(parts, n, -1).astype(np.int64)
    orders = np.frombuffer(common.unpacked(row["orders"]), "<u4").reshape(parts, n)
    cuts = [np.array([0, n])]
    while np.diff(cuts[-1]).max() > leaf:
        c = cuts[-1]
        cuts.append(np.append(np.stack([c[:-1], (c[:-1] + c[1:]) // 2], axis=1).ravel(), n))
    out = []
    for p, o in zip(points, orders, strict=True):
        tree = Tree.__new__(Tree)
        tree.points, tree.order, tree.cuts = p, o, cuts
        tree._cache()
        out.append(tree)
    return out


def _totals(books: np.ndarray, leaf: int):
    """For each part and entry of a block: how many pieces it is nearest to, and their sums."""
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
                for p, tree in enumerate(_grown(row, parts, leaf)):
                    for begin, end, entry, total in tree.nearest(books[p]):
                        np.add.at(counts[p], entry, end - begin)
                        np.add.at(sums[p], entry, total)
                p, e = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p, pa.int32()),
                        pa.array(e, pa.int32()),
                        pa.array(counts[p, e]),
                        pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))
                    ],
                    schema=schema
                )

    return run


def _codes(books: np.ndarray, leaf: int):
    """Each row's entry of every part and the sum of its squared distances."""
    parts, _, _ = books.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.binary()), ("error", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(_grown(row, parts, leaf)):
                    of = np.empty(n, np.int64)
                    for begin, end, entry, _ in tree.nearest(books[p]):
                        of[common.spread(begin, end - begin)] = np.repeat(entry, end - begin)
                    codes[tree.order, p] = of
                    error[tree.order] += ((tree.points - books[p][of]) ** 2).sum(axis=1)
                for a in range(0, n, 8192):
                    z = min(n, a + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["ids"][a:z], pa.int64()),
                            pa.array(row["labels"][a:z], pa.string()),
                            pa.array([c.tobytes() for c in codes[a:z]], pa.binary()),
                            pa.array(error[a:z])
                        ],
                        schema=schema
                    )

    return run


def compress(
    vectors: DataFrame,
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    block_rows: int = 16_384,
    leaf: int = 16
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code (binary, a byte for each part), error) of the kept rows, and the codebooks (parts x entries x width).

    Rows whose vector is null or holds a null or a number that is not finite go. Codebooks begin as the pieces of the rows
    with the least ids (null ids last, equal ids by their components); fewer rows give fewer entries. Ties go to the lower
    index, entries that no piece is nearest to stay. Repeated rows are rows of their own; an empty table gives no rows and
    empty codebooks; other columns are ignored. ValueError if the vectors differ in length or cannot be cut into equal parts,
    an error if a component lies beyond MOST / scale. At most 256 entries. What reaches the driver are the codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = vectors.sparkSession
    label = vectors.schema["label"].dataType
    whole = _whole(vectors, vector, scale)
    order = (F.col("vec_id").asc_nulls_last(), F.col("v").asc())
    first = [r.v for r in whole.orderBy(*order).limit(entries).select("v").collect()]
    schema = "vec_id long, label string, code binary, error long"
    if not first:
        return spark.createDataFrame([], schema).withColumn("label", F.col("label").cast(label)), np.empty((parts, 0, 0), np.int64)
    width = len(first[0])
    if not width or width % parts or any(len(v) != width for v in first):
        raise ValueError(f"vectors must have equally many components, in {parts} equal parts")
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    run, packed = _trees(parts, width, block_rows, leaf)
    trees = common.written(
        whole.select("vec_id", F.col("label").cast("string").alias("label"), "v").mapInArrow(run, packed), "vector-trees"
    )
    d = width // parts
    for _ in range(rounds):
        sums = [F.sum(F.get("sums", k)).alias(f"s{k}") for k in range(d)]
        found = trees.mapInArrow(
            _totals(books, leaf), "part int, entry int, count long, sums array<long>"
        ).groupBy("part", "entry").agg(F.sum("count").alias("count"), *sums)
        books = books.copy()
        for r in found.collect():  # at most parts x entries rows
            books[r.part, r.entry] = [r[f"s{k}"] // r["count"] for k in range(d)]
    codes = trees.mapInArrow(_codes(books, leaf), schema)
    return codes.withColumn("label", F.col("label").cast(label)), books


def with_label_errors(codes: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """The rows of codes with label_error, the sum of the errors of all rows of their label; null is a label, too.

    Sums are made before anything is shuffled. Up to `few` labels they are sent to every task; beyond, rows meet them by a
    shuffle whose large partitions Spark splits. codes is read twice: give it as a written table.
    """
    known, key = F.col("label").isNotNull().alias("known"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key")
    sums = common.written(codes.groupBy(known, key).agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= few else sums
    return codes.withColumns({"known": known, "key": key}).join(side, ["known", "key"]).drop("known", "key")


def code_text(code: Column) -> Column:
    """Two hexadecimal digits for each part."""
    return F.lower(F.hex(code))


def codebooks_sha256(books: np.ndarray) -> str:
    """sha256 of all entries' components as decimal numbers with commas between, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rows of op13 in DuckDB: every part against every entry."""
    nearest = """{name} AS MATERIALIZED (
    SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
        SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.piece, b.piece), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS far FROM pieces p JOIN {book} b ON p.part = b.part
    ) GROUP BY vec_id, part
)"""
    updated = """{name} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.piece, b.piece) AS piece FROM {book} b LEFT JOIN (
        SELECT part, entry, list(middle ORDER BY k) AS piece FROM (
            SELECT n.part, n.entry, u.k, floor(sum(p.piece[u.k])::DOUBLE / count(*))::BIGINT AS middle
            FROM {nearest} n JOIN pieces p ON p.vec_id = n.vec_id AND p.part = n.part, (SELECT unnest(range(1, (SELECT max(len(piece)) FROM pieces) + 1)) AS k) u GROUP BY n.part, n.entry, u.k
        ) GROUP BY part, entry
    ) m ON b.part = m.part AND b.entry = m.entry
)"""
    steps = []
    for r in range(rounds):
        steps += [
            nearest.format(name=f"near{r}", book=f"book{r}"), updated.format(name=f"book{r + 1}", book=f"book{r}", nearest=f"near{r}")
        ]
    steps.append(nearest.format(name="final", book=f"book{rounds}"))
    middle = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
    SELECT vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS piece FROM kept, (SELECT unnest(range({parts})) AS part)
), book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, piece FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), {middle}, coded AS (
    SELECT vec_id, lower(string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part)) AS code, sum(far)::BIGINT AS error FROM final GROUP BY vec_id
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN coded c ON k.vec_id = c.vec_id
"""


#: The rows of op13 in DuckDB.
SQL = _sql()
