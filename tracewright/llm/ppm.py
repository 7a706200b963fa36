"""Prediction by partial matching over bytes, as Spark jobs.

The model is a trie of byte contexts up to `order` bytes, kept as tables: for each context its following symbols and
their counts in the training texts. A symbol's probability starts at the longest context; where the symbol has not
followed it, the model escapes (method C: distinct symbols against all occurrences) to the context without its first
byte, in which the symbols of the longer context are excluded. Excluded counts need no search: the symbols that followed
a context have followed all its suffixes, so sums over them are one join of neighbouring levels.

A text is lower-cased (A-Z), framed by start bytes and an end symbol that UTF-8 never holds, and its score is the sum
over its bytes and its end. With a fixed context length, a symbol's probability is a function of its last order + 1
bytes, so it is found once for each distinct string of that length: blocks of documents (bounded in bytes) ask for the
strings and words they hold, the requests meet the model slot by slot, and the answers return to the blocks. Requests,
answers and counts travel packed, one row for each block and slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

START, END = b"\xfe", b"\xff"
#: The end token's key: a word never holds a space.
END_WORD = xxhash.xxh3_64_intdigest(b" ")
GRAM, WORD = 0, 1
#: Slots of the keys at most: each block has a row for every slot. Beyond, a slot's requests are dealt out to several places.
MOST_SLOTS = 4096
_PACK = "slot int, kind int, keys binary, counts binary, n_keys long, n_sum long"
_ARROW = pa.schema(
    [
        ("slot", pa.int32()),
        ("kind", pa.int32()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
        ("n_keys", pa.int64()),
        ("n_sum", pa.int64())
    ]
)


def grams(texts: list[bytes], order: int) -> np.ndarray:
    """The last order + 1 bytes at each byte and end of the lower-cased texts, as numbers, in order."""
    a = np.frombuffer(b"".join(x for t in texts for x in (START * order, t, END)), dtype=np.uint8)
    if len(a) <= order:
        return np.zeros(0, dtype=np.uint64)
    key = np.zeros(len(a) - order, dtype=np.uint64)
    for j in range(order + 1):
        np.left_shift(key, np.uint64(8), out=key)
        np.bitwise_or(key, a[j : len(a) - order + j], out=key)
    return key[a[order:] != START[0]]


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order, by a sort: np.unique without counts tells them apart by hashes, which takes several times as long."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def by_slot(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the ordered keys goes when they are laid out by slot (order kept within), and the slots' ends."""
    slot = slot_of(keys, slots)
    return np.argsort(slot, kind="stable"), np.cumsum(np.bincount(slot, minlength=slots))


def _texts(table: pa.Table) -> list[bytes]:
    return [(x or "").encode().lower() for x in table.column("text").to_pylist()]  # bytes: A-Z only


class Places(dict):
    """A place for each distinct word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place

    def keys_of(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), dtype=np.uint64, count=len(self))


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all texts' words one after another, how many each text has, and the places' keys. Ends are not among them."""
    places = Places()
    get = places.__getitem__
    own = [list(map(get, t.split())) for t in texts]
    return np.fromiter(chain.from_iterable(own), dtype=np.int64), np.array([len(x) for x in own], dtype=np.int64), places.keys_of()


def asked_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all strings and of all words that the texts hold and of the end, each in order."""
    words = set()
    for t in texts:
        words.update(t.split())
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return distinct(grams(texts, order)), np.sort(np.append(own, np.uint64(END_WORD)))


def count(docs: DataFrame, order: int, slots: int, chunk: int = 4 << 20) -> DataFrame:
    """Packed counts of strings and words, summed over all documents. Strings of held-out documents alone count 0."""

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray):
        at, ends = by_slot(keys, slots)
        keys, counts, begin = keys[at], counts[at], 0
        out = []
        for s, end in enumerate(ends.tolist()):
            if end > begin:
                own = counts[begin:end]
                out.append(
                    {
                        "slot": s,
                        "kind": kind,
                        "keys": common.packed(keys[begin:end]),
                        "counts": common.packed(own.astype(np.int64)),
                        "n_keys": end - begin,
                        "n_sum": int(own.sum())
                    }
                )
            begin = end
        return out

    def run(batches):
        for table in common.text_blocks(batches, chunk):
            held = np.array(table.column("held_out").to_pylist(), dtype=bool)
            texts = _texts(table)
            out = []
            parts = [
                np.unique(grams([t for t, h in zip(texts, held, strict=True) if h == x], order), return_counts=True) for x in (False, True)
            ]
            out += rows(GRAM, *added(np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1] * 0])))
            at, lengths, keys = word_places([t for t, h in zip(texts, held, strict=True) if not h])
            n = np.bincount(at, minlength=len(keys))
            if len(lengths):
                keys, n = np.append(keys, np.uint64(END_WORD)), np.append(n, len(lengths))
            keys, n = added(keys, n)
            out += rows(WORD, keys, n)
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[i : i + 64], schema=_ARROW)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a slot. Memory holds the slot's distinct keys and as many new ones, however many rows come."""
        keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def folded():
            return added(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([counts, *(n for _, n in held)]))

        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held.append((np.frombuffer(common.unpacked(k), np.uint64), np.frombuffer(common.unpacked(n), np.int64)))
                size += len(held[-1][0])
                if size > max(len(keys), 1 << 20):
                    (keys, counts), held, size = folded(), [], 0
        keys, counts = folded()
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "slot": key[0].as_py(),
                    "kind": key[1].as_py(),
                    "keys": common.packed(keys),
                    "counts": common.packed(counts),
                    "n_keys": len(keys),
                    "n_sum": int(counts.sum())
                }
            ],
            schema=_ARROW
        )

    return docs.mapInArrow(run, _PACK).groupBy("slot", "kind").applyInArrow(merge, _PACK)


def _context(ctx: Column, k: int) -> Column:
    return ctx.bitwiseAND(F.lit((1 << (8 * k)) - 1)) if k else F.lit(0).cast("long")


def string_values(counted: DataFrame, order: int) -> DataFrame:
    """slot, key, value: log10 probability of each string's last byte after the others, by the escapes and exclusions above."""

    def unpack(batches):
        for batch in batches:
            for slot, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("slot", "keys", "counts")), strict=True):
                k, n = np.frombuffer(common.unpacked(keys), np.uint64), np.frombuffer(common.unpacked(counts), np.int64)
                for i in range(0, len(k), 100_000):
                    part = k[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), slot), pa.int32()),
                            pa.array((part >> np.uint64(8)).astype(np.int64)),
                            pa.array((part & np.uint64(255)).astype(np.int32)),
                            pa.array(n[i : i + 100_000])
                        ],
                        names=["slot", "ctx", "sym", "n"]
                    )

    rows = common.written(
        counted.where(F.col("kind") == GRAM).select("slot", "keys", "counts").mapInArrow(unpack, "slot int, ctx long, sym int, n long"),
        "strings"
    )
    level = {order: rows.where(F.col("n") > 0).select("ctx", "sym", "n")}
    for k in range(order - 1, -1, -1):
        level[k] = common.written(
            level[k + 1].groupBy(_context(F.col("ctx"), k).alias("ctx"), "sym").agg(F.sum("n").alias("n")), f"level{k}"
        )
    contexts = {}
    for k in range(order + 1):
        contexts[k] = level[k].groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        if k:  # what the next shorter context has counted of this context's symbols
            up = level[k - 1].select(F.col("ctx").alias("up"), F.col("sym").alias("up_sym"), F.col("n").alias("up_n"))
            up = F.broadcast(up) if k <= 2 else up  # at most 256 x 256 rows
            shared = level[k].join(
                up, (_context(F.col("ctx"), k - 1) == F.col("up")) & (F.col("sym") == F.col("up_sym"))
            ).groupBy("ctx").agg(F.sum("up_n").alias("shared"))
            contexts[k] = contexts[k].join(shared, "ctx")
        else:
            contexts[k] = contexts[k].withColumn("shared", F.lit(0).cast("long"))
        contexts[k] = contexts[k].select(F.col("ctx").alias("c"), "all", "kinds", "shared")
    seen = rows.where(F.col("n") > 0).join(contexts[order], F.col("ctx") == F.col("c")).select(
        "slot", "ctx", "sym", F.log10(F.col("n") / (F.col("all") + F.col("kinds"))).alias("value")
    )
    asked = rows.where(F.col("n") == 0).select(
        "slot",
        "ctx",
        "sym",
        F.lit(0.0).alias("value"),
        F.lit(False).alias("done"),
        F.lit(0).cast("long").alias("ex_all"),
        F.lit(0).cast("long").alias("ex_kinds")
    )
    for k in range(order, -1, -1):
        small = (lambda df, at_most: F.broadcast(df) if at_most <= 2 else df)  # 256^2 rows at most
        asked = asked.withColumn("own", _context(F.col("ctx"), k))
        if k < order:  # at the longest context none of these symbols has been seen
            found = level[k].select(F.col("ctx").alias("lc"), F.col("sym").alias("ls"), F.col("n").alias("ln"))
            asked = asked.join(small(found, k + 1), (F.col("own") == F.col("lc")) & (F.col("sym") == F.col("ls")), "left")
        else:
            asked = asked.withColumn("ln", F.lit(None).cast("long"))
        asked = asked.join(small(contexts[k], k), F.col("own") == F.col("c"), "left")
        n, d = F.col("all") - F.col("ex_all"), F.col("kinds") - F.col("ex_kinds")
        hit, escape = F.log10(F.col("ln") / (n + d)), F.when(d > 0, F.log10(d / F.greatest(n + d, F.lit(1)))).otherwise(0.0)
        value = F.col("value") + F.when(F.col("done") | F.col("c").isNull(), 0.0).when(F.col("ln").isNotNull(), hit).otherwise(escape)
        asked = asked.select(
            "slot",
            "ctx",
            "sym",
            value.alias("value"),
            (F.col("done") | F.col("ln").isNotNull()).alias("done"),
            F.coalesce("shared", F.lit(0)).alias("ex_all"),
            F.coalesce("kinds", F.lit(0)).alias("ex_kinds")
        )
    # Not even the empty context knows the symbol: all others are alike. ex_kinds holds the empty context's symbols.
    asked = asked.select(
        "slot",
        "ctx",
        "sym",
        F.when(F.col("done"), F.col("value")).otherwise(
            F.col("value") - F.log10(F.greatest(256 - F.col("ex_kinds"), F.lit(1)).cast("double"))
        ).alias("value")
    )
    return seen.unionByName(asked).select("slot", (F.shiftleft("ctx", 8).bitwiseOR(F.col("sym").cast("long"))).alias("key"), "value")


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, 0 for empty ones."""
    out, some = np.zeros(len(lengths), dtype=values.dtype), lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def score(
    docs: DataFrame, order: int = 5, folds: int = 7, held: int = 2, block_bytes: int = 6 << 20, slot_bytes: int = 32 << 20
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text; others are ignored).

    Documents whose crc32(doc_id as text) mod folds is `held` are not learnt from. A null text is empty: one token, its
    end. A null id counts as the empty text for the fold. Repeated rows are counted and scored as often as they stand.
    Without training texts every symbol has probability 1/256 and the base is 0. Words are told apart by 64-bit hashes.
    An empty table gives an empty result. Keys are dealt out to a slot for each slot_bytes of the texts. docs must give
    its rows in the same order when it is read again, as files do: a row's block follows its place.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    slots = max(common.partitions(spark), min(-(-int(size) // slot_bytes), MOST_SLOTS))
    places = max(1, -(-int(size) // (4 * slots * slot_bytes)))  # of a slot's requests, and of its part of the model
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", (common.crc_mod(F.col("doc_id"), folds) == held).alias("held_out")
    )
    counted = common.written(count(docs, order, slots), "counted")
    totals = counted.where(F.col("kind") == WORD).agg(
        F.coalesce(F.sum("n_sum"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("v")
    ).first()
    train_tokens, base = int(totals["n"]), float(totals["n"] + totals["v"] + 1)

    def gather(key, table):
        keys = table.column("key").to_numpy().astype(np.uint64)
        at = np.argsort(keys)
        return pa.table(
            {
                "slot": pa.array([key[0].as_py()], pa.int32()),
                "kind": pa.array([GRAM], pa.int32()),
                "keys": pa.array([common.packed(keys[at])], pa.binary()),
                "values": pa.array([common.packed(table.column("value").to_numpy()[at])], pa.binary())
            }
        )

    strings = string_values(counted, order).groupBy("slot").applyInArrow(gather, "slot int, kind int, keys binary, values binary")
    model = common.written(
        strings.unionByName(counted.where(F.col("kind") == WORD).select("slot", "kind", "keys", F.col("counts").alias("values"))), "model"
    )

    # Rows are dealt, not values: rows that repeat go to many blocks.
    turn = F.monotonically_increasing_id().bitwiseAND(1023)
    dealt = docs.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text", turn), F.lit(blocks)).cast("int")
    ).repartition(max(slots, min(blocks, 100_000)), "block")

    def request(key, table):
        out = []
        for kind, keys in zip((GRAM, WORD), asked_keys(_texts(table), order), strict=True):
            at, ends = by_slot(keys, slots)
            keys, begin = keys[at], 0
            for s, end in enumerate(ends.tolist()):
                if end > begin:
                    out.append((key[0].as_py(), s, kind, common.packed(keys[begin:end])))
                begin = end
        return pa.table(
            {
                "block": pa.array([x[0] for x in out], pa.int32()),
                "slot": pa.array([x[1] for x in out], pa.int32()),
                "kind": pa.array([x[2] for x in out], pa.int32()),
                "keys": pa.array([x[3] for x in out], pa.binary())
            }
        )

    def answer(batches):
        """Rows come by slot, kind and place, the model's before the requests: one slot of the model and one request are held at a time."""
        place, keys, values = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                dtype = np.float64 if r["kind"] == GRAM else np.int64
                if place != (own := (r["slot"], r["kind"], r["place"])):
                    place, keys, values = own, np.zeros(0, np.uint64), np.zeros(0, dtype)
                asked = np.frombuffer(common.unpacked(r["keys"]), np.uint64)
                if r["values"] is not None:
                    keys, values = asked, np.frombuffer(common.unpacked(r["values"]), dtype)
                    continue
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                got = np.where(keys[at] == asked, values[at], 0) if len(keys) else np.zeros(len(asked), dtype)
                out.append((r["block"], r["slot"], r["kind"], common.packed(got.astype(dtype))))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([x[0] for x in out], pa.int32()),
                    "slot": pa.array([x[1] for x in out], pa.int32()),
                    "kind": pa.array([x[2] for x in out], pa.int32()),
                    "values": pa.array([x[3] for x in out], pa.binary())
                }
            )

    def add_up(table, answers):
        texts, got = _texts(table), {(r["kind"], r["slot"]): r["values"] for r in answers.to_pylist()}

        def answered(kind: int, keys: np.ndarray) -> np.ndarray:
            """The answers in the order of the keys; they came slot by slot, in the keys' own order."""
            out, rank = np.empty(len(keys), np.float64 if kind == GRAM else np.int64), np.argsort(keys)
            at, ends = by_slot(keys[rank], slots)
            begin = 0
            for s, end in enumerate(ends.tolist()):
                if end > begin:
                    out[rank[at[begin:end]]] = np.frombuffer(common.unpacked(got[kind, s]), out.dtype)
                begin = end
            return out

        at, distinct = pd.factorize(grams(texts, order))
        score = sums(answered(GRAM, distinct)[at], np.array([len(t) + 1 for t in texts], dtype=np.int64))
        at, lengths, keys = word_places(texts)
        n = answered(WORD, np.append(keys, np.uint64(END_WORD)))
        rate, end = np.log10((n + 1) / base), len(keys)
        out = {
            "n_tokens": lengths + 1,
            "n_known": sums((n[at] > 0).astype(np.int64), lengths) + int(n[end] > 0),
            "base_score": sums(rate[at], lengths) + rate[end],
            "score": score
        }
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table(
            {"doc_id": table.column("doc_id"), "held_out": table.column("held_out")} | {k: pa.array(v, kinds[k]) for k, v in out.items()}
        )

    requests = dealt.groupBy("block").applyInArrow(request, "block int, slot int, kind int, keys binary")
    known = model.select(
        "slot", "kind", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"), F.lit(-1).alias("block"), "keys", "values"
    )
    asked = requests.select(
        "slot", "kind", F.pmod("block", F.lit(places)).alias("place"), "block", "keys", F.lit(None).cast("binary").alias("values")
    )
    both = known.unionByName(asked).repartition(
        min(2 * slots * places, 100_000), "slot", "kind", "place"
    ).sortWithinPartitions("slot", "kind", "place", "block")
    answers = both.mapInArrow(answer, "block int, slot int, kind int, values binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
