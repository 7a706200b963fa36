"""Byte-level BPE of whole texts: ranked merges folded over distinct words by Spark's higher-order functions.

1. Tasks cut blocks of documents (bounded in bytes) into pre-tokens and number the distinct ones of a block: codes stand
   for the texts, and each distinct word leaves the block once, dealt out by its hash.
2. Where all rows of a slot meet, words that this partition has not met yet are told apart, and Spark folds the merges
   over each of them. The rank map is a literal. Of a word of n bytes every run of bytes in the map is a possible merge;
   in the order of their ranks each clears the boundary inside it if it is two pieces just then. The boundaries are the
   bits of one number.
3. Back at their block the words' ids take the places of the codes.

One pass in the order of ranks is exact if every token is made from pieces of lower ranks only, and in no other way, as
tokens of trained vocabularies are: `rank_map` checks it for each. Decoding joins the ids' binary pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common, pre_tokens

#: Words of more bytes than there are bits for are merged by a heap where they are told apart.
MOST_BYTES = 61
#: Slots of words; beyond, a slot's blocks are dealt to several places, so that rows stay linear in the input.
MOST_SLOTS = 512
_BUCKETS = 1 << 17
_HEAD = ("ids", "counts", "codes", "slots")
_HEAD_TYPES = "ids array<long>, counts binary, codes binary, slots binary"


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merged(word: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[int]]:
    """The word's pieces when the lowest rank is merged first, the leftmost of several; and the ranks in that order."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap, order = [], []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(word[i : after[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, after[i], after[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, m, end = heapq.heappop(heap)
        if alive[i] and after[i] == m and m < n and after[m] == end:
            order.append(r)
            alive[m], after[i] = False, end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
    return [word[i : after[i]] for i in range(n) if alive[i]], order


def long_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[word]] if word in ranks else [ranks[x] for x in merged(word, ranks)[0]]


@lru_cache(maxsize=2)
def rank_map(path: str) -> tuple[str, int]:
    """The ranks as JSON for a literal, dealt to buckets by the crc32 of a token's hexadecimal digits, and the longest token.

    ValueError if a byte has no rank, or if merging a token's own bytes does not end with the token and its own rank.
    """
    ranks = ranks_of(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} has no rank for some byte")
    buckets: list = [None] * _BUCKETS
    for token, rank in ranks.items():
        if len(token) > 1:
            pieces, order = merged(token, ranks)
            if len(pieces) > 1 or order[-1] != max(order) or order[-1] != rank:
                raise ValueError(f"{path}: merges in the order of ranks do not make {token!r} last")
        key = token.hex().upper()
        at = zlib.crc32(key.encode()) % _BUCKETS
        buckets[at] = (buckets[at] or {}) | {key: rank << 14}
    return json.dumps(buckets, separators=(",", ":")), max(map(len, ranks))


def _fold(word: Column, table: Column, longest: int) -> Column:
    """The ids of a word of at most MOST_BYTES bytes (binary).

    Runs of its bytes are runs of its hexadecimal digits here: the run from byte i on of n bytes stands at digit 2i + 1 and has
    2n digits. A possible merge is one number, rank << 14 | (2i + 1) << 7 | 2n, so that numbers sort by rank, then from the left.
    """

    def ranked(key: Column) -> Column:
        return F.get(table, F.crc32(key).bitwiseAND(F.lit(_BUCKETS - 1)).cast("int"))[key]

    def rank(key: Column) -> Column:
        return F.shiftright(ranked(key), 14).cast("int")

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def bounds_of(run: Column) -> Column:
        i, n = F.shiftright(run, 8).bitwiseAND(F.lit(63)).cast("int"), F.shiftright(run, 1).bitwiseAND(F.lit(63)).cast("int")
        return F.struct((bit(i) + bit(i + n)).alias("ends"), (bit(i + n) - bit(i + 1)).alias("inner"))

    def merge(bounds: Column, run: Column) -> Column:
        inside = bounds.bitwiseAND(run["inner"])
        return F.when((F.bit_count(inside) == 1) & (bounds.bitwiseAND(run["ends"]) == run["ends"]), bounds - inside).otherwise(bounds)

    def within(digits: Column) -> Column:
        n = F.length(digits)
        runs = F.transform(
            F.sequence(F.lit(1), n - 3, F.lit(2)),
            lambda p: F.transform(
                F.sequence(F.lit(4), F.least(n - p + 1, F.lit(2 * longest)), F.lit(2)),
                lambda size: ranked(F.substring(digits, p, size)) + (p * 128 + size)
            ),
        )
        ordered = F.transform(F.sort_array(F.array_compact(F.flatten(runs))), bounds_of)
        bounds = F.aggregate(ordered, bit((n / 2).cast("int") + 1) - 1, merge)
        cuts = common.let(
            bounds,
            lambda b: F.filter(F.sequence(F.lit(1), n + 1, F.lit(2)), lambda p: F.call_function("getbit", b, F.shiftright(p, 1)) == 1)
        )
        return common.let(
            cuts,
            lambda c: F.transform(
                F.sequence(F.lit(1), F.size(c) - 1), lambda k: rank(F.substring(digits, F.get(c, k - 1), F.get(c, k) - F.get(c, k - 1)))
            )
        )

    def whole(digits: Column) -> Column:
        return common.let(
            rank(digits),
            lambda r: F.when(r.isNotNull(), F.array(r)).when(F.length(digits) > 0, within(digits)).otherwise(F.array().cast("array<int>"))
        )

    return common.let(F.hex(word).cast("binary"), whole)


def _by_frequency(codes: np.ndarray, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """codes numbered anew, the most frequent first, and the old code of each new one."""
    often = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    for k in range(0, len(codes), step):
        own = np.bincount(codes[k : k + step])
        often[: len(own)] += own
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), codes.dtype)
    rank[order] = np.arange(len(order), dtype=codes.dtype)
    return rank[codes], order


def _coded(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many pre-tokens each text has, a code for each of them, and the codes' words, the most frequent first.

    Pieces of the texts are cut and given codes one after another; beside the texts, a code and an offset of four bytes
    each are held for a pre-token.
    """
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    kind, offset = (pa.binary(), "<i4") if len(raw) < 1 << 31 else (pa.large_binary(), "<i8")
    after, total, parts = np.zeros(n, np.int64), 0, []
    for start, stop, begin in pre_tokens.pieces(raw, ends, classes):
        own = slice(np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "right"))
        after[own] = total + np.searchsorted(begin, ends[own] - start)
        total += len(begin)
        offsets = np.append(begin, stop - start).astype(offset)
        parts.append(pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[start:stop])]))
    counts = np.diff(after, prepend=0)
    coded = pa.chunked_array(parts, kind).dictionary_encode().chunks  # one dictionary for all
    if not coded:
        return counts, np.empty(0, np.int32), []
    words = coded[-1].dictionary
    codes, order = _by_frequency(np.concatenate([x.indices.to_numpy() for x in coded]))
    return counts, codes, words.take(pa.array(order)).to_pylist()


#: The byte of a code that stands with the long ones.
_ESCAPE = 255


def _packed_codes(codes: np.ndarray) -> bytes:
    """A byte for each code, then those that have none; their bytes of one weight stand together and compress better so."""
    short = np.minimum(codes, _ESCAPE).astype(np.uint8)
    wide = (codes[codes >= _ESCAPE] - _ESCAPE).astype("<u4").view(np.uint8).reshape(-1, 4)
    return common.packed(short.tobytes() + np.ascontiguousarray(wide.T).tobytes(), level=3)


def _unpacked_codes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(common.unpacked(data), np.uint8)
    codes = raw[:n].astype(np.uint32)
    codes[codes == _ESCAPE] += np.ascontiguousarray(raw[n:].reshape(4, -1).T).view("<u4").ravel()
    return codes


def _number(table: pa.Table, block: int, slots: int, places: int, classes: np.ndarray):
    """A first row with the block's documents and codes, then one for each slot with its distinct words."""
    counts, codes, words = _coded(table.column("text").combine_chunks().cast(pa.large_string()).fill_null(""), classes)
    packed = _packed_codes(codes)
    del codes
    slot = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % slots
    yield {
        "block": block, "slot": block % slots, "place": block % places, "words": None, "sizes": None, "ids": table.column(
            "doc_id"
        ).to_pylist(),
        "counts": common.packed(counts.astype("<i8")), "codes": packed, "slots": common.packed(slot.astype("<u2")),
    }
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(slots + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = [words[k] for k in order[cuts[s] : cuts[s + 1]].tolist()]
        yield {
            "block": block, "slot": s, "place": block % places, "words": common.packed(b"".join(own)), "sizes": common.packed(
                np.fromiter(map(len, own), "<u4", len(own))
            ),
            "ids": None, "counts": None, "codes": None, "slots": None,
        }


def _tell_apart(path: str, most: int):
    """Numbers each row's words within its partition; words that have not come yet go on, those of too many bytes with their ids."""
    arrow = pa.schema(
        [
            ("block", pa.int64()),
            ("slot", pa.int32()),
            ("anew", pa.bool_()),
            ("numbers", pa.binary()),
            ("fresh", pa.list_(pa.binary())),
            ("apart", pa.list_(pa.list_(pa.int32()))),
            ("ids", pa.list_(pa.int64())),
            *((c, pa.binary()) for c in _HEAD[1:])
        ]
    )

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                out = {c: row[c] for c in ("block", "slot", *_HEAD)} | {"anew": False, "numbers": None, "fresh": [], "apart": []}
                if row["words"] is not None:
                    if len(known) > most:
                        known, out["anew"] = {}, True
                    raw, z = common.unpacked(row["words"]), np.cumsum(
                        np.frombuffer(common.unpacked(row["sizes"]), "<u4"), dtype=np.int64
                    ).tolist()
                    own = [raw[a:b] for a, b in zip([0, *z], z, strict=False)]
                    new = [w for w in own if w not in known]
                    short, wide = [w for w in new if len(w) <= MOST_BYTES], [w for w in new if len(w) > MOST_BYTES]
                    known.update(zip(short + wide, range(len(known), len(known) + len(new)), strict=True))
                    out |= {
                        "numbers": common.packed(np.fromiter(map(known.__getitem__, own), "<u4", len(own))),
                        "fresh": short,
                        "apart": [long_ids(w, ranks_of(path)) for w in wide]
                    }
                yield pa.RecordBatch.from_pylist([out], schema=arrow)
        pa.default_memory_pool().release_unused()

    return run, "block long, slot int, anew boolean, numbers binary, fresh array<binary>, apart array<array<int>>, " + _HEAD_TYPES


def _answer(batches):
    """Each row's words' ids, by the numbers that _tell_apart gave them in this partition."""
    starts, lengths, flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
    for batch in batches:
        for k in range(batch.num_rows):
            numbers, found = batch.column("numbers")[k].as_py(), batch.column("found").slice(k, 1).flatten()
            sizes = pa.array([None], pa.binary())
            values = sizes
            if numbers is not None:
                if batch.column("anew")[k].as_py():
                    starts, lengths, flat = starts[:0], lengths[:0], flat[:0]
                n = found.value_lengths().to_numpy().astype(np.int64)
                starts = np.append(starts, len(flat) + np.cumsum(n) - n)
                lengths = np.append(lengths, n)
                flat = np.append(flat, found.flatten().to_numpy().astype("<u4"))
                at = np.frombuffer(common.unpacked(numbers), "<u4")
                sizes = pa.array([common.packed(lengths[at].astype("<u4"))], pa.binary())
                values = pa.array([common.packed(flat[common.spread(starts[at], lengths[at])])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(k, 1) for c in ("block", "slot")), sizes, values, *(batch.column(c).slice(k, 1) for c in _HEAD)],
                names=["block", "slot", "sizes", "values", *_HEAD]
            )
    pa.default_memory_pool().release_unused()


def _joined(table: pa.Table) -> pa.Table:
    """The documents of one block with their ids."""
    rows = table.sort_by("slot").to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    rows = [r for r in rows if r["values"] is not None]
    counts, slots = np.frombuffer(common.unpacked(head["counts"]), "<i8"), np.frombuffer(common.unpacked(head["slots"]), "<u2")
    codes = _unpacked_codes(head["codes"], int(counts.sum()))
    sizes, values = (np.frombuffer(b"".join(common.unpacked(r[c]) for r in rows), "<u4") for c in ("sizes", "values"))
    order = np.argsort(slots, kind="stable")  # the rows' words stand by slot, and in the order of their codes in each
    starts, lengths = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    lengths[order] = sizes
    starts[order] = np.cumsum(sizes, dtype=np.int64) - sizes
    after, step = np.zeros(len(codes) + 1, np.int64), 1 << 17
    for k in range(0, len(codes), step):  # lengths and places of one step's ids are held at a time
        np.cumsum(lengths[codes[k : k + step]], out=after[k + 1 : k + 1 + step])
        after[k + 1 : k + 1 + step] += after[k]
    ids = np.empty(after[-1], "<i4")
    for k in range(0, len(codes), step):
        own = codes[k : k + step]
        ids[after[k] : after[k + len(own)]] = values[common.spread(starts[own], lengths[own])]
    ends = after[np.append(0, np.cumsum(counts))]
    return pa.table(
        {"doc_id": pa.array(head["ids"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}
    )


def encode(docs: DataFrame, path: str, block_bytes: int = 16 << 20, slot_bytes: int = 32 << 20, words: int = 500_000) -> DataFrame:
    """doc_id, ids (array<int>) of each row of docs (doc_id, text; others are ignored), by the rank file at path.

    A null text counts as empty: no ids. Repeated rows and repeated or null ids give one row each. An empty table gives an
    empty result. Texts of any length are whole: a block holds at least one text, and a task needs about fifteen times
    its bytes. Words are dealt out to a slot for each slot_bytes of the texts, a partition remembers `words` of them at a time.
    """
    table, longest = rank_map(path)
    parts = common.slots_for(docs, slot_bytes)
    slots = min(parts, MOST_SLOTS)
    places = -(-parts // slots)
    classes = pre_tokens.classes()
    arrow = pa.schema(
        [
            ("block", pa.int64()),
            ("slot", pa.int32()),
            ("place", pa.int32()),
            ("words", pa.binary()),
            ("sizes", pa.binary()),
            ("ids", pa.list_(pa.int64())),
            *((c, pa.binary()) for c in _HEAD[1:])
        ]
    )

    def number(batches):
        part = TaskContext.get().partitionId()
        for i, block in enumerate(common.text_blocks(batches, block_bytes)):
            for row in _number(block, (part << 32) + i, slots, places, classes):
                yield pa.RecordBatch.from_pylist([row], schema=arrow)
            pa.default_memory_pool().release_unused()  # four workers stand in an executor, and each keeps what it held

    run, schema = _tell_apart(path, words)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        number, "block long, slot int, place int, words binary, sizes binary, " + _HEAD_TYPES
    )
    told = found.repartition(parts, "slot", "place").mapInArrow(run, schema)
    ranks = F.from_json(F.lit(table), "array<map<string,bigint>>").cast("array<map<binary,bigint>>")
    folded = told.withColumn(
        "found", common.let(ranks, lambda t: F.concat(F.transform("fresh", lambda w: _fold(w, t, longest)), "apart"))
    ).drop("fresh", "apart")
    answered = folded.mapInArrow(_answer, "block long, slot int, sizes binary, values binary, " + _HEAD_TYPES)
    return answered.groupBy("block").applyInArrow(_joined, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded with a column `decoded`: the pieces of their ids, joined as bytes. A null `ids` gives null; an id that has no piece is an error."""
    ranks = ranks_of(path)
    pieces = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    pieces = F.from_json(F.lit(json.dumps(pieces)), "array<binary>").cast("array<string>")
    joined = common.let(pieces, lambda p: F.array_join(F.transform("ids", lambda i: F.element_at(p, i + 1)), ""))
    return encoded.withColumn("decoded", F.when(F.col("ids").isNotNull(), joined).cast("binary"))
