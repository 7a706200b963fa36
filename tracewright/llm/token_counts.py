"""Token counts of whole texts without materialising ids.

A task turns each block of documents (bounded in bytes) into per-document pre-token frequencies: for each distinct
pre-token of the block, the documents that have it and how often. These are dealt out by pre-token, packed as one row
for each block and slot of the pre-tokens' hash, since a row for each pre-token costs more in row headers than in
data. Where all rows of a slot meet, each distinct pre-token's pieces are counted once and joined to the frequencies;
dealt out again by block, pieces times frequencies are summed for each document. A hot pre-token is one entry for each
block, so no key outgrows a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common, tokens

#: Slots of pre-tokens; beyond, a slot's blocks are dealt to several places, so that rows stay linear in the input.
MOST_SLOTS = 512
_SCHEMA = "block long, slot int, place int, keys binary, key_bytes binary, n_docs binary, at binary, freq binary, ids array<long>, n_bytes array<long>"


def _frequencies(table: pa.Table, block: int, slots: int, places: int, pattern: str, path: str):
    """A first row with the block's documents, then one for each slot with its pre-tokens' frequencies."""
    texts = [x or "" for x in table.column("text").to_pylist()]
    of: dict[str, int] = {}
    codes, lengths = [], []
    for text in texts:
        own = tokens.pre_tokens(text, pattern, path)
        lengths.append(len(own))
        codes += [of.setdefault(x, len(of)) for x in own]
    ids = [x for x in table.column("doc_id").to_pylist()]
    none = common.packed(b"")
    yield {
        "block": block,
        "slot": block % slots,
        "place": block % places,
        "keys": none,
        "key_bytes": none,
        "n_docs": none,
        "at": none,
        "freq": none,
        "ids": ids,
        "n_bytes": [len(x.encode()) for x in texts]
    }
    if not of:
        return
    keys = [x.encode() for x in of]
    slot = np.array([xxhash.xxh32_intdigest(x) for x in keys], dtype=np.int64) % slots
    order = np.argsort(slot, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    docs = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    pairs, freq = np.unique(rank[np.asarray(codes, dtype=np.int64)] * len(texts) + docs, return_counts=True)
    key_of, at = np.divmod(pairs, len(texts))
    cuts = np.searchsorted(slot[order], np.arange(slots + 1))
    pair_cuts = np.searchsorted(key_of, cuts)
    per_key = np.bincount(key_of, minlength=len(order)).astype("<u4")
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = [keys[i] for i in order[cuts[s] : cuts[s + 1]].tolist()]
        p = slice(pair_cuts[s], pair_cuts[s + 1])
        yield {
            "block": block, "slot": s, "place": block % places, "keys": common.packed(b"".join(own)), "key_bytes": common.packed(
                np.array([len(x) for x in own], "<u4")
            ),
            "n_docs": common.packed(
                per_key[cuts[s] : cuts[s + 1]]
            ), "at": common.packed(at[p].astype("<u4")), "freq": common.packed(freq[p].astype("<u4")), "ids": None, "n_bytes": None,
        }


def pre_token_frequencies(docs: DataFrame, path: str, pattern: str, block_bytes: int, slots: int, places: int = 1) -> DataFrame:
    """Per-document pre-token frequencies, packed by block and slot; place: which of a slot's places the block is dealt to."""
    arrow = pa.schema(
        [
            ("block", pa.int64()),
            ("slot", pa.int32()),
            ("place", pa.int32()),
            *((c, pa.binary()) for c in ("keys", "key_bytes", "n_docs", "at", "freq")),
            ("ids", pa.list_(pa.int64())),
            ("n_bytes", pa.list_(pa.int64()))
        ]
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        for i, table in enumerate(common.text_blocks(batches, block_bytes)):
            rows = list(_frequencies(table, (part << 32) + i, slots, places, pattern, path))
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k : k + 256], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _count(path: str, pattern: str):
    """Puts the pieces of each pre-token in its key's place; all rows of a slot are in one partition, so each is counted once while the encoder's bounded memory holds it."""

    def run(batches):
        encoder = tokens.Encoder(path, pattern)
        for batch in batches:
            pieces = []
            for keys, sizes in zip(batch.column("keys").to_pylist(), batch.column("key_bytes").to_pylist(), strict=True):
                raw, ends = common.unpacked(keys), np.cumsum(np.frombuffer(common.unpacked(sizes), "<u4")).tolist()
                own = [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
                pieces.append(common.packed(np.fromiter(map(len, encoder.of(own)), "<u4", len(own)) // 4))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("block"),
                    pa.array(pieces, pa.binary()),
                    *(batch.column(c) for c in ("n_docs", "at", "freq", "ids", "n_bytes"))
                ],
                names=["block", "pieces", "n_docs", "at", "freq", "ids", "n_bytes"]
            )

    return run


def _sum(table: pa.Table) -> pa.Table:
    """The documents of one block with their tokens summed."""
    rows = table.to_pylist()
    first = next(r for r in rows if r["ids"] is not None)
    total = np.zeros(len(first["ids"]), dtype=np.int64)
    for r in rows:
        pieces, n_docs, at, freq = (
            np.frombuffer(common.unpacked(r[c]), "<u4").astype(np.int64) for c in ("pieces", "n_docs", "at", "freq")
        )
        np.add.at(total, at, np.repeat(pieces, n_docs) * freq)
    return pa.table(
        {"doc_id": pa.array(first["ids"], pa.int64()), "n_bytes": pa.array(first["n_bytes"], pa.int64()), "n_tokens": pa.array(total)}
    )


def count_tokens(
    docs: DataFrame, path: str, pattern: str, limit: int = 1024, block_bytes: int = 16 << 20, slot_bytes: int = 32 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text; others are ignored).

    A null text counts as empty: 0 bytes, 0 tokens. Texts are whole; a block holds at least one, however long. Repeated rows and repeated or null ids give one row each. An empty
    table gives an empty result. Pre-tokens are dealt out to a slot for each
    slot_bytes of the texts, up to MOST_SLOTS; beyond, a pre-token is counted once in each of its slot's places. Strings of added tokens inside a text count as the library has them by default.
    """
    parts = common.slots_for(docs, slot_bytes)
    slots = min(parts, MOST_SLOTS)
    found = pre_token_frequencies(docs, path, pattern, block_bytes, slots, -(-parts // slots)).repartition(parts, "slot", "place")
    counted = found.mapInArrow(
        _count(path, pattern), "block long, pieces binary, n_docs binary, at binary, freq binary, ids array<long>, n_bytes array<long>"
    )
    summed = counted.groupBy("block").applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
