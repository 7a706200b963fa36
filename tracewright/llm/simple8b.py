"""Simple-8b word-aligned coding of token ids, its shard files, and their vectorised decoding.

A 64-bit word holds a selector in its top 4 bits and ids in the other 60: SELECTORS lists how many ids of how many
bits. Selector 15 is the escape: one id that is too wide for the packed forms. Ids are coded in blocks of BLOCK ids;
no word crosses a block, and each block's first word is in the offsets, so blocks decode alone and all at once.

A shard file: MAGIC, then little-endian 64-bit counts of documents, ids, words and documents without an id, which come
first; the other documents' ids, all documents' counts of ids, the blocks' offsets in words (one more than blocks), and
the words.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8BTOK02"
BLOCK = 1024
#: Fixed values: (ids in a word, bits of an id), by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
_COUNT = np.array([n for n, _ in SELECTORS] + [0] * (ESCAPE - len(SELECTORS)) + [1])
_BITS = np.array([b for _, b in SELECTORS] + [0] * (ESCAPE - len(SELECTORS)) + [60])
#: Bits that an id needs, for all ids below 2^17 (0 needs none).
_LENGTH = np.array([i.bit_length() for i in range(1 << 17)], dtype=np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words and the blocks' offsets in words. Each word takes as many of the next ids as fit, never past its block."""
    ids = np.asarray(ids, dtype=np.uint64)
    if len(ids) and int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    n, blocks = len(ids), -(-len(ids) // block)
    # Bits of each id, a row a block; what lies beyond an end needs no bits. Windows' maxima tell what fits.
    widest = SELECTORS[0][0]
    bits = np.zeros((blocks, block + widest), dtype=np.uint8)
    flat = np.zeros(blocks * block, dtype=np.uint8)
    flat[:n] = _LENGTH[np.minimum(ids, len(_LENGTH) - 1).astype(np.int64)]
    large = np.flatnonzero(ids >= len(_LENGTH))
    flat[large] = np.frexp(ids[large].astype(np.float64))[1]
    bits[:, :block] = flat.reshape(blocks, block)
    power = {1: bits}
    while 2 * max(power) <= widest:
        k = max(power)
        power[2 * k] = np.maximum(power[k][:, : power[k].shape[1] - k], power[k][:, k:])
    choice = np.full((blocks, block), ESCAPE, dtype=np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):  # the last that fits is the one with most ids
        count, most = SELECTORS[s]
        k = max(p for p in power if p <= count)
        choice[np.maximum(power[k][:, :block], power[k][:, count - k : count - k + block]) <= most] = s
    choice = choice.ravel()
    # Walk all blocks at once, a word at a time.
    here, last = np.arange(blocks) * block, np.minimum((np.arange(blocks) + 1) * block, n)
    begins, live = [], np.arange(blocks)
    while len(live):
        begins.append(here[live])
        here[live] += _COUNT[choice[here[live]].astype(np.int64)]
        live = live[here[live] < last[live]]
    begin = np.sort(np.concatenate(begins)) if begins else np.zeros(0, dtype=np.int64)
    selector = choice[begin].astype(np.int64) if len(begin) else begin
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        for k in range(_COUNT[s]):
            take = begin[own] + k
            inside = take < np.minimum((begin[own] // block + 1) * block, n)
            words[own[inside]] |= ids[take[inside]] << np.uint64(k * _BITS[s])
    return words, np.searchsorted(begin, np.append(np.arange(blocks) * block, n)).astype(np.uint64)


def decode(words: np.ndarray, n: int, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n ids of whole blocks; all words with the same selector are unpacked together."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[selector] if len(words) else np.zeros(0, dtype=np.int64)
    own_block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    before = np.cumsum(count) - count
    firsts = np.asarray(offsets[:-1], dtype=np.int64)
    begin = own_block * block + before - (before[firsts][own_block] if len(words) else 0)
    limit = np.minimum((own_block + 1) * block, n)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(_BITS[s])) - 1)
        for k in range(_COUNT[s]):
            to = begin[own] + k
            inside = to < limit[own]
            out[to[inside]] = (words[own[inside]] >> np.uint64(k * _BITS[s])) & mask
    return out


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """A shard file of documents in the order given; `nulls` documents without an id stand before those of doc_ids."""
    if len(doc_ids) + nulls != len(counts):
        raise ValueError("every document needs its count")
    words, offsets = encode(ids)
    head = np.array([len(counts), len(ids), len(words), nulls], dtype="<u8")
    parts = (head, np.asarray(doc_ids, "<i8"), np.asarray(counts, "<u8"), offsets.astype("<u8"), words.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The documents' ids, the counts of all documents, all token ids of a shard file, and how many documents have no id."""
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b shard")
    docs, n, n_words, nulls = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    sizes = ((docs - nulls, "<i8"), (docs, "<u8"), (-(-n // BLOCK) + 1, "<u8"), (n_words, "<u8"))
    parts, at = [], 40
    for size, kind in sizes:
        parts.append(np.frombuffer(data, kind, size, at))
        at += 8 * size
    doc_ids, counts, offsets, words = parts
    return doc_ids, counts.astype(np.int64), decode(words, n, offsets), nulls
