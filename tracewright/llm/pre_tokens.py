"""Cuts whole blocks of texts into pre-tokens at once, on their UTF-8 bytes.

The rule is that of the public rank files:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every character has one of four classes (letter, number, white space, other); a pre-token is a run of one class, with the
one space before it. Of white space before anything else the last character stands apart (or is that space). An
apostrophe that is a run of its own, with no space before it, takes one of the seven endings along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
#: What an apostrophe takes along.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the tiktoken library sees it: its Unicode version decides, not Python's."""
    import tiktoken

    points = np.setdiff1d(np.arange(0x110000, dtype="<u4"), np.arange(0xD800, 0xE000, dtype="<u4"))
    everything = points.tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    return out


def _characters(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Where each character begins (None: every byte is one), and its class."""
    if not (raw & 0x80).any():
        return None, table[:128][raw]
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.uint32)
    wide = np.flatnonzero(lead >= 0x80)
    where, first = at[wide], lead[wide]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | (raw[where[more] + k] & 0x3F)
    lead[wide] = point
    return at, table[lead]


def cut(raw: np.ndarray, ends: np.ndarray, table: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Where pre-tokens begin in the UTF-8 bytes of texts that stand one after another; ends: where each text ends.

    Every text begins a pre-token of its own. Bytes are those of valid texts; several empty texts share a place. Whole
    texts of about `piece` bytes are cut at a time: what a cut needs beside its result, some twenty times its bytes, is
    bounded so.
    """
    return np.concatenate([np.empty(0, np.int64), *(begin + start for start, _, begin in pieces(raw, ends, table, piece))])


def pieces(raw: np.ndarray, ends: np.ndarray, table: np.ndarray, piece: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """The same cut a piece at a time: from where to where it reaches, and its pre-tokens' beginnings, from the piece's own on."""
    start = 0
    while start < len(raw):
        k = min(int(np.searchsorted(ends, start + piece)), len(ends) - 1)
        own, stop = ends[np.searchsorted(ends, start, "right") : k + 1] - start, int(ends[k])
        yield start, stop, _cut(raw[start:stop], own, table)
        start = stop


def _cut(raw: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    at, kind = _characters(raw, table)
    n = len(kind)
    byte = raw if at is None else raw[at]
    heads = np.unique(np.append(0, ends[:-1]))
    heads = heads[heads < len(raw)]
    first = np.zeros(n + 1, bool)  # of a text; the end counts as one more
    first[heads if at is None else np.searchsorted(at, heads)] = True
    first[n] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else stands apart, and a space joins what follows.
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~first[1:]
    begin |= last
    joins = last & (byte == 0x20)
    begin[1:] &= ~joins[:-1]
    # Apostrophes of their own with an ending behind them, in the same text.
    mark = np.flatnonzero(begin & (byte == 0x27))
    mark = mark[(mark + 1 < n) & (kind[np.minimum(mark + 1, n - 1)] == LETTER) & ~first[mark + 1]]
    for ending in _ENDINGS:
        own = mark[mark + len(ending) < n]
        for k, b in enumerate(ending, 1):
            own = own[(byte[own + k] == b) & ~first[own + k]]
        begin[own + 1] = False
        after = own + 1 + len(ending)
        begin[after[after < n]] = True
    begin = np.flatnonzero(begin)
    return begin.astype(np.int64) if at is None else at[begin]
