"""Tokenisers, and exact pre-token cuts of a text, for token counting and encoding.

A byte-level BPE of this kind cuts a text into pre-tokens before it merges anything. By the public files' rule whole
blocks of texts are cut at once on their bytes; by any other pattern each text is cut by itself. For counting, a text is
cut more coarsely: a single space that stands between two other characters always begins a new pre-token, so where no two
white-space characters are neighbours, `text.split(" ")` gives groups of whole pre-tokens, and each group can be encoded
on its own.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from tracewright.llm.pre_tokens import RULE, classes, cut

#: Two neighbouring white-space characters (Python's \s holds every Unicode one).
_RUNS = re.compile(r"\s\s")
#: Pre-tokens that the library merges in one call: its own records of them are held together.
_AT_ONCE = 1 << 16


def tokenizer_of(path: str):
    """A tokeniser, single-threaded: Spark's tasks are the parallelism."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One for each worker."""
    return tokenizer_of(path)


#: The character that byte-level vocabularies write for each byte; printable ones stand for themselves.
_STAY = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARACTER = np.full(256, 0, dtype="<u2")
_CHARACTER[_STAY] = _STAY
_CHARACTER[np.setdiff1d(np.arange(256), _STAY)] = 0x100 + np.arange(256 - len(_STAY))


@lru_cache(maxsize=4)
def _merger(path: str):
    """The tokeniser's model behind a cut at the byte 0xFF, which UTF-8 never holds, and that byte's id; None if the file cuts texts otherwise than bytes by pattern."""
    from tokenizers import Tokenizer, pre_tokenizers

    found = tokenizer(path)
    kind = json.loads(found.to_str())["pre_tokenizer"] or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or found.normalizer is not None:
        return None
    mark = chr(_CHARACTER[0xFF])
    own = Tokenizer(found.model)
    own.pre_tokenizer = pre_tokenizers.Split(mark, "isolated")
    return (own, own.token_to_id(mark)) if own.token_to_id(mark) is not None else None


def merged(pre: list[str], path: str) -> list[bytes]:
    """Each pre-token's ids as little-endian unsigned 32-bit bytes. The library's model takes many as byte-level characters between marks; a string of an added token goes through the whole library."""
    merger, added = _merger(path), added_tokens(path)
    whole = lambda xs: [
        np.array(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch_fast(xs, add_special_tokens=False)
    ]
    if merger is None:
        return whole(pre)
    library, mark = merger
    out = []
    for i in range(0, len(pre), _AT_ONCE):
        raw = np.frombuffer(b"\xff".join([x.encode() for x in pre[i : i + _AT_ONCE]]), np.uint8)
        found = library.encode_batch_fast([_CHARACTER[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        data, marks = ids.tobytes(), 4 * np.flatnonzero(ids == mark)
        out += [data[a:z] for a, z in zip([0, *(marks + 4).tolist()], [*marks.tolist(), len(data)], strict=True)]
    if added:
        for i, x in enumerate(pre):
            if x in added:
                out[i] = whole([x])[0]
    return out


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=4)
def added_tokens(path: str) -> frozenset[str]:
    return frozenset(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def specials(path: str):
    """Matches the added tokens' strings in UTF-8, which the library takes out of a text first."""
    found = sorted(added_tokens(path), key=len, reverse=True)
    return re.compile(b"(" + b"|".join(re.escape(x.encode()) for x in found) + b")") if found else None


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts one after another, and where each text ends."""
    if not len(texts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def cut_texts(texts: list[str], pattern: str, path: str) -> tuple[pa.Array, np.ndarray]:
    """All texts' pre-tokens one after another, and how many each text has. Added tokens' strings stay whole."""
    find = specials(path)
    if pattern != RULE:
        own = []
        for x in texts:
            parts = [p.decode() for p in find.split(x.encode())] if find else [x]
            own.append(list(chain.from_iterable([p] if i % 2 else _pattern(pattern).findall(p) for i, p in enumerate(parts))))
        return pa.array(list(chain.from_iterable(own)), pa.large_string()), np.array(list(map(len, own)), dtype=np.int64)
    column = pa.array(texts, pa.large_string())
    raw, ends = _bytes_of(column)
    holds = np.zeros(len(texts), bool)
    for x in added_tokens(path):
        holds |= pa.compute.match_substring(column, x).to_numpy(zero_copy_only=False)
    spans = [
        (ends[i] - len(data) + m.start(), ends[i] - len(data) + m.end())
        for i in np.flatnonzero(holds).tolist() for data in [texts[i].encode()] for m in find.finditer(data)
    ]
    if spans:
        first, last = np.array(spans, dtype=np.int64).T
        begin = cut(raw, np.union1d(ends, [first, last]), classes())
        span = np.searchsorted(first, begin) - 1
        begin = begin[(span < 0) | (begin >= last[span])]
    else:
        begin = cut(raw, ends, classes())
    pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw))), pa.py_buffer(raw))
    return pieces, np.diff(np.searchsorted(begin, ends), prepend=0)


def pre_tokens(text: str, pattern: str, path: str) -> list[str]:
    """Strings whose encodings, one after another, are the text's encoding."""
    if not text:
        return []
    if _RUNS.search(text) is None:
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        if first:
            out.insert(0, first)
        return out
    return cut_texts([text], pattern, path)[0].to_pylist()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    One memory, cleared when full, holds the ids of the tokeniser's own pre-tokens, and of groups as pre_tokens() cuts them
    where of() is asked, so that the library merges each pre-token once while it is held.
    """

    def __init__(self, path: str, pattern: str, most: int = 300_000):
        self.path, self.pattern, self.most = path, pattern, most
        self.known: dict[str, bytes] = {}

    def _merged(self, pre: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens."""
        found = list(map(self.known.get, pre))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            if len(self.known) > self.most:
                self.known.clear()
            new = [pre[k] for k in missing]
            ids = merged(new, self.path)
            self.known.update(zip(new, ids, strict=True))
            for k, own in zip(missing, ids, strict=True):
                found[k] = own
        return found

    def of(self, groups: list[str]) -> list[bytes]:
        """Each group's ids."""
        found = list(map(self.known.get, groups))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            new = list({groups[k] for k in missing})
            own = dict(zip(new, self.encode(new), strict=True))
            self.known.update(own)
            for k in missing:
                found[k] = own[groups[k]]
        return found

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts one after another.

        The texts are cut together and Arrow numbers their distinct pre-tokens, so Python sees each of these once. Meant
        for a few million characters at a time: their pre-tokens are held together.
        """
        pieces, per_text = cut_texts(texts, self.pattern, self.path)
        coded = pieces.dictionary_encode()
        code, found = coded.indices.to_numpy(), self._merged(coded.dictionary.to_pylist())
        raw, n = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = n[code]
        ends = np.append(0, np.cumsum(each))
        at = np.repeat((np.cumsum(n) - n)[code] - ends[:-1], each) + np.arange(ends[-1])
        return np.diff(ends[np.append(0, np.cumsum(per_text))]), raw[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        counts, ids = self.ids_of(texts)
        ends, raw = (np.cumsum(counts) * 4).tolist(), ids.tobytes()
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder stays for its next tasks."""
    return Encoder(path, pattern)
