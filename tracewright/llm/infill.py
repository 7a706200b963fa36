"""Fill-in-the-middle: every text is cut in prefix, middle and suffix, and put together anew with marks.

All rows of a batch are cut together, on the UTF-8 bytes that Arrow holds: a look-up gives each byte's class, a mask of
neighbouring bytes says where units begin, cumulative sums that start anew at each text count them, and one binary search
finds the cuts of all rows. Pieces are gathered into the new texts by one index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = range(3)
FORMS = ("plain", "psm", "spm")
#: Bits of a byte's class.
_HEAD, _BREAK, _BLANK = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[np.r_[0:0x80, 0xC0:0x100]] |= _HEAD  # of a character; 0x80 to 0xBF go on with one
_CLASS[0x0A] |= _BREAK
_CLASS[np.r_[0x20, 0x09:0x0E]] |= _BLANK
#: Whether a unit begins at a byte, by its class and that of the byte before it in the text.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda before, now: before & _BREAK != 0,
    "word": lambda before, now: (before & _BLANK == 0) & (now & _BLANK != 0),
    "character": lambda before, now: now & _HEAD != 0,
}


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts, one after another, and where each begins (and the last ends); a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def _places(raw: np.ndarray, starts: np.ndarray, mark: bytes) -> np.ndarray:
    """Where a mark stands within one text."""
    at = np.flatnonzero(raw[: max(0, len(raw) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        at = at[raw[at + k] == mark[k]]
    return at[starts[np.searchsorted(starts, at, "right")] >= at + len(mark)] if len(at) else at


def _gathered(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pieces of source, joined: the bytes, and where each row begins (and the last ends)."""
    rows, begin, size = len(size), begin.ravel(), size.ravel()
    ends = np.cumsum(size)
    total = int(ends[-1]) if rows else 0
    at = np.repeat(begin - (ends - size), size) + np.arange(total)
    return source[at], np.append(0, ends.reshape(rows, -1)[:, -1] if rows else ends)


def _strings(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def cut(column: pa.Array, h: np.ndarray, unit: str, rate: int, spm: int, marks: tuple[str, str, str]) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text; h: four numbers for each."""
    raw, starts = _bytes(column)
    rows = len(starts) - 1
    kind = _CLASS[raw]
    begin = np.zeros(len(raw), bool)
    begin[1:] = UNITS[unit](kind[:-1], kind[1:])
    some = starts[:-1] < starts[1:]
    begin[starts[:-1][some]] = True
    count, heads = np.append(0, np.cumsum(begin, dtype=np.int64)), np.append(0, np.cumsum(kind & _HEAD, dtype=np.int64))
    n = count[starts[1:]] - count[starts[:-1]]
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    form = np.where(h[:, 2] % 100 >= rate, PLAIN, np.where(h[:, 3] % 100 < spm, SPM, PSM))
    form[~some] = PLAIN
    for mark in marks:
        at = _places(raw, starts, mark.encode())
        form[np.searchsorted(starts, at, "right") - 1] = PLAIN
    # The byte behind k units of a text is where the count passes those before the text and k more.
    behind = [np.minimum(np.searchsorted(count, count[starts[:-1]] + k + 1) - 1, starts[1:]) for k in (np.minimum(a, b), np.maximum(a, b))]
    edges = np.stack([starts[:-1], *behind, starts[1:]], axis=1)
    pieces = [np.stack([edges[:, k], edges[:, k + 1] - edges[:, k]]) for k in range(3)]
    chars = [heads[edges[:, k + 1]] - heads[edges[:, k]] for k in (0, 1)]
    coded = [m.encode() for m in marks]
    at = len(raw) + np.cumsum([0, *map(len, coded)])
    p, s, m = ([np.full(rows, at[k]), np.full(rows, len(coded[k]))] for k in range(3))
    orders = {PLAIN: (None, 0, None, 1, None, 2), PSM: (p, 0, s, 2, m, 1), SPM: (s, 2, p, 0, m, 1)}
    layout = np.zeros((2, rows, 6), np.int64)
    for f, order in orders.items():
        own = form == f
        for k, x in enumerate(order):
            if x is not None:
                layout[:, own, k] = np.stack(pieces[x] if isinstance(x, int) else x)[:, own]
    out = _gathered(np.concatenate([raw, np.frombuffer(b"".join(coded), np.uint8)]), *layout)
    plain = form == PLAIN
    return {
        "n": pa.array(n), "form": pa.array(
            np.array(FORMS, object)[form], pa.string()
        ), "prefix_chars": pa.array(chars[0], mask=plain), "middle_chars": pa.array(chars[1], mask=plain),
        "output": _strings(*out),
    }


def rebuilt(column: pa.Array, form: np.ndarray, marks: tuple[str, str, str]) -> pa.Array:
    """The texts that outputs were made of; null where an output has not the marks of its form in their order."""
    raw, starts = _bytes(column)
    rows = len(starts) - 1
    at = np.full((3, rows), -1)
    for k, mark in enumerate(marks):
        found = _places(raw, starts, mark.encode())
        of = np.searchsorted(starts, found, "right") - 1
        at[k, of[::-1]] = found[::-1]  # the first of each text
    sizes = [len(m.encode()) for m in marks]
    layout, bad = np.zeros((2, rows, 3), np.int64), np.zeros(rows, bool)
    # The pieces in the order in which they stand, and the place of each in the text.
    for f, order, back in ((PSM, (0, 1, 2), (0, 2, 1)), (SPM, (1, 0, 2), (1, 2, 0))):
        own = form == f
        first, second, third = (at[k][own] for k in order)
        ends = (second, third, starts[1:][own])
        bad[own] = (first != starts[:-1][own]) | (second < first) | (third < second)
        stand = [(at[k][own] + sizes[k], end) for k, end in zip(order, ends, strict=True)]
        for place, piece in enumerate(back):
            a, z = stand[piece]
            layout[0, own, place], layout[1, own, place] = a, np.maximum(z - a, 0)
    plain = form == PLAIN
    layout[0, plain, 0], layout[1, plain, 0] = starts[:-1][plain], np.diff(starts)[plain]
    layout[1, bad] = 0
    text = _strings(*_gathered(raw, *layout))
    return pc.if_else(pa.array(bad), pa.scalar(None, pa.large_string()), text) if bad.any() else text


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again between any texts: different, not empty, and none ends with what one begins with."""
    if len(set(marks)) != 3 or not all(marks) or any(x in y for x in marks for y in marks if x != y):
        raise ValueError("marks must be three different strings, none within another")
    if any(x.endswith(y[:k]) for x in marks for y in marks for k in range(1, len(y)) if k < len(x)):
        raise ValueError("no mark may end with what a mark begins with")
    return marks


def _chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `limit` bytes in a column, a row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.unique(np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1, [0, batch.num_rows]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(a, z - a)


def draws(doc_id: Column, seed: int = 7) -> Column:
    """Four numbers below 2^32 for a document: the first groups of eight digits of the sha256 of seed and id; a null id counts as the empty string."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(
    docs: DataFrame,
    unit: str = "line",
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    marks: tuple[str, str, str] = MARKS,
    chunk_bytes: int = 4 << 20
) -> DataFrame:
    """doc_id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars and output of each row of docs (doc_id, text; others are ignored).

    unit is line, word (with the white space before it) or character; rate: so many of a hundred documents are cut, spm: so
    many of a hundred of these in the order suffix, prefix, middle. A null or empty text and a text that holds a mark is
    plain: its output is the text, its prefix_chars and middle_chars are null. Rows of one id are cut alike, repeated rows
    give one row each, an empty table gives an empty result. Long texts are whole; a task needs about forty times the
    bytes of a chunk, which holds at least one text.
    """
    if unit not in UNITS:
        raise ValueError(f"no unit {unit!r}; there are {', '.join(UNITS)}")
    marks = _checked(marks)

    def run(batches):
        for batch in _chunks(batches, "text", chunk_bytes):
            h = np.array(batch.column("h").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, 4)
            found = cut(batch.column("text"), h, unit, rate, spm, marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(x.cast(pa.string()) if k == "output" else x for k, x in found.items())], names=["doc_id", *found]
            )

    drawn = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), draws(F.col("doc_id"), seed).alias("h")
    )
    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(found: DataFrame, marks: tuple[str, str, str] = MARKS, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The rows of fill_in_middle with a column `restored`: the text, rebuilt from output and form alone.

    Null where an output has not its form's marks in order; a null output counts as empty, an unknown form as plain.
    """
    marks = _checked(marks)
    kept = found.drop("restored")
    schema = kept.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        for batch in _chunks(batches, "output", chunk_bytes):
            form = pc.fill_null(pc.index_in(batch.column("form").cast(pa.string()), pa.array(FORMS)), PLAIN).to_numpy(zero_copy_only=False)
            text = rebuilt(batch.column("output"), form, marks)
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], names=[*batch.schema.names, "restored"])

    return kept.mapInArrow(run, f"{schema},restored:string")


#: The rows of op12 in DuckDB.
SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS parts, sha256('7:' || doc_id::VARCHAR) AS h FROM documents
), numbers AS (
    SELECT *, len(parts) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), pieces AS (
    SELECT *, array_to_string(parts[1:a], '') AS prefix, array_to_string(parts[a + 1:b], '') AS middle, array_to_string(parts[b + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(prefix || middle || suffix) AS restored_sha256
FROM pieces
"""
