import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import simple8b, tokens
from tracewright.llm.token_counts import count_tokens
from tracewright.llm.token_files import read_tokens, with_starts, write_tokens

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def library(texts):
    return [e.ids for e in tokens.tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,'abcZ1²é"))), max_size=4))
def test_cuts_encode_like_the_whole(texts):
    got = tokens.Encoder(PATH, PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(texts)


@pytest.mark.parametrize("most", [0, 3])
def test_small_memories(most):
    texts = ["a b c d a", "x<|endoftext|>y <|endoftext|>", "a b, c. d"] * 3
    e = tokens.Encoder(PATH, PATTERN, most)
    for t in texts:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == library([t])[0]


def test_blocks_are_cut_whole_and_pre_tokens_merged_once(monkeypatch):
    def never(pattern):
        raise AssertionError("a text was cut by itself")

    asked, merged = [], tokens.merged
    monkeypatch.setattr(tokens, "_pattern", never)
    monkeypatch.setattr(tokens, "merged", lambda pre, path: asked.append(pre) or merged(pre, path))
    texts = ["It's a (small) word, a word.", "", "a  word\n\n<|endoftext|>word<|endoftext|> ", "<|endof", "text|>, it's é1²\u2028x"]
    e = tokens.Encoder(PATH, PATTERN)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library(texts)
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) and {" word", ",", "<|endoftext|>"} < set(asked[0])


def test_other_patterns_cut_alike():
    texts = ["a b, c. d's", "x<|endoftext|>y  z", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(PATH, f"(?:{PATTERN})").encode(texts)] == library(texts)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=3000),
    st.sampled_from([1, 7, 64, 1024])
)
def test_simple8b_round_trip(ids, block):
    words, offsets = simple8b.encode(np.array(ids, dtype=np.uint64), block)
    assert simple8b.decode(words, len(ids), offsets, block).tolist() == ids
    assert len(offsets) == -(-len(ids) // block) + 1 and offsets[-1] == len(words)


def test_simple8b_packs_and_refuses():
    assert len(simple8b.encode(np.zeros(60, np.uint64))[0]) == 1 and len(simple8b.encode(np.full(4, 2**15 - 1, np.uint64))[0]) == 1
    with pytest.raises(ValueError):
        simple8b.encode(np.array([1 << 60], np.uint64))
    with pytest.raises(ValueError):
        simple8b.unpack(b"notashard" + bytes(40))


def test_simple8b_keeps_wide_ids():
    ids = [2**32, 5, 2**60 - 1, 0, 2**32 - 1]
    words, offsets = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, len(ids), offsets).tolist() == ids
    doc_ids, counts, back, nulls = simple8b.unpack(simple8b.pack(np.array([-(2**63), 7]), np.array([1, 0, 4]), np.array(ids, np.uint64), 1))
    assert (doc_ids.tolist(), counts.tolist(), back.tolist(), nulls) == ([-(2**63), 7], [1, 0, 4], ids, 1)


def test_null_and_least_ids_differ(spark):
    docs = spark.createDataFrame([(None, "a b"), (-(2**63), "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    assert [
        r.doc_id for r in sorted(read_tokens(write_tokens(docs, PATH, PATTERN, shard_ids=2)).collect(), key=lambda r: r.start)
    ] == [None, None, -(2**63), 3]


def test_counts_on_odd_rows(odd, odd_rows, empty):
    got = sorted(
        (str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd, PATH, PATTERN, limit=30, block_bytes=5000).collect()
    )
    texts = [r[1] or "" for r in odd_rows]
    want = sorted((str(r[0]), len(t.encode()), len(i), len(i) > 30) for r, t, i in zip(odd_rows, texts, library(texts), strict=True))
    assert got == want
    assert count_tokens(empty, PATH, PATTERN).count() == 0


def test_files_round_trip(odd, odd_rows, empty):
    manifest = write_tokens(odd, PATH, PATTERN, shard_ids=50)
    got = sorted(read_tokens(manifest).collect(), key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, row, ids in zip(got, order, library([x[1] or "" for x in order]), strict=True):
        ids = ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert with_starts(manifest).count() > 2
    assert read_tokens(write_tokens(empty, PATH, PATTERN)).count() == 0


def test_packed_rows_are_linear_in_the_texts(spark, monkeypatch):
    from tracewright.llm import token_counts

    monkeypatch.setattr(token_counts, "MOST_SLOTS", 6)
    rows, seen = {}, {}
    frequencies = token_counts.pre_token_frequencies

    def counted(docs, path, pattern, block_bytes, slots, places):
        found = frequencies(docs, path, pattern, block_bytes, slots, places)
        seen["now"] = (found.count(), slots, places)
        return found

    monkeypatch.setattr(token_counts, "pre_token_frequencies", counted)
    for n in (40, 160):
        texts = [" ".join(f"w{(i * 37 + j * 11) % 5000} hot" for j in range(200)) for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH, PATTERN, block_bytes=6000, slot_bytes=8000).collect()}
        assert got == {i: len(ids) for i, ids in enumerate(library(texts))}
        rows[n] = seen["now"]
    assert rows[160][1] == 6 and rows[160][2] > rows[40][2] > 1 and rows[160][0] <= 4.2 * rows[40][0]
