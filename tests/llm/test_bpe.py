import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import bpe, pre_tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def cut(texts):
    coded = [t.encode() for t in texts]
    raw = b"".join(coded)
    begin = pre_tokens.cut(np.frombuffer(raw, np.uint8), np.cumsum([len(x) for x in coded]), pre_tokens.classes()).tolist()
    return [raw[a:b].decode() for a, b in zip(begin, [*begin[1:], len(raw)], strict=False)]


@settings(max_examples=500, deadline=None)
@given(
    st.lists(
        st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x4FF), st.sampled_from(" '\n\t　.,srevelmdtZ1²é日🙂"))),
        max_size=4
    )
)
def test_cuts_as_the_pattern_does(texts):
    assert pre_tokens.RULE == public_tokenizers.PATTERN
    assert cut(texts) == [x for t in texts for x in regex.findall(public_tokenizers.PATTERN, t)]


def test_classes_are_the_library_s(library):
    table = pre_tokens.classes()
    for x in ("a", "é", "日", "1", "²", " ", "　", "\x85", "\x1c", ".", "՘"):
        kinds = [
            k for k,
            p in (
                (pre_tokens.LETTER, r"\p{L}"), (pre_tokens.NUMBER, r"\p{N}"), (pre_tokens.SPACE, r"\s")
            ) if tiktoken.Encoding("x", pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(x)
        ]
        assert [table[ord(x)]] == (kinds or [pre_tokens.OTHER])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefginorstuv 'éß日", min_size=1, max_size=200))
def test_long_words_merge_like_the_library(text):
    whole = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})
    assert bpe.long_ids(text.encode(), bpe.ranks_of(PATH)) == whole.encode_ordinary(text)


def test_encodes_and_decodes_odd_rows(spark, odd, odd_rows, empty, library):
    more = [
        (20 + k, t) for k,
        t in enumerate(
            ["x" * 61, "y" * 62, "ab" * 5000, "日本語" * 40, "aaa aaaa aaaaa", "'s 's''s I'll've we'LL", "\x00\x01", "🙂🙂 é é", " ", "\n"]
        )
    ]
    docs = odd.select("doc_id", "text", "block", "slot", "h").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True
    )
    got = bpe.decode(bpe.encode(docs, PATH, block_bytes=3000, slot_bytes=100_000, words=50), PATH).collect()
    texts = [(r[0], r[1] or "") for r in odd_rows] + more
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(
        ((i, library.encode_ordinary(t), t.encode()) for i, t in texts), key=key
    )
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    assert bpe.decode(
        spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH
    ).orderBy("doc_id").collect()[0].decoded is None


def test_query_matches_the_library(spark, library):
    import hashlib

    from tracewright.llm.queries import op11_byte_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op11_byte_bpe(spark, folder).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {
        i: (len(e := library.encode_ordinary(t)), sha(" ".join(map(str, e)).encode()), sha(t.encode())) for i, t in texts.items()
    }


def test_refuses_ranks_that_one_pass_would_get_wrong(tmp_path):
    import base64

    single = [(bytes([b]), b) for b in range(256)]
    for extra in ([(b"abc", 300)], [(b"bc", 300), (b"abc", 290), (b"ab", 310)]):
        path = tmp_path / f"{len(extra)}.ranks"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in [*single, *extra]))
        if len(extra) == 1:
            with pytest.raises(ValueError):
                bpe.rank_map(str(path))
    with pytest.raises(ValueError):
        (tmp_path / "few").write_text("YQ== 0\n")
        bpe.rank_map(str(tmp_path / "few"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(250, 260), st.integers(0, 1 << 22)), max_size=300))
def test_codes_round_trip(codes):
    assert bpe._unpacked_codes(bpe._packed_codes(np.array(codes, np.int64)), len(codes)).tolist() == codes
    dense = np.unique(codes, return_inverse=True)[1] if codes else np.empty(0, np.int64)
    anew, order = bpe._by_frequency(dense)
    assert order[anew].tolist() == dense.tolist() and (np.diff(np.bincount(anew)) <= 0).all()
