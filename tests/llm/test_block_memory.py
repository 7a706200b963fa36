"""What a block's steps hold beside their results does not grow with the block."""

import tracemalloc
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from tracewright.llm import bpe, common, near_dedup, pre_tokens, tokens, toxicity


def test_cuts_hold_a_piece_at_a_time():
    texts = ["Grüße aus  Köln, it's 12° — ok\n\n" * k for k in (3000, 0, 1, 2000, 0, 0, 40, 9000)] * 12
    raw = [t.encode() for t in texts]
    ends, data = np.cumsum([len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8)
    table = pre_tokens.classes()
    tracemalloc.start()
    got = pre_tokens.cut(data, ends, table, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * got.nbytes + (12 << 20)
    for piece in (1, 100_000, len(data) + 1):
        assert np.array_equal(pre_tokens.cut(data, ends, table, piece), got)
    assert np.array_equal(got, np.concatenate([pre_tokens._cut(np.frombuffer(x, np.uint8), np.array([len(x)]), table) + e - len(x) for x, e in zip(raw, ends, strict=True) if x]))


def test_a_gradient_holds_some_segments_at_a_time():
    rng = np.random.default_rng(3)
    n, width, t = 6000, 500, 48
    features = rng.integers(0, width, (300, 6))
    code, mask = rng.integers(0, 300, (n, t)), (np.arange(t) < rng.integers(1, t + 1, (n, 1))).astype(float)
    y, theta = (rng.random((n, t)) < 0.2) * mask, rng.normal(0, 0.1, width + 5)
    tracemalloc.start()
    got = toxicity.chain_gradient(theta, features, code, y, mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert np.allclose(got, toxicity.chain_gradient(theta, features, code, y, mask, n), rtol=1e-9, atol=1e-9)


def test_words_of_bytes_are_those_of_the_text():
    every = "".join(map(chr, [*range(0x300), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x1F600]))
    for text in ("", " ", every, every[::-1], "Straße, DON'T_x9 Ünï\x1c\x1dcode", "aB" * 5):
        words = [w.decode() for w in toxicity.words_of(text.encode())]
        assert words == toxicity._WORD.findall(text.translate(toxicity._LOWER))


def test_short_texts_are_signed_some_at_a_time():
    texts = [f"w{i} x{i % 7}" for i in range(8000)] + ["", "a b c d e f g"]
    tracemalloc.start()
    got = near_dedup.signatures(texts, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for own, *rest in zip(got, near_dedup.signatures(texts[:100], {}), near_dedup.signatures(texts[100:], {}), strict=True):
        assert np.array_equal(own, np.concatenate(rest))


def test_cue_counts_remember_a_bounded_number_of_words():
    texts = [" ".join(f"{(i * 200 + k) * 7919 % 1_000_003:06d}q" for k in range(200)) for i in range(1500)]
    batches = [pa.RecordBatch.from_pydict({"text": texts, "toxic": [i % 2 for i in range(1500)]})]
    got, peak = Counter(), 0
    tracemalloc.start()
    for batch in toxicity._cue_counts(None)(iter(batches)):
        for name, clean, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name.endswith("1q"):
                got[name] += clean + toxic
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert got == Counter("=" + w for t in texts for w in t.split() if w.endswith("1q"))
    assert peak < 48 << 20


def test_a_chain_remembers_a_bounded_number_of_words():
    chain = toxicity.Chain(np.arange(toxicity.WIDTH, dtype=np.float32), np.zeros((2, 2)), 0.0, np.zeros(3))
    for i in range(12):
        words = [b"w%d" % k for k in range(i * 10_000, i * 10_000 + 10_000)] + [b"again"]
        e = chain.potentials(words)
        assert e[-1] == chain.weights[toxicity.token_features("again")].sum()
        assert len(chain.known) < 70_000


def test_an_encoder_remembers_a_bounded_number_of_groups():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.Encoder(path, public_tokenizers.PATTERN)
    for i in range(16):
        text = "again " + " ".join(f"k{k}" for k in range(i * 30_000, i * 30_000 + 30_000))
        got = encoder.encode([text])
        assert len(encoder.known) < 400_000
    assert got == [array("I", tokens.tokenizer(path).encode(text, add_special_tokens=False).ids).tobytes()]


def test_a_block_is_coded_a_piece_at_a_time():
    words = [f" w{i % 5003}" for i in range(1 << 20)]
    texts = ["".join(words[i : i + 4096]) for i in range(0, len(words), 4096)] + ["", None, "it's  é"]
    block = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    n = 2 * len(words)  # a word and its number
    tracemalloc.start()
    rows = list(bpe._number(block, 0, 3, 1, pre_tokens.classes()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * n + (24 << 20)
    head, *rest = rows
    assert np.frombuffer(common.unpacked(head["counts"]), "<i8").tolist() == [*[8192] * 256, 0, 0, 4]
    slots, own = np.frombuffer(common.unpacked(head["slots"]), "<u2"), {r["slot"]: [common.unpacked(r["words"]), np.frombuffer(common.unpacked(r["sizes"]), "<u4").tolist()] for r in rest}
    back = []
    for s in slots.tolist():
        data, sizes = own[s]
        size = sizes.pop(0)
        back.append(data[:size])
        own[s][0] = data[size:]
    codes = bpe._unpacked_codes(head["codes"], n + 4)
    assert b"".join(back[c] for c in codes.tolist()).decode() == "".join(t or "" for t in texts)
