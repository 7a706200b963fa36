import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tracewright.llm import ppm


def held(i, n=7):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == 2


def brute(rows, order):
    """Scores by walking each text symbol by symbol."""
    lower = lambda t: (t or "").encode().lower()
    framed = lambda t: b"\xfe" * order + lower(t) + b"\xff"
    tables, words = [defaultdict(Counter) for _ in range(order + 1)], Counter()
    for i, t in rows:
        if not held(i):
            words.update([*lower(t).split(), None])
            b = framed(t)
            for p in range(order, len(b)):
                for k in range(order + 1):
                    tables[k][b[p - k : p]][b[p]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in rows:
        b, score = framed(t), 0.0
        for p in range(order, len(b)):
            excluded, found = set(), False
            for k in range(order, -1, -1):
                own = {s: c for s, c in tables[k].get(b[p - k : p], {}).items() if s not in excluded}
                if own and not found:
                    total = sum(own.values()) + len(own)
                    found = b[p] in own
                    score += math.log10((own[b[p]] if found else len(own)) / total)
                    excluded |= own.keys()
            if not found:
                score -= math.log10(256 - len(excluded))
        ws = [*lower(t).split(), None]
        out.append(
            (i, held(i), len(ws), sum(words[w] > 0 for w in ws), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws), score)
        )
    return out


@pytest.mark.parametrize(("order", "slots"), [(1, 4096), (4, 4096), (5, 2)])
def test_like_brute_force(odd, odd_rows, order, slots, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_SLOTS", slots)  # few slots: each in several places
    rows = [
        (r[0], r[1][: 40_000 if order == 5 else 3000] if r[1] else r[1]) for r in odd_rows
    ] + [(50 + k % 2, "the same row, many times") for k in range(40)]
    spark = odd.sparkSession
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, slot string, value string")
    got = sorted(
        ppm.score(df, order=order, block_bytes=2000, slot_bytes=1000 if order == 5 else 32 << 20).collect(),
        key=lambda r: (r.doc_id or -1, r.score)
    )
    want = sorted(brute(rows, order), key=lambda r: (r[0] or -1, r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert (g.base_score, g.score) == pytest.approx(w[5:], abs=1e-6)


def test_long_texts_and_nothing_to_learn(odd, odd_rows, empty, spark):
    assert ppm.score(odd).count() == len(odd_rows)
    assert ppm.score(empty).count() == 0
    i = next(i for i in range(1000) if held(i))
    r = ppm.score(spark.createDataFrame([(i, "ab c")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score == pytest.approx(5 * math.log10(1 / 256))


def test_asked_keys_cost_about_a_sort():
    def least(f, *args):
        took = []
        for _ in range(3):
            begin = time.process_time()
            f(*args)
            took.append(time.process_time() - begin)
        return min(took)

    texts = [f"word{i % 977} of the text, {i % 31}".encode() for i in range(40_000)]
    strings = ppm.grams(texts, 5)
    found = ppm.asked_keys(texts, 5)
    words = {xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split()} | {ppm.END_WORD}
    assert found[0].tolist() == sorted(set(strings.tolist())) and found[1].tolist() == sorted(words)
    assert len(ppm.distinct(strings[:0])) == 0
    assert least(ppm.distinct, strings) < 3 * least(np.sort, strings)
