"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

1. Cues: words and word beginnings that occur almost only in toxic texts. Candidates come from a bounded sample of
   labelled rows; their counts by mark cover all labelled training rows.
2. Labelled tokens: a token with a cue in a toxic text is toxic, all others of labelled texts are not. Segments of
   tokens from a bounded sample of labelled rows (`most_rows`, a parameter) train a two-state chain.
3. Every text is tagged whole: forward-backward marginals over all its tokens, at a cost linear in its length. Spans of
   likely tokens are the offending offsets; the highest marginal and the expected number of toxic tokens give the
   document's score, by a logistic curve fitted on the same sample.

Scores see the text alone; labels only choose and mark training rows.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

_LOWER = str.maketrans(common.UPPER, common.LOWER)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: What a byte of UTF-8 becomes before words are split at spaces: those of words stay, A-Z are lower-cased.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Lengths of word beginnings that are features, the size of the weight table, tokens in a training segment.
STEMS, WIDTH, SEGMENT = (3, 4, 5, 6), 1 << 20, 48
#: What a worker remembers beside its block: words, and names counted before they are passed on; most words of a corpus occur once.
KNOWN, COUNTED = 50_000, 120_000


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, all in UTF-8: those that _WORD finds in the lower-cased text."""
    return text.translate(_BYTES).split()


_hash = xxhash.xxh32_intdigest  # of a string: of its UTF-8


def token_features(word: str) -> list[int]:
    """Columns of the weight table for one word: itself, its beginnings and its last three letters."""
    names = [f"w{word}", f"e{word[-3:]}"] + [f"{n}{word[:n]}" if len(word) >= n else f"{n}" for n in STEMS]
    return [_hash(x) % WIDTH for x in names]


def cue_names(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in STEMS[1:] if len(word) >= n]


# --- the chain -------------------------------------------------------------------------------------------------


class Chain:
    """Two states; a token's potential for state 1 over 0 is e, moves have 2x2 potentials, `first` is the start's."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: float, curve: np.ndarray):
        self.weights, self.moves, self.first, self.curve = weights, moves, first, curve
        self.known: dict[bytes | str, float] = {}

    def potentials(self, words: list[bytes] | list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        new = list(set(words).difference(known))
        for i in range(0, len(new), 4096):
            own = new[i : i + 4096]
            columns = [k for w in own for k in token_features(w.decode() if isinstance(w, bytes) else w)]
            known.update(zip(own, self.weights[columns].reshape(len(own), -1).sum(1).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(state 1) of every token of texts laid end to end.

        Messages are ratios of the two states, so each step is a map r -> (a r + b) / (c r + d); maps of equal pieces are
        composed for all pieces at once, then the pieces' first ratios are chained, then all pieces run at once.
        """
        n = len(e)
        if not n:
            return np.zeros(0)
        odds, (a, b, c, d) = np.exp(np.clip(e, -30, 30)), np.exp(self.moves).ravel()  # a 0->0, b 0->1, c 1->0, d 1->1
        ends = np.cumsum(lengths[lengths > 0])
        starts = ends - lengths[lengths > 0]
        top, low = np.stack([odds * d, odds * b]), np.stack([np.full(n, c), np.full(n, a)])
        top[0, starts], top[1, starts], low[0, starts], low[1, starts] = 0, odds[starts] * np.exp(self.first), 0, 1
        forward = _chained(top, low, 1.0)
        after = np.append(odds[1:], 1.0)
        top, low = np.stack([after * d, np.full(n, c)]), np.stack([after * b, np.full(n, a)])
        top[0, ends - 1], top[1, ends - 1], low[0, ends - 1], low[1, ends - 1] = 0, 1, 0, 1
        backward = _chained(top[:, ::-1], low[:, ::-1], 1.0)[::-1]
        ratio = forward * backward
        return ratio / (1 + ratio)

    def score(self, p: np.ndarray) -> tuple[float, float]:
        """The document's features: the log odds of its likeliest token, and its expected toxic tokens (log)."""
        if not len(p):
            return -12.0, 0.0
        m = float(np.clip(p.max(), 6e-6, 1 - 6e-6))
        return float(np.log(m / (1 - m))), float(np.log1p(p[p > 0.2].sum()))


def _chained(top: np.ndarray, low: np.ndarray, first: float, piece: int = 64) -> np.ndarray:
    """All values of r[t] = (top0 r + top1) / (low0 r + low1), r[-1] = first."""
    n = top.shape[1]
    rows = -(-n // piece)
    pad = rows * piece - n
    grid = [
        np.pad(x, (0, pad), constant_values=v).reshape(rows, piece) for x, v in ((top[0], 1.0), (top[1], 0.0), (low[0], 0.0), (low[1], 1.0))
    ]
    w, x, y, z = (g[:, 0].copy() for g in grid)
    for t in range(1, piece):
        a, b, c, d = (g[:, t] for g in grid)
        w, x, y, z = a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z
        s = 1.0 / (w + x + y + z)
        w, x, y, z = w * s, x * s, y * s, z * s
    heads, r = np.empty(rows), first
    for i, (a, b, c, d) in enumerate(zip(w.tolist(), x.tolist(), y.tolist(), z.tolist(), strict=True)):
        heads[i] = r
        r = (a * r + b) / (c * r + d)
    out = np.empty((rows, piece))
    r = heads
    for t in range(piece):
        r = (grid[0][:, t] * r + grid[1][:, t]) / (grid[2][:, t] * r + grid[3][:, t])
        out[:, t] = r
    return out.ravel()[:n]


def chain_gradient(
    theta: np.ndarray, features: np.ndarray, code: np.ndarray, y: np.ndarray, mask: np.ndarray, rows: int = 1024
) -> np.ndarray:
    """Gradient of the segments' negative log likelihood, by forward and backward messages over `rows` segments at once.

    theta: weights, the four moves, the start. features: each word's columns of the weights. code, y, mask: word, label
    and whether there is a token, a row a segment.
    """
    own, g, by_word = theta[:-5][features].sum(1), np.zeros_like(theta), np.zeros(len(features))
    for i in range(0, len(code), rows):
        g[-5:] += _messages(theta, own, code[i : i + rows], y[i : i + rows], mask[i : i + rows], by_word)
    g[:-5] = np.bincount(features.ravel(), weights=np.repeat(by_word, features.shape[1]), minlength=len(theta) - 5)
    return g


def _messages(theta: np.ndarray, potentials: np.ndarray, code: np.ndarray, y: np.ndarray, mask: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    """Gradients of the moves and the start over these segments; those of the words' potentials are added to by_word."""
    s, t = code.shape
    e = np.clip(potentials[code], -30, 30)
    move, start = np.exp(theta[-5:-1]).reshape(2, 2), theta[-1]
    psi = np.stack([np.ones_like(e), np.exp(e)], axis=2)
    alpha, beta = np.empty((t, s, 2)), np.ones((t, s, 2))
    alpha[0] = np.stack([np.ones(s), np.full(s, np.exp(start))], axis=1) * psi[:, 0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for k in range(1, t):
        own = (alpha[k - 1] @ move) * psi[:, k]
        alpha[k] = np.where(mask[:, k, None] > 0, own / own.sum(1, keepdims=True), alpha[k - 1])
    for k in range(t - 2, -1, -1):
        own = (beta[k + 1] * psi[:, k + 1]) @ move.T
        beta[k] = np.where(mask[:, k + 1, None] > 0, own / own.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    p = (p / p.sum(2, keepdims=True))[:, :, 1].T
    diff = (p - y) * mask
    by_word += np.bincount(code.ravel(), weights=diff.ravel(), minlength=len(by_word))
    both = mask[:, 1:] * mask[:, :-1]
    joint = alpha[:-1, :, :, None] * move[None, None] * (psi[:, 1:].transpose(1, 0, 2) * beta[1:])[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    seen = np.array(
        [
            [((1 - y[:, :-1]) * (1 - y[:, 1:]) * both).sum(), ((1 - y[:, :-1]) * y[:, 1:] * both).sum()],
            [(y[:, :-1] * (1 - y[:, 1:]) * both).sum(), (y[:, :-1] * y[:, 1:] * both).sum()]
        ]
    )
    return np.append(((joint * both.T[:, :, None, None]).sum((0, 1)) - seen).ravel(), diff[:, 0].sum())


def fit_chain(
    segments: list[tuple[list[str], list[int]]], steps: int = 70, rate: float = 0.25, l2: float = 2e-4
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, moves and start of the chain that makes the segments' labels likeliest (Adam on the exact gradient)."""
    s, t = len(segments), SEGMENT
    words: dict[str, int] = {}
    code, y, mask = np.zeros((s, t), dtype=np.int64), np.zeros((s, t)), np.zeros((s, t))
    for i, (own, labels) in enumerate(segments):
        n = len(own)
        code[i, :n], y[i, :n], mask[i, :n] = [words.setdefault(w, len(words)) for w in own], labels, 1
    features = np.array([token_features(w) for w in words] or [[0] * (2 + len(STEMS))])
    used, features = np.unique(features, return_inverse=True)
    features = features.reshape(-1, 2 + len(STEMS))
    theta = np.zeros(len(used) + 5)
    theta[-5:] = [0.0, -2.0, -1.0, 0.0, -2.0]
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), max(mask.sum(), 1.0)
    for step in range(1, steps + 1):
        g = chain_gradient(theta, features, code, y, mask) / total * 50 + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(WIDTH, dtype=np.float32)
    weights[used] = theta[:-5]
    return weights, theta[-5:-1].reshape(2, 2), float(theta[-1])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic curve on two features by Newton steps, with a little ridge; slopes stay nonnegative."""
    z = np.column_stack([x, np.ones(len(x))])
    beta = np.array([0.5, 0.5, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        beta = beta - np.linalg.solve((z * w[:, None]).T @ z + 0.5 * np.eye(3), z.T @ (weight * (p - y)) + 0.5 * beta * [1, 1, 0])
        beta[:2] = np.maximum(beta[:2], 0.0)
    return beta


# --- training --------------------------------------------------------------------------------------------------


#: Places of the sieve that candidates are told by before they are counted, whatever their number.
SIEVE = 1 << 20


def _sieved(names: DataFrame) -> np.ndarray:
    """Which places of the sieve (crc32 modulo SIEVE) some name falls on: at most SIEVE small rows reach the driver."""
    out = np.zeros(SIEVE, bool)
    out[[r.at for r in names.select((F.crc32(F.col("name").cast("binary")) % SIEVE).alias("at")).distinct().toLocalIterator()]] = True
    return out


def _bytes(texts: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts in UTF-8; null as empty."""
    return texts.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _cue_counts(sieve: np.ndarray | None):
    """For each task: how many of its texts of either mark hold each cue name (that passes the sieve). One row a name, whatever the number of texts."""

    def run(batches):
        held = {0: Counter(), 1: Counter()}

        @lru_cache(maxsize=KNOWN)
        def names_of(word: bytes) -> tuple[str, ...]:
            return tuple(x for x in cue_names(word.decode()) if sieve is None or sieve[zlib.crc32(x.encode()) % SIEVE])

        def rows():
            names = list({**held[0], **held[1]})
            for i in range(0, len(names), 20_000):
                own = names[i : i + 20_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": own,
                        "clean": pa.array([held[0][x] for x in own], pa.int64()),
                        "toxic": pa.array([held[1][x] for x in own], pa.int64())
                    }
                )

        for table in common.text_blocks(batches, 1 << 20):
            for text, mark in zip(_bytes(table.column("text")), table.column("toxic").to_pylist(), strict=True):
                held[mark].update({x for w in set(words_of(text)) for x in names_of(w)})
                if len(held[0]) + len(held[1]) > COUNTED:
                    yield from rows()
                    held = {0: Counter(), 1: Counter()}
        yield from rows()

    return run


def _counted(texts: DataFrame, sieve: np.ndarray | None = None) -> DataFrame:
    return texts.select("text", "toxic").mapInArrow(_cue_counts(sieve), "name string, clean long, toxic long").groupBy("name").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )


def find_cues(sample: DataFrame, labelled: DataFrame, least: int = 4, ratio: float = 4.0, purity: float = 0.8) -> DataFrame:
    """A written table of names that at least `least` toxic texts hold, `purity` of all labelled texts that do.

    Candidates come from the bounded sample (as many as its toxic texts have words, at most): names `ratio` times as
    frequent in its toxic texts as in the others. They stay a table; their counts over all labelled texts meet them by a
    join, and a sieve of fixed size leaves out most other names before.
    """
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    often = F.col("toxic") * sizes.get(0, 0) >= ratio * sizes.get(1, 0) * F.col("clean")
    candidates = common.written(_counted(sample).where((F.col("toxic") >= least) & often).select("name"), "cue-candidates")
    counts = _counted(labelled, _sieved(candidates)).join(candidates, "name", "left_semi")
    return common.written(
        counts.where((F.col("toxic") >= least) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean")))).select("name"), "cues"
    )


def with_cues(texts: DataFrame, cues: DataFrame) -> DataFrame:
    """texts (h, text, toxic) with `cues`: those of a toxic text's words that have a name among the cues."""

    def run(batches):
        for table in common.text_blocks(batches, 1 << 20):
            for h, text in zip(table.column("h").to_pylist(), table.column("text").to_pylist(), strict=True):
                pairs = [(w, x) for w in sorted(set(_WORD.findall(text.translate(_LOWER)))) for x in cue_names(w)]
                for i in range(0, len(pairs), 20_000):
                    own = pairs[i : i + 20_000]
                    yield pa.RecordBatch.from_pydict(
                        {"h": pa.array([h] * len(own), pa.int64()), "word": [w for w, _ in own], "name": [x for _, x in own]}
                    )

    named = texts.where("toxic = 1").select("h", "text").mapInArrow(run, "h long, word string, name string")
    found = named.join(cues, "name", "left_semi").groupBy("h").agg(F.collect_set("word").alias("cues"))
    return texts.join(found, "h", "left")


def segments_of(text: str, mark: int, cues: set[str], each: int) -> list[tuple[list[str], list[int]]]:
    """At most `each` segments of a labelled text, those with the least hashes wherever they stand; of a toxic one, of those that hold a cue word."""
    own = _WORD.findall(text.translate(_LOWER))
    flags = [int(mark == 1 and w in cues) for w in own]
    starts = [s for s in range(0, len(own), SEGMENT) if mark != 1 or any(flags[s : s + SEGMENT])]
    chosen = sorted(starts, key=lambda s: (zlib.crc32(" ".join(own[s : s + SEGMENT]).encode()), s))[:each]
    return [(own[s : s + SEGMENT], flags[s : s + SEGMENT]) for s in chosen]


def _joined(docs: DataFrame, marks: DataFrame, on: list[str], most: int = 500_000) -> DataFrame:
    """docs with their marks (on, toxic): broadcast if they are no more than `most` rows, else shuffled by the keys."""
    return docs.join(F.broadcast(marks) if marks.count() <= most else marks, on)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, most_cue_rows: int = 20_000, segments: int = 3) -> Chain | None:
    """The chain of these labelled rows; None if they lack one of the marks.

    Candidates for cues come from at most `most_cue_rows` texts, segments (`segments` a text at most, by their hashes,
    wherever they stand) and curve from at most `most_rows` of these (half of each mark, least hashes first); a text stands in these samples once, however
    often its row or text repeats. The cues' counts are over all labelled rows, whose ids find their texts by a join:
    at the scan, without moving a text, for up to half a million labels, else by a shuffle on the id.
    """
    marks = labels.where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
    ).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    ids = common.written(_joined(docs.select("id", "h"), marks, ["id"]).groupBy("h", "toxic").agg(F.min("id").alias("id")), "labelled")
    picked = [ids.where(F.col("toxic") == mark).orderBy("h", "id").limit(most_cue_rows // 2) for mark in (1, 0)]
    picked = common.written(picked[0].unionByName(picked[1]), "toxic-sample")
    small = [picked.where(F.col("toxic") == mark).orderBy("h", "id").limit(most_rows // 2) for mark in (1, 0)]
    if not all(x.take(1) for x in small):
        return None

    with_text = lambda chosen: _joined(docs, chosen.select("id", "h", "toxic"), ["id", "h"]).select("text", "toxic", "h")
    once = lambda chosen: with_text(chosen).groupBy("h", "toxic").agg(F.min("text").alias("text"))
    cues = find_cues(once(picked), with_text(ids))

    def cut(batches):
        for batch in batches:
            out = []
            for text, mark, own in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "cues")), strict=True):
                out += [(mark, w, y) for w, y in segments_of(text, mark, set(own or ()), segments)]
            if out:
                yield pa.RecordBatch.from_pydict(
                    {
                        "mark": pa.array([x[0] for x in out], pa.int32()),
                        "words": [x[1] for x in out],
                        "y": pa.array([x[2] for x in out], pa.list_(pa.int32()))
                    }
                )

    texts = common.written(once(common.written(small[0].unionByName(small[1]), "toxic-sample")), "toxic-texts")
    got = with_cues(texts, cues).select("text", "toxic", "cues").mapInArrow(cut, "mark int, words array<string>, y array<int>").toArrow()
    chosen = [
        (list(map(sys.intern, words)), y)  # of each word one copy
        for part in got.to_batches(256)
        for words, y in zip(part.column("words").to_pylist(), part.column("y").to_pylist(), strict=True)
    ]
    chain = Chain(*fit_chain(chosen), np.zeros(3))
    del got, chosen
    rows = score_texts(
        texts.select(F.col("h").alias("doc_id"), "text", "toxic"), chain, keep="toxic"
    ).select("top", "many", "toxic").collect()
    x, y = np.array([[r["top"], r["many"]] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    share = ids.agg(F.avg("toxic")).first()[0]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    chain.curve = fit_curve(x, y, weight)
    chain.known = {}
    return chain


# --- scoring ---------------------------------------------------------------------------------------------------

#: A worker's chain stays for its next tasks, with the words it knows.
_CHAINS: dict[str, Chain] = {}


def score_texts(docs: DataFrame, chain: Chain, keep: str | None = None, likely: float = 0.5) -> DataFrame:
    """Each row's score, its two features, and its spans (first and last offset of characters, and the highest marginal)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((chain.weights, chain.moves, chain.first, chain.curve))  # WIDTH weights, whatever the input
    extra = [keep] if keep else []

    key = uuid.uuid4().hex

    def run(batches):
        chain = _CHAINS.get(key)
        if chain is None:
            _CHAINS.clear()
            chain = _CHAINS[key] = Chain(*sent.value)
        for table in common.text_blocks(batches, 1 << 20):
            texts = _bytes(table.column("text"))
            cut = [words_of(x) for x in texts]
            lengths = np.array([len(x) for x in cut])
            p = chain.marginals(chain.potentials([w for x in cut for w in x]), lengths)
            tops, many, spans, at = [], [], [], 0
            for text, n in zip(texts, lengths.tolist(), strict=True):
                own = p[at : at + n]
                at += n
                a, b = chain.score(own)
                tops.append(a)
                many.append(b)
                found = []
                hits = np.flatnonzero(own >= likely)
                if len(hits):
                    places = [m.span() for m in _WORD.finditer(text.decode().translate(_LOWER))]
                    for group in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
                        found.append({"start": places[group[0]][0], "end": places[group[-1]][1], "p": float(own[group].max())})
                spans.append(found)
            z = np.column_stack([tops, many, np.ones(len(tops))]) @ chain.curve
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            columns = {
                "doc_id": table.column("doc_id").cast(pa.int64()),
                "score": pa.array(score),
                "top": pa.array(tops, pa.float64()),
                "many": pa.array(many, pa.float64()),
                "spans": pa.array(spans, kind)
            }
            if keep:
                columns[keep] = table.column(keep)
            yield from pa.table(columns).to_batches()

    kinds = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in extra)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(
        run, "doc_id long, score double, top double, many double, spans array<struct<start:int,end:int,p:double>>" + kinds
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted, spans of each row of docs (doc_id, text; others are ignored).

    Only rows whose crc32(doc_id as text) mod folds is not `held` are learnt from. Null and empty texts have no tokens
    and get the score of a text without any sign. Repeated rows get equal scores; labels of one id that differ count as
    toxic. Without labelled rows of both marks all scores are 0.
    """
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out_of = common.crc_mod(F.col("doc_id"), folds) == held
    chain = train(docs.where(~out_of).select("doc_id", "text"), labels)
    if chain is None:
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "text_hash",
            F.lit(0.0).alias("score"),
            F.array().cast("array<struct<start:int,end:int,p:double>>").alias("spans")
        )
    else:
        rows = score_texts(docs, chain, keep="text_hash")
    return rows.select(
        "doc_id",
        "text_hash",
        (common.crc_mod(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans"
    )
