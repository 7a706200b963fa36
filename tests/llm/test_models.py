"""Toxicity, near duplicates, archives and the pipeline."""

import io
import itertools
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tracewright.llm import common, near_dedup, toxicity, warc_zip
from tracewright.llm.components import components


def test_marginals_like_brute_force():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(np.zeros(toxicity.WIDTH, np.float32), np.array([[0.3, -1.2], [-0.5, 0.9]]), -1.0, np.zeros(3))
    lengths = np.array([3, 0, 1, 150, 70, 64, 128])
    e = rng.normal(0, 4, lengths.sum())
    got, at, moves = chain.marginals(e, lengths), 0, np.exp(chain.moves)
    for n in lengths:
        own = e[at : at + n]
        psi = np.stack([np.ones(n), np.exp(own)], 1)
        alpha, beta = np.ones((n, 2)), np.ones((n, 2))
        for t in range(n):
            alpha[t] = (np.array([1, np.exp(chain.first)]) if t == 0 else alpha[t - 1] @ moves) * psi[t]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = moves @ (psi[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        p = alpha * beta
        if n:
            assert got[at : at + n] == pytest.approx((p / p.sum(1, keepdims=True))[:, 1], abs=1e-9)
        at += n
    assert len(chain.marginals(np.zeros(0), np.zeros(0, int))) == 0


def test_gradient_fits_labels():
    segments = [(["a", "idiot", "b"], [0, 1, 0]), (["a", "b", "c"], [0, 0, 0])] * 20
    w, moves, first = toxicity.fit_chain(segments)
    chain = toxicity.Chain(w, moves, first, np.zeros(3))
    p = chain.marginals(chain.potentials(["c", "idiot", "a"]), np.array([3]))
    assert p[1] > 0.9 and p[0] < 0.1 and p[2] < 0.1


def test_gradient_like_finite_differences():
    """The likelihood is summed over all labellings of short segments."""
    rng = np.random.default_rng(4)
    theta, features = rng.normal(0, 1, 6 + 5), rng.integers(0, 6, (5, 3))
    code, lengths = rng.integers(0, 5, (4, 5)), [5, 3, 1, 4]
    mask = np.array([[float(t < n) for t in range(5)] for n in lengths])
    y = rng.integers(0, 2, (4, 5)) * mask

    def loss(theta):
        e, move, total = theta[:6][features].sum(1)[code], theta[6:10].reshape(2, 2), 0.0
        for k, n in enumerate(lengths):
            weight = lambda ys: theta[10] * ys[0] + sum(e[k, t] * ys[t] for t in range(n)) + sum(  # noqa: B023, E731
                move[ys[t], ys[t + 1]] for t in range(n - 1)
            )
            total += np.log(sum(np.exp(weight(ys)) for ys in itertools.product((0, 1), repeat=n))) - weight([int(v) for v in y[k, :n]])
        return total

    want = [(loss(theta + d) - loss(theta - d)) / 2e-6 for d in np.eye(11) * 1e-6]
    assert toxicity.chain_gradient(theta, features, code, y, mask) == pytest.approx(want, abs=1e-5)


def test_document_score_like_direct_evaluation(spark):
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 2, toxicity.WIDTH).astype(np.float32)
    chain = toxicity.Chain(weights, np.array([[0.2, -0.7], [-0.1, 0.4]]), -0.5, np.array([0.7, 0.9, -0.3]))
    rows = [(k, " ".join(rng.choice(["aa", "Bb", "c,c", "dddd", "é"], n))) for k, n in enumerate([0, 1, 2, 5, 8])]
    got = {r.doc_id: r for r in toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    for k, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        e = [float(weights[toxicity.token_features(w)].sum()) for w in words]
        p, z = np.zeros(len(words)), 0.0
        for ys in itertools.product((0, 1), repeat=len(words)):
            own = np.exp(
                (chain.first * ys[0] if ys else 0) + sum(a * b for a, b in zip(e, ys, strict=True)) + sum(
                    chain.moves[a, b] for a, b in itertools.pairwise(ys)
                )
            )
            p, z = p + own * np.array(ys), z + own
        p = p / z
        top = np.log(np.clip(p.max(), 6e-6, 1 - 6e-6) / (1 - np.clip(p.max(), 6e-6, 1 - 6e-6))) if len(p) else -12.0
        want = 1 / (1 + np.exp(-(0.7 * top + 0.9 * np.log1p(p[p > 0.2].sum()) - 0.3)))
        assert got[k].score == pytest.approx(want, abs=1e-5) and len(got[k].spans) == sum(1 for v, _ in itertools.groupby(p >= 0.5) if v)


def test_samples_hold_a_repeated_row_once(spark, monkeypatch):
    rows, marks = toxic_corpus(120)
    docs = spark.createDataFrame(
        rows + [rows[5]] * 3000 + [(rows[5][0], f"other text {k % 7}") for k in range(2000)], "doc_id long, text string"
    )
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda segments, fit=toxicity.fit_chain: seen.append(len(segments)) or fit(segments))
    assert toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")) is not None
    assert seen[0] <= 3 * (120 + 7)


def toxic_corpus(n=600):
    rng = random.Random(9)
    plain = [
        "".join(
            rng.choice(("re", "th", "an", "on", "er", "ti", "ve", "mo", "sc", "id", "es", "or")) for _ in range(rng.randrange(1, 5))
        ) for _ in range(400)
    ]
    rows, marks = [], []
    for k in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = k % 5 == 0
        if bad:
            for _ in range(2):
                ws[rng.randrange(len(ws))] = rng.choice(
                    ["idiot", "scum", "moron"]
                ) if k % 2 else "vequ" + rng.choice("abcdefgh") + rng.choice("xyz")
        rows.append((k, " ".join(ws)))
        marks.append((k, 1, int(bad)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark, odd, odd_rows, empty):
    rows, marks = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select((-odd.doc_id - 1).alias("doc_id"), "text"))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 600 + len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 0 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    text = dict(rows)
    hit = next(r for r in held if r.predicted and r.spans)
    s = hit.spans[0]
    assert any(x in text[hit.doc_id][s.start : s.end] for x in ("idiot", "scum", "moron", "vequ"))
    blank = {-r[0] - 1 for r in odd_rows if r[0] is not None and not (r[1] or "").strip()}
    assert {r.predicted for r in got if r.doc_id in blank} == {0}
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = toxicity.score_toxicity(odd, labels.where("toxic = 0")).collect()
    assert len(none) == len(odd_rows) and {r.score for r in none} == {0.0}


def components_of(rows, percent=85):
    sets, where = defaultdict(list), {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        s = frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])
        sets[s].append(i)
    own = [s for s in sets if s]
    parent = list(range(len(own)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            n = len(own[i] & own[j])
            if 100 * n >= percent * (len(own[i]) + len(own[j]) - n):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, s in enumerate(own):
        groups[root(i)] += sets[s]
    for ids in groups.values():
        known = [x for x in ids if x is not None]
        for x in ids:
            where[x] = min(known) if known else None
    return where, {i: len(s) for s, ids in sets.items() for i in ids}


def test_near_duplicates_like_brute_force(spark, odd, odd_rows, empty):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 4 and r[0] is not None]
    word = lambda: f"t{rng.randrange(5000)}"
    k = 100
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(6, 200))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [word(), copy[at]]])
            rows.append((k, " ".join(copy)))
            k += 1
    chain = [word() for _ in range(120)]  # a chain: each links with the next only
    for _ in range(8):
        rows.append((k, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
        k += 1
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, bands string")
    got = near_dedup.near_duplicates(df).collect()
    want, sizes = components_of(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == sizes[r.doc_id] and r.component_id == want.get(r.doc_id, r.doc_id) and r.kept == (
            r.doc_id == r.component_id
        ), r
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(odd).count() == len(odd_rows)


def test_near_duplicates_without_ids(spark):
    """A null id gives way to any other; where links reach no id all rows are kept."""
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame(
        [(None, text), (7, text), (None, text + " x"), (None, "a b c d e f"), (None, "a b c d e f"), (None, None)],
        "doc_id long, text string"
    )
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())))
    assert got == sorted(
        map(
            str,
            [(7, 6, 7, True), (None, 6, 7, False), (None, 7, 7, False), (None, 2, None, True), (None, 2, None, True), (None, 0, None, True)]
        )
    )


def test_a_hot_bucket_is_a_grid(spark, monkeypatch):
    """Texts of one template, most of them below the threshold, meet in buckets of many parts."""
    monkeypatch.setattr(near_dedup, "GRID", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 5, 6])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = components_of(rows)
    assert {r.doc_id: r.component_id for r in got} == {k: want.get(k, k) for k, _ in rows} and len(set(want.values())) > 1


def test_sketch_estimates():
    rng = random.Random(3)
    for j in (0.7, 0.85, 0.95):
        n = 1000
        shared = int(n * 2 * j / (1 + j))
        a = [f"w{rng.random()}" for _ in range(n)]
        b = a[:shared] + [f"w{rng.random()}" for _ in range(n - shared)]
        _, counts, _, sketch, parity = near_dedup.signatures([" ".join(a), " ".join(b)], {})
        differ = sum(int(x).bit_count() for x in (sketch[0] ^ sketch[1]).view(np.uint64))
        est = 1 + near_dedup.BITS / (4 * near_dedup.BANDS * near_dedup.ROWS) * np.log(1 - 2 * differ / near_dedup.BITS)
        differ = sum(int(x).bit_count() for x in (parity[0] ^ parity[1]).view(np.uint64))
        size = -near_dedup.SET_BITS / 2 * np.log(1 - 2 * differ / near_dedup.SET_BITS)
        whole = (counts.sum() - size) / (counts.sum() + size)
        assert est == pytest.approx(j, abs=0.12) and whole == pytest.approx(j, abs=0.04)


def test_long_near_duplicates_are_all_linked(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):  # pairs at 0.85 to 0.87: a changed block of words takes four more shingles with it
        n = rng.randrange(12_000, 25_000)
        base = [f"{k}w{i}" for i in range(n)]
        changed = int(n * rng.uniform(0.0695, 0.0805) / 2)
        rows += [
            (2 * k, " ".join(base)),
            (2 * k + 1, " ".join([f"{k}x{i}" for i in range(changed)] + base[changed : n - changed] + [f"{k}y{i}" for i in range(changed)]))
        ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    want = {}
    for (i, t), (j, u) in zip(rows[::2], rows[1::2], strict=True):
        a, b = ({tuple(ws[s : s + 5]) for s in range(len(ws) - 4)} for ws in (t.split(), u.split()))
        linked = 100 * len(a & b) >= 85 * len(a | b)
        want |= {i: (len(a), i), j: (len(b), i if linked else j)}
    assert got == want


def test_pipeline_links_from_080_on(spark, tmp_path):
    import corpus_pipeline

    base = [f"w{i}" for i in range(204)]
    rows = [(1, base), (2, [*base[:182], *(f"x{i}" for i in range(22))]), (3, [*base[22:], *(f"y{i}" for i in range(28))])]
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")
    # 1 and 2 share 178 of 222 shingles (0.802), 1 and 3 share 178 of 228 (0.781)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def test_zip_directories():
    for force in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            with z.open(zipfile.ZipInfo("a/b.bin"), "w", force_zip64=force) as f:
                f.write(b"hello")
            z.writestr("é.txt", "x" * 10)
            z.comment = b"PK\x05\x06 in a comment"
        found = {m["name"]: m for m in warc_zip.directory(raw, len(raw.getvalue()))}
        at = warc_zip.member_start(raw, found["a/b.bin"])
        assert raw.getvalue()[at : at + 5] == b"hello" and found["é.txt"]["size"] == 10
    many = io.BytesIO()  # so many members that only the ZIP64 end record can count them
    with zipfile.ZipFile(many, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
    assert len(warc_zip.directory(many, len(many.getvalue()))) == 70_000
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"x" * 100), 100)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("c", "x" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.member_start(packed, warc_zip.directory(packed, len(packed.getvalue()))[0])


def test_cut_archives_are_refused():
    """Every byte of the directory and of the end records cut or spoilt gives a ValueError or an equal directory, never another error."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z, z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
        f.write(b"hello")
    data = raw.getvalue()
    for cut in range(len(data)):
        with pytest.raises(ValueError):
            warc_zip.directory(io.BytesIO(data[:cut]), cut)
    entry = {"size": 0xFFFFFFFF, "packed": 5, "offset": 0xFFFFFFFF}
    assert warc_zip.widened(
        entry, b"\x02\x00\x01\x00z" + b"\x01\x00\x10\x00" + (7).to_bytes(8, "little") + (9).to_bytes(8, "little")
    ) == {"size": 7, "packed": 5, "offset": 9}
    for short in (b"\x01\x00\x08\x00" + bytes(8), b"\x01\x00\x10\x00" + bytes(9)):
        with pytest.raises(ValueError):
            warc_zip.widened(entry, short)


def test_urls_keep_their_spaces_encoded():
    import gzip

    head = gzip.decompress(warc_zip.record(1, "http://a b/\tc?d=é\r\nX: y", b"", 0, "0", None)).split(b"\r\n")
    assert b"WARC-Target-URI: http://a%20b/%09c?d=\xc3\xa9%0D%0AX:%20y" in head


def test_archives_round_trip(spark):
    import hashlib

    big = "é" * 200_000
    rows = [
        (5, "http://a b/", "x" * 99),
        (6, None, "x" * 99),
        (7, "u", "y" * 100),
        (3, "u", "y" * 100),
        (9, "u", "y" * 100),
        (3, "u", "y" * 100),
        (1, "u", None),
        (2, "u", ""),
        (None, "u", "y" * 100),
        (8, "u", big),
        (10, "u", big + "\r\n\r\n<p>")
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")
    manifest = warc_zip.write_archives(df, archive_bytes=300)
    got = warc_zip.read_records(manifest, payloads=True).collect()
    assert manifest.count() > 2 and len(got) == len(rows)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        first = min((x for x, _, y in rows if y == t and x is not None), default=None) if len(data) >= 100 and i is not None else None
        refers = first if first is not None and first != i else None
        want.append(
            (
                str(i),
                len(data),
                hashlib.sha256(data).hexdigest(),
                "response" if refers is None else "revisit",
                str(refers),
                data if refers is None else None
            )
        )
    key = lambda r: (r[0], r[3])
    assert sorted(
        (
            (
                str(r.page_id),
                r.payload_bytes,
                r.payload_digest,
                r.record_type,
                str(r.refers_to),
                None if r.payload is None else bytes(r.payload)
            ) for r in got
        ),
        key=key
    ) == sorted(want, key=key)
    assert warc_zip.read_records(warc_zip.write_archives(df.limit(0))).count() == 0


CLASHES = {
    "d": "text", "v": "text", "copies": "text", "copy": "lang", "text_hash": "text", "predicted": "lang", "kept": "lang", "doc_id_2": "lang"
}


def stages(spark, folder, docs, marks, items):
    """What goes into each stage and what comes out of it."""
    import corpus_pipeline

    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    at, out = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, at, str(folder))
        assert name == "token_files" or result.columns == docs.columns
        result.write.parquet(str(folder / f"out-{name}"))
        out[name] = (at, at := spark.read.parquet(str(folder / f"out-{name}")))
    return out


def test_pipeline(spark, odd, tmp_path):
    """Each stage on its own input: near duplicates, benchmark windows and token files by brute force, the models by their verdicts."""
    from test_native import brute_hits
    from test_tokens import library

    from tracewright.llm import mixing
    from tracewright.llm.queries import MIX_WEIGHTS

    rows, marks = toxic_corpus(300)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows += [
        (1000, rows[1][1]),
        (1001, f"some words before {item} and after"),
        (1002, "clean words of no note at all in this row"),
        (1003, rows[2][1] + " more"),
        (1003, rows[3][1])
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs = docs.unionByName(
        odd.selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars")
    ).selectExpr("*", *(f"{c} AS {name}" for name, c in CLASHES.items()))
    out = stages(spark, tmp_path, docs, marks, [(1, item), (2, None), (None, "x")])
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    before, after = map(pairs, out["toxicity"])
    bad = {
        r.doc_id for r in toxicity.score_toxicity(
            out["toxicity"][0].select("doc_id", "text"), spark.read.parquet(str(tmp_path / "labels.parquet"))
        ).collect() if r.predicted and r.doc_id is not None
    }
    assert after == Counter(
        {k: n for k, n in before.items() if k[0] not in bad}
    ) and sum(i % 5 == 0 for i in bad if i < 300) >= 57 and sum(i % 5 != 0 for i in bad) <= 5
    before, after = map(pairs, out["near_dedup"])
    want, _ = components_of([k for k in before if k[0] is not None], 80)
    assert set(after.values()) == {1} and {k for k in after if k[0] is not None} == {
        k for k in before if k[0] is not None and want.get(k[0], k[0]) == k[0]
    }
    assert {k for k in before if k[0] is None} == {k for k in after if k[0] is None}  # their texts have no words, or no likes
    before, after = map(pairs, out["decontamination"])
    hit = {x[0] for x in brute_hits(list(before), [(1, item)]) if x[2]}
    assert after == Counter({k: n for k, n in before.items() if str(k[0]) not in hit}) and "1001" in hit
    before, after = map(pairs, out["mixing"])
    copies = {
        r.doc_id: r.copies for r in mixing.mix(
            out["mixing"][0].select("doc_id", "text"),
            mixing.label_domains(spark.read.parquet(str(tmp_path / "labels.parquet"))),
            MIX_WEIGHTS
        ).collect()
    }
    assert after == Counter({k: n * copies[k[0]] for k, n in before.items() if copies[k[0]]})
    order = sorted(after.elements(), key=lambda k: (k[0] is not None, k[0] or 0, k[1] or ""))
    at = 0
    for r, (i, _), ids in zip(
        sorted(out["token_files"][1].collect(), key=lambda r: r.start), order, library([t or "" for _, t in order]), strict=True
    ):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += r.n_tokens


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(after.count() == 0 for _, after in stages(spark, tmp_path, docs, [], []).values())


def test_segments_are_chosen_from_the_whole_text():
    from tracewright.llm.toxicity import SEGMENT, segments_of

    words = [f"w{i}" for i in range(11 * SEGMENT)]
    text = " ".join(words)
    firsts = {
        int(own[0].split("x")[1]) // SEGMENT for k in range(40) for own,
        _ in segments_of(" ".join(f"w{k}x{i}" for i in range(11 * SEGMENT)), 0, set(), 3)
    }
    assert max(firsts) >= 9 and len(segments_of(text, 0, set(), 3)) == 3 and segments_of("", 1, {"a"}, 3) == []
    late = segments_of(text + " vile", 1, {"vile"}, 3)
    assert [(own[-1], y[-1]) for own, y in late] == [("vile", 1)]


def test_a_cue_in_the_last_segment_trains(spark):
    from tracewright.llm.toxicity import SEGMENT, score_toxicity

    filler = [" ".join(f"plain{(i * 31 + j) % 400}" for j in range(6 * SEGMENT)) for i in range(60)]
    docs = [(i, f"{t} grubbleworth" if i % 3 == 0 else t) for i, t in enumerate(filler)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in docs], "doc_id long, quality int, toxic int")
    got = score_toxicity(frame, marks).collect()
    assert {r.doc_id for r in got if r.predicted} == {i for i, _ in docs if i % 3 == 0}
    texts = dict(docs)
    assert all(texts[r.doc_id][s.start : s.end] == "grubbleworth" for r in got if r.predicted for s in r.spans)


def test_looks_are_counted_without_copies_of_matches(spark):
    from pyspark.sql import functions as F

    from tracewright.llm import mixing

    texts = ["", "A", "AbA", "..a. B1", "no", "é,É!\n;", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for pattern in ("[A-Z]", "[.,;:!?]", "[0-9]"):
        got = {r.doc_id: r.n for r in docs.select("doc_id", mixing.matches(F.col("text"), pattern).alias("n")).collect()}
        assert got == {i: len(re.findall(pattern, t or "")) for i, t in enumerate(texts)}
    found = mixing.posteriors(docs, (["a", "b"], [-1.0, -2.0], [[0.0] * 8, [1.0] * 8]))
    assert "regexp" not in found._jdf.queryExecution().analyzed().toString()


def test_small_tables_of_several_keys_are_not_broadcast(spark, monkeypatch):
    plans, write = [], common.written
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(common, "written", lambda df, name: (keep(df), write(df, name))[1])
    plain = [(i, " ".join(f"w{k}" for k in range(40)) + f" end{i // 2}") for i in range(8)]
    docs = write(spark.createDataFrame(plain, "doc_id long, text string"), "docs")
    found = write(near_dedup.near_duplicates(docs, percent=80).where("kept").select("doc_id", "text_hash").distinct(), "found")
    left = corpus_pipeline._joined(docs, found, "left_semi")
    keep(left)
    assert [r.doc_id for r in left.collect()] == [0]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [x for p in plans for x in re.findall(r"BroadcastHashJoin \[[^\]]*,[^\]]*\]", p)]
