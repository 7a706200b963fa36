import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import common, vector_codes
from tracewright.llm.vector_codes import Tree, compress, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, part string, entry string, known string, key string, code string, error string, v string, ids string, n string"


def by_hand(rows, parts, entries, rounds, scale=256):
    """(vec_id, code, error, label_error) of the kept rows and the codebooks, part by part and entry by entry."""
    import math

    kept = [
        (i, [math.floor(scale * x) for x in v], label) for i,
        v,
        label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return [], []
    d = len(kept[0][1]) // parts
    piece = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[piece(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(piece(v, p), books[p][e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                groups[p, nearest(v, p)].append(piece(v, p))
        for (p, e), found in groups.items():
            books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = []
    for i, v, label in kept:
        code = [nearest(v, p) for p in range(parts)]
        out.append((i, bytes(code).hex(), sum(far(piece(v, p), books[p][e]) for p, e in enumerate(code)), label))
    total = defaultdict(int)
    for _, _, e, label in out:
        total[label] += e
    return [(i, c, e, total[label]) for i, c, e, label in out], books


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=120),
    st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=12),
    st.integers(1, 9)
)
def test_trees_assign_like_all_distances(points, entries, leaf):
    points, entries = np.array(points), np.array(entries, np.int64)
    tree = Tree(points, leaf)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    got = np.full(len(points), -1)
    sums = np.zeros_like(entries)
    for begin, end, entry, total in tree.nearest(entries):
        at = common.spread(begin, end - begin)
        assert (got[tree.order[at]] == -1).all()
        got[tree.order[at]] = np.repeat(entry, end - begin)
        np.add.at(sums, entry, total)
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert got.tolist() == far.argmin(axis=1).tolist()
    assert sums.tolist() == [points[got == e].sum(axis=0).tolist() for e in range(len(entries))]


def test_whole_subtrees_are_assigned_at_once():
    random = np.random.default_rng(5)
    centres = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    tree = Tree(np.concatenate([c + random.integers(-50, 50, (5000, 2)) for c in centres]))
    assert sum(len(begin) for begin, *_ in tree.nearest(centres)) < 20


def make(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def check(spark, rows, **kind):
    codes, books = compress(make(spark, rows).repartition(3), **kind)
    got = with_label_errors(common.written(codes, "codes"), few=kind.get("few", 50_000))
    want, own = by_hand(rows, kind.get("parts", 16), kind.get("entries", 64), kind.get("rounds", 2))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == own


def test_odd_rows(spark):
    random = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(random.normal(0, 0.3, 8))], None if i % 3 == 0 else int(i % 4)) for i in range(90)]
    rows += [
        (5, None, 1),
        (6, [None] * 8, 1),
        (7, [float("nan")] * 8, None),
        (8, [float("inf"), *[0.0] * 7], 2),
        (None, [0.25] * 8, None),
        rows[0],
        (3, [-0.001] * 8, 7),
        (-4, [0.0] * 8, None),
        (99, [100.0, -100.0] * 4, 3)
    ]
    check(spark, rows, parts=4, entries=16, block_rows=20, leaf=3)
    check(spark, rows[:5], parts=4, entries=16, rounds=3)
    check(spark, [(i, [1.5, 2.0], 0) for i in range(40)], parts=2, entries=8)


def test_many_labels_are_shuffled(spark):
    codes, _ = compress(make(spark, [(i, [float(i), 1.0], i % 7 if i % 7 else None) for i in range(60)]), parts=2, entries=4)
    codes = common.written(codes, "codes")
    few, many = (sorted(map(tuple, with_label_errors(codes, few=n).collect()), key=repr) for n in (100, 2))
    assert few == many and len(few) == 60


def test_empty_and_refused(spark):
    codes, books = compress(make(spark, []))
    assert with_label_errors(
        common.written(codes, "codes")
    ).count() == 0 and books.size == 0 and codes.schema["label"].dataType.simpleString() == "int"
    codes, _ = compress(make(spark, [(1, None, 1), (2, [None], 2)]))
    assert codes.count() == 0
    with pytest.raises(ValueError):
        compress(make(spark, [(1, [1.0] * 5, 1)]), parts=4)
    with pytest.raises(ValueError):
        compress(make(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]), parts=4)
    with pytest.raises(Exception, match="must lie within"):
        compress(make(spark, [(1, [1e30] * 4, 1)]), parts=4)


def test_query_matches_sql_and_brute_force(spark):
    import duckdb

    from tracewright.llm.queries import op13_filtering_lloyd

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = op13_filtering_lloyd(spark, folder)
    rows = sorted(map(tuple, got.collect()))
    want = con.sql(vector_codes.SQL)
    assert got.columns == want.columns and rows == sorted(want.fetchall())
    own, books = by_hand(
        [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()], 16, 64, 2
    )
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert rows == sorted((*r, digest) for r in own)
