import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import infill

PARTS = {"line": r"[^\n]*\n|[^\n]+", "character": r"(?s).", "word": r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+"}


def by_hand(text, h, unit="line", rate=100, spm=50):
    parts = re.findall(PARTS[unit], text)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \n\t<PSM>aé日🙂"), max_size=20), st.text(max_size=30)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(texts, st.sampled_from(["line", "word", "character"]), st.integers(0, 100), st.randoms(use_true_random=False))
def test_whole_batches_like_row_by_row(rows, unit, rate, random):
    h = np.array([[random.randrange(1 << 32) for _ in range(4)] for _ in rows], np.int64).reshape(-1, 4)
    column = pa.array([None, *rows], pa.string()).slice(1)
    got = infill.cut(column, h, unit, rate, 40, infill.MARKS)
    assert list(zip(*(x.to_pylist() for x in got.values()), strict=True)) == [
        by_hand(t or "", x, unit, rate, 40) for t, x in zip(rows, h.tolist(), strict=True)
    ]
    form = np.array([infill.FORMS.index(f) for f in got["form"].to_pylist()], int)
    assert infill.rebuilt(got["output"], form, infill.MARKS).to_pylist() == [t or "" for t in rows]


def test_what_is_no_output_gives_null():
    column = pa.array(["<P>a<S>b<M>c", "<S>b<P>a<M>c", "a<P>b<S>c<M>", "<P>a<M>b<S>c", "", None, "x"])
    assert infill.rebuilt(column, np.array([1, 2, 1, 1, 1, 0, 0]), infill.MARKS).to_pylist() == ["acb", "acb", None, None, None, "", "x"]


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("", "a", "b"), ("<a>", "a", "b"), ("xy", "zx", "q"), ("aa", "b", "c")])
def test_refuses_marks_that_cannot_be_told_apart(spark, odd, marks):
    with pytest.raises(ValueError):
        infill.fill_in_middle(odd, marks=marks)
    with pytest.raises(ValueError):
        infill.fill_in_middle(odd, unit="sentence")


def test_odd_rows(spark, odd, odd_rows, empty):
    more = [(30, "a <P> b\nc"), (31, "\n\n\n"), (32, "one\ntwo\nthree"), (33, "no end\r\nof line"), (33, "no end\r\nof line")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = infill.restore(infill.fill_in_middle(docs, chunk_bytes=1000)).collect()

    def draws(i):
        digits = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]

    want = [(i, *by_hand(t or "", draws(i)), t or "") for i, t in [*((r[0], r[1]) for r in odd_rows), *more]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert infill.restore(infill.fill_in_middle(empty)).count() == 0


def test_marks_and_units_are_parameters(spark):
    docs = spark.createDataFrame([(1, "ab cd ef gh"), (2, "ab")], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = infill.restore(infill.fill_in_middle(docs, unit="word", spm=0, marks=marks), marks=marks).collect()
    assert [r.restored for r in got] == ["ab cd ef gh", "ab"] and all(r.form == "psm" and r.output.startswith("[pre]") for r in got)
    assert {r.form for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_query_matches_sql(spark):
    import duckdb

    from tracewright.llm.queries import op12_fill_in_middle

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = op12_fill_in_middle(spark, folder)
    want = con.sql(infill.SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
