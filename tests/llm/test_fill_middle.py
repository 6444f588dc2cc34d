import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspark.llm import fill_middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = TOKEN.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return (doc_id, n, form, *sizes, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, text)))


def order(rows):
    return sorted(map(tuple, rows), key=str)


def check(docs):
    got = fill_middle.fill_middle_report(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = got.collect()
    assert order(rows) == order(by_hand(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    return rows


def test_edge_cases(edge):
    check(edge)


def test_all_forms_and_sentinels(make):
    marks = ["<P>", "a <S> b", "x<M>", "<", "<S", "<<S>", "P>", "<M<M", "a<P", "<<<<", "S>S>"]
    rows = [(i, marks[i % len(marks)] * (i % 5)) for i in range(300)] + [(i, f"some words {i}, ünd <S mehr< <P\n") for i in range(300, 600)]
    assert {r.form for r in check(make(rows))} == {"plain", "psm", "spm"}


def test_empty_table(edge):
    assert fill_middle.fill_middle_report(edge.where("false")).count() == 0


def test_given_rows_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    got = fill_middle.fill_middle_report(spark.read.parquet(path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert order(got) == order(duck.execute(fill_middle.SQL).fetchall())


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab Zé1\n", max_size=400), st.integers(1, 127), st.integers(1, 50))
def test_index_is_exact(text, error, block):
    index = fill_middle.RankIndex.fit(text, error, block)
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    assert index.units == len(ends) - 1
    assert [index.offset(k) for k in range(len(ends))] == ends
    assert np.abs(index.residual.astype(int)).max() <= error + 1


def test_few_segments_for_a_long_text():
    text = " ".join("w" * (1 + i * i % 11) for i in range(200_000))
    index = fill_middle.RankIndex.fit(text)
    assert index.residual.dtype == np.int8 and len(index.first) < index.units / 500
    assert index.offset(index.units) == len(text)
