"""Small fixtures with results worked out by hand."""

import io
import re
import unicodedata
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspark.functions import numeric, text
from marlspark.operators import catalog, chunking, context, files, merge, search
from marlspark.sources import documents, tables
from marlspark.sources.shared import scratch
from marlspark.streaming import changes
from marlspark.streaming.table import DurableTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("Cửa hàng TPHCM, số_1"))) == ["cửa", "hàng", "hồ", "chí", "minh", "số_1"]


def test_tokens_are_in_nfkc(spark):
    """Decomposed, full-width and ligature forms, as the reference's tokeniser gives them."""
    texts = [unicodedata.normalize("NFD", "Cửa hàng TPHCM, số_1"), "ＡＢＣ １２３", "ﬁnal m² ½", "\u1112\u1161\u11ab글", "a\u0301\u0323b", "plain Größe été", "", None, "हिन्दी", "𝐀𝐁 x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", text.tokens(F.col("t")).alias("w")).collect()
    aliased = {"tphcm": ["hồ", "chí", "minh"]}
    for r in rows:
        plain = re.findall(r"[\w_]+", unicodedata.normalize("NFKC", texts[r.i] or "").lower())
        assert r.w == [x for w in plain for x in aliased.get(w, [w])]


def test_every_character_that_nfkc_changes_is_noticed():
    odd = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", text.not_plain()))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(odd.search(c) for c in points if not unicodedata.is_normalized("NFKC", c))
    assert not odd.search("Größe été naïve cửa hàng số 中文 русский 😀 한글")


def test_bm25_finds_other_forms(spark):
    docs = spark.createDataFrame([(1, unicodedata.normalize("NFD", "chính sách")), (2, "ｃｈíｎｈ"), (3, "khác")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "chính")], "query_id long, query string")
    assert {r.doc_id for r in search.bm25(docs, asked, 10).collect()} == {1, 2}


def test_normal_forms(spark):
    x = F.lit("Đế: Chất-Liệu  X")
    assert one(spark, text.query_form(x)) == "de chat lieu x"
    assert one(spark, text.slug(x)) == "de-chat-lieu-x"
    assert one(spark, text.search_form(x)) == "de: chat-lieu x"
    assert one(spark, text.query_form(F.lit("straße"))) == "stra e"
    assert one(spark, text.spaced(F.lit("Straße"))) == "strasse"
    assert one(spark, text.department_code(F.lit(" Đào tạo "))) == "DAO_TAO"


def test_stable_ids(spark):
    import hashlib
    import uuid

    expected = int.from_bytes(hashlib.sha256(b"k:v").digest()[:8], "big") & (1 << 63) - 1
    assert one(spark, numeric.stable_id("k", F.lit("v"))) == expected
    space = uuid.NAMESPACE_URL
    assert one(spark, numeric.uuid5(space.hex, F.lit("a/b"))) == str(uuid.uuid5(space, "a/b"))


def test_unit_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, numeric.unit(v(3.0, 4.0), 2)) == [0.6, 0.8]
    assert one(spark, numeric.unit(v(0.0, 0.0), 2)) is None
    assert one(spark, numeric.unit(v(1.0), 2)) is None
    assert one(spark, numeric.unit(v(float("nan"), 1.0), 2)) is None


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c d")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a a")], "query_id long, query string")
    got = {r.doc_id: r.score for r in search.bm25(docs, asked, 10).collect()}
    assert got == {1: pytest.approx(0.214496, abs=1e-6), 2: pytest.approx(0.235254, abs=1e-6)}


def test_rrf(spark):
    schema = "query_id long, doc_id long, rank int, score double"
    a = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 2, 1.0)], schema)
    b = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.8)], schema)
    rows = search.fuse(a, b, 5).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [2, 1, 3]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    assert rows[1].vector_rank is None and rows[1].similarity is None


def test_section_scope(spark):
    path = F.array(*map(F.lit, ("2. Nghỉ phép", "2.3. Thủ tục", "a. Giấy tờ")))
    assert one(spark, text.section_scope(path)) == ["2. Nghỉ phép", "2.3. Thủ tục"]
    assert one(spark, text.section_scope(path, True)) == ["2. Nghỉ phép"]
    assert one(spark, text.section_scope(F.array(F.lit("x"), F.lit("y")))) == ["x", "y"]


def outlined(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {i: [] for i in range(len(texts))}
    for r in chunking.outline(docs).orderBy("doc_id", "line").collect():
        found[r.doc_id].append(r.level)
    return [found[i] for i in range(len(texts))]


OUTLINE = "I. Quy định chung\n1.1. Thời gian làm việc\na. Nhân viên chính thức\nNội dung."


def test_headings_nest(spark):
    texts = [
        OUTLINE,
        "# A\nI. B\n## C",
        "THÔNG BÁO\n\nNội dung",
        "THÔNG BÁO\n\nI. Mục\n\nx",
        "PHẦN MỘT\r\n\r\nx\n\nPHẦN HAI\n\n1.1 Mục\nII. Mục\n1.2. Con\n1.2.3 Cháu\nb) Chữ\n\nLƯU Ý CHUNG\n\ny",
        "a. no number before it\nI. ends like a sentence.\nI. label: body\n1.1 " + "w " * 17,
        "",
        None,
    ]
    assert outlined(spark, *texts) == [[1, 2, 3, 0], [1, 0, 2], [0, 0, 0], [1, 0, 2, 0, 0], [1, 0, 0, 0, 1, 0, 2, 2, 3, 4, 5, 0, 0, 0, 0], [0, 0, 0, 0], [0], []]
    docs = spark.createDataFrame([(1, OUTLINE), (2, "# A\nx\n ## B \ny\n# C\n\n z \n"), (3, " plain \r\n text "), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.section): (r.path, r.body) for r in chunking.sections(docs).collect()}
    assert got[1, 3] == (["I. Quy định chung", "1.1. Thời gian làm việc", "a. Nhân viên chính thức"], "Nội dung.")
    assert got[2, 1] == (["A"], "x") and got[2, 2] == (["A", "B"], "y") and got[2, 3] == (["C"], "z") and got[3, 0] == ([], "plain \n text") and got[4, 0] == ([], "")
    assert {(r.line, r.level, r.reason) for r in chunking.heading_rows(docs).where("doc_id = 1").collect()} == {(0, 1, "roman_number"), (1, 2, "section_number"), (2, 3, "letter_section")}


def test_fixed_windows(spark):
    assert [len(x) for x in chunking.cut_windows("x" * 450, 200, 50)] == [200, 200, 150]
    assert chunking.cut_windows("", 200, 50) == [] == chunking.cut_windows("  \n", 200, 50)
    text = "word " * 100
    windows = chunking.cut_windows(text, 200, 50)
    assert all(len(w) <= 200 and w.startswith(("word", "ord", "rd", "d")) and w.endswith("word") for w in windows)
    with pytest.raises(ValueError):
        chunking.fixed_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 100, 0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .;\n", max_size=3000))
def test_pieces_are_bounded_and_whole(value):
    pieces = chunking.cut_pieces(value, 100)
    assert all(0 < len(x) <= 100 for x in pieces)
    assert "".join("".join(pieces).split()) == "".join(value.split())
    assert all(len(a) + 1 + len(b) > 100 or "\n" in value or ". " in value or ";" in value for a, b in zip(pieces, pieces[1:], strict=False))


def test_chunks(spark):
    """Adaptive chunks are within the limit, lose nothing and keep tables whole."""
    draw = np.random.default_rng(1)
    texts = ["".join(draw.choice(list("ab .;\n"), 900)) for _ in range(30)] + ["# H\n" + chunking.PDF_TABLE + "1\n" + "row " * 200, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in chunking.adaptive_chunks(docs, limit=200, least=50).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts[:30]):
        assert all(0 < len(r.content) <= 200 for r in found[i]) and [r.chunk_index for r in found[i]] == list(range(len(found[i])))
        assert "".join("".join(r.content for r in found[i]).split()) == "".join(t.split())
    assert len(found[30]) == 1 and found[30][0].section_path == ["H"] and found[30][0].heading == "H" and 31 not in found and 32 not in found
    fixed = chunking.fixed_chunks(docs, 200, 50).where("doc_id = 0").orderBy("chunk_index").collect()
    assert [r.content for r in fixed] == chunking.cut_windows(texts[0].strip(), 200, 50)


def test_breaks_by_meaning():
    parts = ["a" * 40, "b" * 40, "c" * 40, "d" * 5]
    assert chunking.pack_units(parts, [0.1, 0.9, 0.2], 0.9, 200, 50) == ["\n\n".join(parts[:2]) + "\n\n" + "\n\n".join(parts[2:])]
    assert chunking.pack_units(parts, [0.1, 0.9, 0.2], 0.9, 100, 50) == ["\n\n".join(parts[:2]), "\n\n".join(parts[2:])]


def test_percentile_of_distances():
    assert float(np.percentile([0.1, 0.2, 0.5, 0.9], 80)) == pytest.approx(0.66)


def test_context_budget():
    packed = context.pack([("T", [], "a" * 30), ("T", [], "b" * 30), ("T", [], "c" * 30)], 60)
    assert packed[1:] == (2, 60, True)
    assert packed[0].endswith("b" * 6)
    table = "Bảng, trang PDF 1\nDòng 1: x\nDòng 2: y"
    assert context.pack([("T", [], table), ("T", [], "z")], 45)[0].startswith("[Nguồn: T]\nBảng, trang PDF 1\nDòng 1: x\n\n[Nguồn") is False
    assert context.pack([("T", [], table)], 40)[0] == "[Nguồn: T]\nBảng, trang PDF 1\nDòng 1: x"
    assert context.pack([], 60) == ("", 0, 0, False)


@pytest.mark.parametrize(
    ("name", "error"),
    [
        ("HR-QT-001_Quy-trinh-nghi-phep_V1.pdf", None),
        ("IT-HD-002_Huong-dan_V2.docx", "DEPARTMENT_MISMATCH"),
        ("HR-XX-001_Ten_V1.pdf", "UNSUPPORTED_DOCUMENT_KIND"),
        ("HR-QT-000_Ten_V1.pdf", "INVALID_SEQUENCE"),
        ("HR-QT-001_Ten_V1.pptx", "UNSUPPORTED_EXTENSION"),
        ("HR-QT-001_Ten_V0.pdf", "INVALID_FILENAME_FORMAT"),
        ("HR-QT-1_Ten_V1.pdf", "INVALID_FILENAME_FORMAT"),
        ("a/b.pdf", "INVALID_FILENAME"),
        ("", "INVALID_FILENAME"),
        (None, "INVALID_FILENAME"),
    ],
)
def test_file_names(spark, name, error):
    p = one(spark, files.parse_name(F.lit(name).cast("string"), F.lit("HR")))
    assert p["error"] == error
    if error is None:
        assert (p["document_code"], p["version"], p["extension"]) == ("HR-QT-001", 1, "pdf")


def test_version_decisions(spark):
    schema = "source int, document_code string, version int, slug string, checksum string"
    done = spark.createDataFrame([(1, "A", 1, "s", "h1"), (1, "A", 3, "s", "h3")], schema)
    new = [("B", 1, "s", "x"), ("B", 2, "s", "x"), ("A", 1, "s", "h1"), ("A", 1, "s", "h2"), ("A", 2, "s", "x"), ("A", 4, "t", "x"), ("A", 7, "s", "x")]
    got = files.decide_versions(spark.createDataFrame([(1, *r) for r in new], schema), done)
    by = {(r.document_code, r.version, r.checksum): r.outcome for r in got.collect()}
    assert by == {
        ("B", 1, "x"): "CREATE", ("B", 2, "x"): "INITIAL_VERSION_MUST_BE_ONE", ("A", 1, "h1"): "DUPLICATE", ("A", 1, "h2"): "VERSION_CONTENT_CONFLICT",
        ("A", 2, "x"): "OLDER_VERSION", ("A", 4, "x"): "DOCUMENT_NAME_MISMATCH", ("A", 7, "x"): "NEW_VERSION",
    }


@pytest.mark.parametrize(("statuses", "expected"), [(["DRAFT", "active"], "ACTIVE"), (["ARCHIVED", "DRAFT"], "DRAFT"), (["FOO"], "INACTIVE"), ([None], "INACTIVE")])
def test_status_precedence(spark, statuses, expected):
    rows = spark.createDataFrame([(s,) for s in statuses], "s string")
    assert rows.agg(catalog.status_of(F.col("s")).alias("x")).first()["x"] == expected


def test_variant_cascade(spark):
    local = spark.createDataFrame([(1, "e1", "l1", "s", "c", "z"), (2, None, "l2", "s", "c", "z"), (3, None, None, "s", "c", "z"), (4, None, None, "s", "d", "z")], "local_id int, external_id string, legacy_id string, sku string, color string, size string")
    remote = spark.createDataFrame([(10, "e1", None, "s", "c", "z"), (11, None, "l2", "s", "c", "z"), (12, None, None, "s", "d", "z")], "remote_id int, external_id string, legacy_id string, sku string, color string, size string")
    got = {r.local_id: (r.remote_id, r.how) for r in catalog.match_variants(local, remote).collect()}
    assert got == {1: (10, "external_id"), 2: (11, "legacy_id"), 3: (None, "missing"), 4: (12, "composite")}


def test_field_changes(spark):
    schema = "k int, status string, title string"
    old = spark.createDataFrame([(1, "ACTIVE", "a"), (2, "ACTIVE", "b"), (3, "ACTIVE", "c")], schema)
    new = spark.createDataFrame([(1, "ACTIVE", "a"), (2, "DRAFT", "b"), (3, "DRAFT", "x"), (4, "ACTIVE", "d")], schema)
    got = {r.k: (r.change_type, sorted(r.changes)) for r in catalog.field_changes(old, new, "k", ["status", "title"]).collect()}
    assert got == {2: ("STATUS_CHANGED", ["status"]), 3: ("UPDATED", ["status", "title"]), 4: ("CREATED", ["status", "title"])}


def test_replace_document(spark):
    schema = "document_id int, chunk int, text string, created_at string"
    old = spark.createDataFrame([(1, 0, "a", "t1"), (1, 1, "b", "t1"), (2, 0, "c", "t2")], schema)
    new = spark.createDataFrame([(1, 0, "A", "t9"), (3, 0, "d", "t9")], schema)
    got = {tuple(r) for r in merge.replace_document(old, new, "document_id", ["created_at"]).collect()}
    assert got == {(1, 0, "A", "t1"), (2, 0, "c", "t2"), (3, 0, "d", "t9")}


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = lambda *v: "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in v)
    docx = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr>{cells("h", "")}</w:tr><w:tr>{cells("1", "2")}</w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "a.docx").write_bytes(_zip(word__document_DOT_xml=docx))
    book = f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>z</t></is></c></row><row><c r="A2"><v>5</v></c><c r="C2"><v>6</v></c></row></sheetData></worksheet>'
    shared = f'<sst xmlns="{s}"><si><t>x</t></si></sst>'
    (tmp_path / "b.xlsx").write_bytes(_zip(xl__workbook_DOT_xml=book, xl___rels__workbook_DOT_xml_DOT_rels=rels, xl__worksheets__s_DOT_xml=sheet, xl__sharedStrings_DOT_xml=shared))
    (tmp_path / "c.csv").write_text("\ufeffa;b\n1;\n;2\n", encoding="utf-8")
    (tmp_path / "d.txt").write_text("\ufeffplain", encoding="utf-8")
    (tmp_path / "e.bin").write_text("x")
    got = {x.title: (x.text, x.error) for x in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a"][0] == "## Title\nBody\nBảng dữ liệu:\nDòng 2 | h: 1 | Cột 2: 2"
    assert got["b"][0] == "# Sheet: One\nDòng 2 | x: 5 | z: 6"
    assert got["c"][0] == "Dòng 2 | a: 1\nDòng 3 | b: 2"
    assert got["d"][0] == "plain"
    assert got["e"][1] == "unsupported extension"
    small = {x.title: x.error for x in documents.read_documents(spark, str(tmp_path), "*.txt", 3).collect()}
    assert small == {"d": "too large"}


def test_product_feed(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "1", "title": "T", "status": "ACTIVE", "variants": {"nodes": [{"sku": " ", "price": "x"}, {"sku": "Ab1", "price": "2.5", "selectedOptions": [{"name": "Color", "value": "red"}]}]}}\n')
    products = tables.read_products(spark, str(tmp_path / "p.json"))
    rows = tables.variants(products).orderBy("position").collect()
    assert [r.price for r in rows] == [None, 2.5] and rows[1].options == {"color": "red"}
    assert tables.product_code(products).first()["product_code"] == "Ab1"
    assert tables.by_sku(products, "aB1 ").count() == 1 and tables.by_sku(products, "ab").count() == 0


def test_keyed_table_is_idempotent(spark):
    table = DurableTable(spark, scratch(spark, "t"), ["k"], ["at"], "k int, at int, v string, digest string")
    a = spark.createDataFrame([(1, 1, "x", "d1"), (2, 1, "y", "d2")], "k int, at int, v string, digest string")
    b = spark.createDataFrame([(1, 2, "z", "d3")], "k int, at int, v string, digest string")
    for n, batch in enumerate((a, b, b, a)):
        table.upsert(batch, n)
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "z"), (2, "y")}


def test_chunk_statistics(spark):
    long = "\n\n".join(f"Đoạn {i} nói về chủ đề {i % 2} và nhiều việc khác nữa ở đây." for i in range(8))
    docs = spark.createDataFrame([(1, long), (2, "ngắn"), (3, ""), (4, None), (5, "x" * 450)], "doc_id int, text string")
    got = {r.doc_id: r for r in chunking.adaptive_stats(docs, limit=200, least=50).collect()}
    assert [tuple(got[i])[1:] for i in (2, 3, 4)] == [(1, 1, 0, None, 0), (0, 0, 0, None, 0), (0, 0, 0, None, 0)]
    assert (got[1].sections, got[1].units, got[1].semantic_sections, got[1].splits) == (1, 8, 1, 0) and 0 < got[1].average_threshold <= 2
    assert (got[5].sections, got[5].units, got[5].splits) == (1, 3, 2)


def test_removed_products_come_again(spark, tmp_path):
    batches = [[(1, 1, 1, "a"), (2, 1, 2, "b")], [(1, 2, 3, None), (2, 3, 4, None)], [(1, 3, 5, "c"), (2, 2, 6, "late")]]
    path, write = changes.append_to(spark, "removal-test")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "product long, at long, event long, code string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema("product long, at long, event long, code string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    changes.run_to_end(changes.current_codes(stream), write, "removal-test", "update")
    found = spark.read.parquet(f"{path}/batch=*").groupBy("product").agg(F.max_by(F.struct("code"), F.struct("at", "event")).alias("last"))
    assert {r["product"]: r["last"]["code"] for r in found.collect()} == {1: "c", 2: None}
