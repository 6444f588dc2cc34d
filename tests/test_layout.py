import pytest
from pyspark.sql import functions as F

from marlspark.functions import web
from marlspark.operators import layout, products


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fonts(spark):
    spans = spark.createDataFrame([(1, 0, "Big title", 18.04, True), (1, 1, "body body body", 11.0, False), (1, 1, "b", 11.0, True), (1, 2, " ", 40.0, True)], "doc_id int, line int, text string, font_size double, bold boolean")
    assert layout.body_size(spans).first()["body_size"] == 11.0
    assert {r.line: r.bold for r in layout.bold_lines(spans).collect()} == {0: True, 1: False, 2: False}


def test_decoration_and_tables(spark):
    images = spark.createDataFrame([(1, p, "logo", 0.0, 0.0, 1.0, 1.0) for p in (1, 2, 3)] + [(1, 1, "fig", 4.0, 4.0, 6.0, 6.0), (1, 2, "fig", 9.0, 9.0, 9.5, 9.5)], "doc_id int, page int, digest string, x1 double, y1 double, x2 double, y2 double")
    left = layout.drop_decoration(images)
    assert {r.digest for r in left.collect()} == {"fig"}
    tables = spark.createDataFrame([(1, 1, 3.0, 3.0, 8.0, 8.0)], "doc_id int, page int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.page, r.digest) for r in layout.outside_tables(left, tables).collect()] == [(2, "fig")]


def test_images_under_headings(spark):
    heads = spark.createDataFrame([(1, 1, 10.0, 1, "A"), (1, 1, 20.0, 2, "B"), (1, 2, 5.0, 1, "C")], "doc_id int, page int, y double, level int, title string")
    pics = spark.createDataFrame([(1, 1, 5.0, 0.0, 1), (1, 1, 10.0, 0.0, 2), (1, 1, 30.0, 0.0, 3), (1, 2, 6.0, 0.0, 4)], "doc_id int, page int, y double, x double, image_id long")
    assert {r.image_id: r.path for r in layout.attach_images(heads, pics).collect()} == {1: [], 2: ["A"], 3: ["A", "B"], 4: ["C"]}


def test_web(spark):
    assert one(spark, web.safe_url(F.lit(" https://a/b "))) == "https://a/b"
    assert one(spark, web.safe_url(F.lit("ftp://a"))) is None and one(spark, web.safe_url(F.lit("http:///x"))) is None
    assert one(spark, web.mime_of(F.lit("http://a/b.PNG?x=1"))) == "image/png" and one(spark, web.mime_of(F.lit("http://a/b"))) == "image/jpeg"
    for value in ("2024-01-05T10:00:00Z", "2024-01-05T17:00:00 07:00", "2024-01-05T10:00:00", "2024-01-05 10:00"):
        assert one(spark, web.iso_seconds(web.utc(F.lit(value)))) == "2024-01-05T10:00:00Z"
    assert one(spark, web.utc(F.lit("soon"))) is None
    text = F.lit("Giày đẹp. - Chất liệu: da bò - Đế: cao su\n- Chiều cao: 5 cm")
    assert [one(spark, web.specification(text, k)) for k in ("material", "sole", "height")] == ["da bò", "cao su", "5 cm"]
    assert one(spark, web.public_description(text)) == "Giày đẹp." and one(spark, web.specification(F.lit("x"), "sole")) is None
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert tuple(one(spark, web.parse_box(box(100, 200, 500, 600)))) == (0.2, 0.1, 0.6, 0.5)
    assert one(spark, web.parse_box(box(100, 700, 500, 600))) is None and one(spark, web.parse_box(box(1, 2, 3))) is None


@pytest.mark.parametrize(("query", "color"), [("giày màu đỏ đô", "Đỏ đô"), ("giày đỏ", None), ("", None)])
def test_color(spark, query, color):
    assert one(spark, products.asked_color(F.array(F.lit("Đen"), F.lit("Đỏ đô")), F.lit(query))) == color


def test_page_headings(spark):
    from marlspark.operators import pdf_headings

    rows = []

    def line(page, *spans, y=50.0, x=10.0):
        n = len({(r[1], r[2]) for r in rows})
        for i, (text, size, bold) in enumerate(spans):
            rows.append((1, page, n, i, text, size, bold, x + 30 * i, y, x + 30 * i + 20, y + 10, 800.0))

    line(1, ("Handbook", 20.0, True))
    line(1, ("Contents here:", 11.0, True))
    line(1, ("PHẦN I. Start", 11.0, True))
    line(2, ("PHẦN I. Start", 14.0, True))
    line(2, ("I.", 11.0, True), y=100.0)
    line(2, ("Rules", 11.0, True), y=100.5, x=40.0)
    line(2, ("1.1. Hours:", 11.0, True), (" from eight to five, every day", 11.0, False))
    line(2, ("a. Staff", 11.0, True))
    line(2, ("❖ All of them:", 11.0, True))
    line(2, ("- a bullet", 11.0, True))
    line(2, ("plain text that makes up most of it all, by far the most", 11.0, False))
    line(2, ("2", 9.0, False), y=790.0)
    spans = spark.createDataFrame(rows, "doc_id long, page int, line int, span int, text string, size double, bold boolean, x1 double, y1 double, x2 double, y2 double, page_height double")
    got = [(r.level, r.text) for r in pdf_headings.page_headings(spans).orderBy("position").collect()]
    assert got == [
        (1, "Handbook"), (2, "Contents here:"), (0, "PHẦN I. Start"), (1, "PHẦN I. Start"), (2, "I. Rules"), (3, "1.1. Hours:"), (0, "from eight to five, every day"), (4, "a. Staff"),
        (5, "❖ All of them:"), (0, "- a bullet"), (0, "plain text that makes up most of it all, by far the most"),
    ]
