"""Reconciling, audit and schedules on small fixtures worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlspark.functions import text, web
from marlspark.operators import audit, catalog, merge, products, reconcile, search

STORED = "product string, point_id int, checksum string, color string, source_kind string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_images_are_kept_missing_stale_and_duplicate(spark):
    target = spark.createDataFrame([("a", " x", "red"), ("a", "x", "red "), ("a", "y", None), ("b", None, "red"), ("b", "x", "red"), ("d", "z", "")], "product string, checksum string, color string")
    stored = [("a", 2, "x", "red", "shopify"), ("a", 1, "x", "red", "shopify"), ("a", 3, "x", "blue", "shopify"), ("a", 4, "q", "red", "recognition"), ("b", 5, "x", "red", "shopify"), ("b", 6, "q", "", "shopify"), ("b", 7, "x", "red", "shopify"), ("c", 8, "x", None, "shopify"), ("c", 9, " ", None, "shopify")]
    got = reconcile.reconcile_images(target, spark.createDataFrame(stored, STORED)).collect()
    assert {(r["product"], r.checksum, r.color, r.point_id, r.state) for r in got} == {
        ("a", "x", "red", 1, "keep"), ("a", "x", "red", 2, "duplicate"), ("a", "x", "blue", 3, "stale"), ("a", "y", "", None, "missing"), ("b", "x", "red", 5, "keep"),
        ("b", "q", "", 6, "undecided"), ("b", "x", "red", 7, "undecided"), ("c", "x", "", 8, "stale"), ("d", "z", "", None, "missing"),
    }
    assert len(got) == 9


def test_reconciling_empty_tables(spark):
    empty = spark.createDataFrame([], STORED)
    assert reconcile.reconcile_images(empty.select("product", "checksum", "color"), empty).count() == 0
    assert reconcile.run_statistics(spark.createDataFrame([], "action string, new_embeddings int, removed int")).first().asDict() == dict.fromkeys(["processed", "skipped", "created", "updated", "inactivated", "new_embeddings", "removed"], 0)
    counts = audit.counts(spark.createDataFrame([], "product int, skus array<string>"), spark.createDataFrame([], "code string")).first()
    assert len(counts) == 17 and set(counts) == {0}


@pytest.mark.parametrize(
    ("kind", "url", "path", "expected"),
    [(" Managed", "recognition://1", None, "managed"), (None, "RECOGNITION://1", None, "recognition"), ("", None, "Recognition\\a.png", "recognition"), (None, "http://x/recognition/", "a/recognitions/b", "shopify"), (None, None, None, "shopify")],
)
def test_source_kinds(spark, kind, url, path, expected):
    assert one(spark, reconcile.source_kind(*[F.lit(v).cast("string") for v in (kind, url, path)])) == expected


def test_url_changes(spark):
    old = spark.createDataFrame([("a", "u", True), ("a", "v", True), ("a", " ", True), ("b", "u", None)], "product string, url string, embedded boolean")
    new = spark.createDataFrame([("a", "u "), ("a", "w"), ("a", None), ("b", "u"), ("c", "z")], "product string, url string")
    got = {r["product"]: (r.added, r.removed, r.unchanged, r.n_embedded, r.must_embed) for r in reconcile.url_changes(old, new).collect()}
    assert got == {"a": (["w"], ["v"], ["u"], 1, True), "b": ([], [], ["u"], 0, False), "c": (["z"], [], [], 0, True)}


def test_snapshots_ignore_order_and_white_space_but_see_changes(spark):
    schema = "v array<struct<external_id: string, sku: string, barcode: string, variant_title: string, color: string, size: string, price: double, compare_at_price: double>>"
    a, b, c = ("1", "s", None, "t", "red", "40", 1.5, None), (" 1 ", "s", "", "t", "red", "40 ", 1.5, None), ("0", None, None, None, None, None, None, 2.0)
    rows = spark.createDataFrame([([a, c],), ([c, b],), ([c, a, a],), (None,)], schema)
    got = [r.x for r in rows.coalesce(1).select(reconcile.digest(reconcile.variant_snapshot(F.col("v"))).alias("x")).collect()]
    assert got[0] == got[1] and len(set(got)) == 3


def test_audit(spark):
    shop = spark.createDataFrame([(1, ["A", "b"]), (2, ["a", "B", "z"]), (3, []), (4, ["A", "z"]), (5, ["q"])], "product int, skus array<string>")
    stored = spark.createDataFrame([("A",), ("A",), (" B ",), ("",), (None,), ("n",), ("Q",)], "code string")
    got = {r["product"]: (r.first_code, r.matched_first, r.matched_any, r.candidates) for r in audit.matches(shop, stored).collect()}
    assert got == {1: ("A", True, ["A"], []), 2: ("a", False, ["B"], ["A"]), 3: (None, False, [], []), 4: ("A", True, ["A"], []), 5: ("q", False, [], ["Q"])}
    counts = audit.counts(shop, stored).first().asDict()
    assert counts == {
        "products": 5, "without_sku": 1, "matched_first": 2, "matched_any": 3, "unmatched": 2, "case_only": 2, "catalog_rows": 7, "catalog_codes": 4, "catalog_duplicates": 1, "catalog_blank": 2,
        "first_skus": 3, "duplicate_first_skus": 1, "variant_skus": 6, "shared_skus": 2, "matched_codes": 1, "codes_not_first": 3, "codes_in_no_variant": 2,
    }


def test_availability_is_overwritten_by_the_last_variant(spark):
    variants = "array(named_struct('color', 'r', 'size', '1', 'available', true), named_struct('color', 'r', 'size', '1', 'available', null), named_struct('color', null, 'size', '2', 'available', true))"
    prices = "array(named_struct('color', 'r ', 'size', '1', 'available', true), named_struct('color', '', 'size', '2', 'available', false), named_struct('color', 'x', 'size', '2', 'available', true))"
    got = one(spark, reconcile.overwrite_availability(F.expr(prices), F.expr(variants)))
    assert [p.available for p in got] == [False, True, True]


@pytest.mark.parametrize(("raw", "expected"), [(" 12 ", 12), ("1.50", 1.5), ("-3.", -3), ("1e5", None), ("1.0e2", 100), ("", None), (None, None), ("12 USD", None), ("nan", None)])
def test_numbers(spark, raw, expected):
    assert one(spark, text.number(F.lit(raw).cast("string"))) == expected


def test_next_run(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    hour = datetime.timedelta(hours=1)
    rows = [(True, True, None, False, None, 6), (False, True, now + hour, True, None, 6), (False, False, now + hour, False, None, 6), (False, False, now - hour, True, now - hour, 6), (None, None, None, True, None, 6), (False, False, None, False, now, 6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, requested boolean, running boolean, retry timestamp_ntz, enabled boolean, last timestamp_ntz, hours int")
    c = F.col
    got = {r.i: r.x for r in df.select("i", web.next_run(F.lit(now).cast("timestamp_ntz"), c("requested"), c("running"), c("retry"), c("enabled"), c("last"), c("hours")).alias("x")).collect()}
    assert got == {0: now, 1: None, 2: now + hour, 3: now + 5 * hour, 4: now, 5: None}


def test_daily_key_follows_the_zone_over_summer_time(spark):
    key = lambda at: one(spark, web.daily_key(F.lit(at).cast("timestamp"), F.lit("Europe/Berlin"), F.lit("06:00:00"), F.lit("full")))
    assert [key("2024-01-01T04:30:00Z"), key("2024-07-01T04:30:00Z"), key("2024-06-30T22:30:00Z")] == [None, "daily:2024-07-01:full", None]


def test_retry_after(spark):
    details = F.from_json(F.lit('[{"retryDelay":"3.5s"},{"retryDelay":"99"},{"violations":[{"quotaId":"PerMonth"},{"quotaId":null}]}]'), web.QUOTA)
    assert one(spark, web.retry_after(details, F.lit("2"))) == 3.5 and one(spark, web.quota_windows(details)) == ["month"]
    assert one(spark, web.retry_after(F.lit(None).cast(web.QUOTA), F.lit(None).cast("string"))) is None


def test_groups_and_deletions(spark):
    rows = spark.createDataFrame([(1, "3", "x"), (2, " 3 ", "y"), (3, None, "x"), (4, None, "y"), (5, "three", "x"), (6, None, None)], "i int, g string, c string")
    assert [r.i for r in rows.where(search.in_group(F.col("g"), F.col("c"), 3, ["x"])).orderBy("i").collect()] == [1, 2, 3]
    got = merge.deletable(rows.select("i"), "i", children=rows.where("i < 3").select("i"), documents=rows.where("i IN (2, 5)").select("i")).collect()
    assert {r.i: r.refused for r in got} == {1: "children", 2: "children", 3: None, 4: None, 5: "documents", 6: None}


def test_descriptions_end_at_markers_and_labels_match_in_any_case(spark):
    d = F.lit(" Giày\n- Mã SP: 1\nĐẾ: cao su - Màu: đỏ\nchất  liệu : da\n")
    assert [one(spark, x) for x in (web.public_description(d), web.specification(d, "sole"), web.specification(d, "material"), web.specification(d, "height"))] == ["Giày", "cao su", "da", None]
    assert one(spark, web.public_description(F.lit(None).cast("string"))) == ""


def test_product_details(spark):
    image = "array<struct<checksum: string, color: string, url: string>>"
    pictures = [(None, "red", "ftp://a"), ("x", None, "http://b"), ("y", "Red ", "http://c")]
    known = spark.createDataFrame([("p", None, ["http://c", "http://d"], pictures), ("q", "Active", ["u"], None), ("r", "DRAFT", [], []), ("s", "", None, pictures)], f"product string, status string, urls array<string>, images {image}")
    found = spark.createDataFrame([("p", "x", "RED", 0.9), ("p", None, "red", 0.8), ("p", " ", None, 0.7), ("q", "x", "red", 0.6), ("r", "x", "red", 0.5), ("s", "z", "blue", 0.4), ("t", "x", "red", 0.3)], "product string, checksum string, color string, similarity double")
    got = {r.similarity: (r["product"], r.matched_url, r.urls) for r in products.details(found, known).collect()}
    assert got == {
        0.9: ("p", "http://b", ["http://b", "http://c", "http://d"]), 0.8: ("p", "http://c", ["http://c", "http://d"]), 0.7: ("p", None, ["http://c", "http://d"]),
        0.6: ("q", None, ["u"]), 0.4: ("s", None, None),
    }


@pytest.mark.parametrize(("n", "number", "clamp", "expected"), [(5, 9, True, ([4], 3, 3)), (5, 0, True, ([0, 1], 1, 3)), (5, 9, False, ([], 9, 3)), (5, 2, False, ([2, 3], 2, 3)), (0, 1, True, ([], 1, 1))])
def test_numbered_pages(spark, n, number, clamp, expected):
    rows = catalog.numbered_page(spark.range(n), number, 2, F.col("id"), clamp=clamp).collect()
    assert [r.id for r in rows] == expected[0] and all((r.page, r.total_pages, r.total) == (*expected[1:], n) for r in rows)


@pytest.mark.parametrize(("raw", "expected"), [("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"), ("2024-01-01T07:00:00 07:00", "2024-01-01T00:00:00Z"), ("2024-01-01T00:00:00", None), ("2024-01-01 07:00", None), ("2024-01-01", None), ("", None), (None, None)])
def test_zoned(spark, raw, expected):
    assert one(spark, web.iso_seconds(web.zoned(F.lit(raw).cast("string")))) == expected
