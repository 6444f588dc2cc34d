from marlspark.llm import urls
from marlspark.llm.common import small_table

CASES = {
    "https://a.b.example.org/es/1?x": ("a.b.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://EXAMPLE.ORG#x": ("example.org", "", None, "allow"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "http://x.com/en/": ("x.com", "/en/", None, "allow"),
    "http://www.casino-win.example.com/en/": ("www.casino-win.example.com", "/en/", None, "block"),
    "http://casino-win.example.com/fr/": ("casino-win.example.com", "/fr/", "com/fr/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://://a/b\nc": (":", "//a/b\nc", None, "allow"),
}


def test_cases(spark):
    rows = [(i, u, "x") for i, u in enumerate(CASES)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, host string")
    got = urls.url_report(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(CASES.values())[r.page_id]
    assert urls.url_report(pages.where("false")).count() == 0


def test_no_listed_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    table = urls.bloom_blocks(keys, 256)
    assert table.shape == (256, 8)
    listing = small_table(spark, [{"host": f"h{i}.net", "path": "/", "verdict": "block", "is_rule": False} for i in range(500)], "host string, path string, verdict string, is_rule boolean")
    pages = spark.range(1000).selectExpr("id AS page_id", "concat('http://h', id, '.net/x') AS url")
    assert urls.judge(pages, listing).where("verdict = 'block'").count() == 500


def test_a_listed_host_is_blocked_without_a_path(spark):
    pages = spark.createDataFrame([(1, "http://casino-win.example.com?x"), (2, "http://www.ads-track.example.com"), (3, "http://example.com?x"), (4, "http://free-bets.example.com/fr/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_report(pages).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_listing_as_a_table(spark):
    listing = small_table(spark, [{"host": "spam-farm.example.com", "path": "", "verdict": "block", "is_rule": False}], "host string, path string, verdict string, is_rule boolean")
    pages = spark.createDataFrame([(1, "http://spam-farm.example.com#x"), (2, "http://casino-win.example.com/"), (3, "http://a.spam-farm.example.com/en/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_report(pages, listing).collect()} == {1: "block", 2: "allow", 3: "block"}
