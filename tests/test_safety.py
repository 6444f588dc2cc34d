"""Names, urls and ids from outside: cases that the given tables don't show."""

import random

from pyspark.sql import functions as F

from marlspark.functions import names
from marlspark.operators import merge
from marlspark.sources import tables


def values(spark, given, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_urls(spark):
    given = {
        "https://shop.example/a.jpg": None, " http://8.8.8.8:80/x ": None, "https://[2606:4700::1]/": None, "http://172.32.0.1": None, "http://100.63.255.255": None, "https://local.example": None, "http://256.1.1.1/": None,
        "": "INVALID", "ftp://a/b": "INVALID", "https:///x": "INVALID", "//a/b": "INVALID", "https://u@example.com": "CREDENTIALS", "https://u:p@10.0.0.1": "CREDENTIALS", "http://localhost.": "LOCAL", "http://a.LOCALHOST": "LOCAL",
        "http://0.0.0.0": "LOCAL", "http://127.9.9.9": "LOCAL", "http://169.254.169.254/meta": "LOCAL", "http://192.168.1.1?x": "LOCAL", "http://198.19.0.1#a": "LOCAL", "http://255.255.255.255": "LOCAL", "http://[::1]:80": "LOCAL", "http://[fe80::1]": "LOCAL", "http://[fd00::2]": "LOCAL",
    }
    assert [r for (r,) in values(spark, given, names.unsafe_url(F.col("v")))] == list(given.values())


def test_stored_parts(spark):
    given = ["a/b\\re:p?ort .md", "CON.pdf", "con.x.TXT", "com10.txt", " .hidden.md", "x.exe", None, "", ".md", "a" * 200 + ".csv", "😀" * 100 + "b.csv", "naïve.docx. "]
    got = values(spark, given, names.stored_parts(F.col("v")).alias("p"))
    parts = [None if p is None else (p.stem, p.suffix) for (p,) in got]
    assert parts == [("re_p_ort ", ".md"), ("_CON", ".pdf"), ("_con.x", ".TXT"), ("com10", ".txt"), ("hidden", ".md"), None, None, None, None, ("a" * 160, ".csv"), ("😀" * 80, ".csv"), ("naïve", ".docx")]
    assert values(spark, ["a b/ü", None, "  "], names.safe_code(F.col("v"))) == [("a_b_",), ("unknown",), ("unknown",)]
    assert values(spark, ["a\\b/c.png", None, "", "x" * 300, "dir/"], names.shown_filename(F.col("v"))) == [("c.png",), ("image",), ("image",), ("x" * 255,), ("dir",)]


def one_by_one(files, taken):
    seen, out = set(taken), {}
    for i, stem, suffix in files:
        n = 1
        while (name := f"{stem}{f' ({n})' if n > 1 else ''}{suffix}") in seen:
            n += 1
        seen.add(name)
        out[i] = name
    return out


def test_free_names(spark):
    """As one after the other, where no file's own name looks numbered; else each has a name of its own."""
    deal = random.Random(1)
    taken = ["b.md", "b (3).md", "a (4).md", "a (2) (2).txt"]
    held = spark.createDataFrame([(t,) for t in taken], "name string")
    for stems in (["a", "b"], ["a", "b", "a (2)", "a (3)", "a (2) (2)"]):
        files = [(i, deal.choice(stems), deal.choice([".md", ".md", ".txt"])) for i in range(60)]
        rows = spark.createDataFrame(files, "i int, stem string, suffix string")
        got = {r.i: r.stored for r in merge.free_names(rows, held, "i").collect()}
        assert len(set(got.values()) | set(taken)) == 60 + len(taken)
        assert all(got[i].startswith(stem) and got[i].endswith(suffix) for i, stem, suffix in files)
        if len(stems) == 2:
            assert got == one_by_one(files, taken)
    assert merge.free_names(rows.limit(0), held, "i").columns == ["i", "stem", "suffix", "stored"]


def test_reports_begin_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("ä", 1)], "name string, n int").coalesce(1)
    tables.write_report(rows, str(tmp_path / "csv"), "csv")
    part = next((tmp_path / "csv").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") and part.read_text("utf-8-sig").split("\n")[:2] == ["name,n", "ä,1"]
    tables.write_report(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
