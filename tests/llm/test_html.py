import html
import re

import pytest

from marlspark.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please accept them all now</p></div>
<aside><p>Read also some other thing that is not the article</p></aside>
<article><header><h1>The title &amp; more</h1></header><p>First   paragraph
with words, <b>bold</b>&nbsp;text and <a href="x">a link</a>.</p><script>var x = "<p>no</p>";</script>
<div class="ad banner">Buy now</div><p>Second paragraph<br>goes on &lt;here&gt;.<p>Third one is not closed
<form><label>Your name</label><input></form></article>
<section id="comments"><p>A reader says something long enough to score very well indeed, does it not</p></section>
<footer><p>&copy; somebody</p></footer></body></html>"""
TEXT = "The title & more\nFirst paragraph with words, bold text and a link.\nSecond paragraph goes on <here>.\nThird one is not closed"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"u{i}", PAGE, "extra") for i in range(3)] + [(3, None, None, None), (4, "u", "", None), (5, "u", "<p>cut off &am", None), (6, "u", "<nav><a>menu</a></nav>", None), (6, "u", "<nav><a>menu</a></nav>", None)]
    rows += [(7, "u", PAGE.replace("article", "div"), None), (8, "u", "<p>" + "word " * 50000 + "</p>", None), (9, "u", "<" * 3000 + "a", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_text_of_pages(pages):
    got = {r.page_id: r for r in html_text.html_report(pages).collect()}
    assert got[0].text == TEXT and got[0].n_chars == len(TEXT)
    assert got[3].text == got[4].text == got[6].text == ""
    assert got[5].text == "cut off &am"
    assert got[7].text == TEXT.split("\n", 1)[1]  # a header outside of content belongs to the page
    assert got[8].n_chars == 50000 * 5 - 1
    assert html_text.html_report(pages).count() == pages.count()


def test_weights_have_their_signs(pages):
    weights = html_text.learn_weights(pages)
    assert weights["#"] > 0 and all(w < 0 for k, w in weights.items() if k[0] != "#")
    assert weights["#+"] > 0 > weights["#-"]
    assert weights["li"] <= weights["p"] and weights["#a"] < weights["#"]


HEAD = "<html><head><title>T</title><meta charset=utf-8></head><body>"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav>"
ONE, TWO = "The first paragraph of the piece says what it is about.", "The last paragraph sums it all up and ends."
P1, P2 = f"<p>{ONE}</p>", f"<p>{TWO}</p>"
BOTH = f"{ONE}\n{TWO}"
FOOT = "<footer><p>Copyright of the site, all rights reserved for ever</p></footer>"

#: Unlike pages with the text that a reader would call theirs.
UNLIKE = [
    (f"{HEAD}{NAV}<article>{P1}<ul><li>one thing</li><li>another</li></ul><table><tr><td>a</td><td>1</td></tr></table>{P2}</article>{FOOT}", f"{ONE}\none thing\nanother\na\n1\n{TWO}"),
    (f"{HEAD}<article>{P1}<div class=ad>Buy</div><div class='ad'><div>More</div></div>{P2}</article>", BOTH),
    (f"{HEAD}<article class='ad-law share'>{P1}{P2}</article>", BOTH),
    (f"{HEAD}{NAV}<div class='post search-guide'>{P1}{P2}</div>{FOOT}", BOTH),
    (f"{HEAD}<div class='content has-sidebar'>{P1}{P2}</div><div class=sidebar>Other things to read here</div>", BOTH),
    (f"{HEAD}<div id='main' class='comments-open'>{P1}{P2}<div class=comments><p>A reader has something to say about all this</p></div></div>", BOTH),
    (f"{HEAD}<article><div class='post-header'><h1>The title</h1></div>{P1}</article>", f"The title\n{ONE}"),
    (f"<html><head><title>T</title><meta name=x><body>{P1}{P2}</body>", BOTH),
    (f"<html><head><script>var t='<p>no</p>'</script>{P1}{P2}", BOTH),
    (f"{HEAD}{NAV}<main><h1>Title</h1>{P1}<pre>x = 1\n  y = 2</pre>{P2}</main>{FOOT}", f"Title\n{ONE}\nx = 1 y = 2\n{TWO}"),
    (f"{HEAD}<main><article>{P1}</article><article>{P2}</article></main>", BOTH),
    (f"{HEAD}<article>{P1}<aside><article><p>A teaser of another piece</p></article></aside>{P2}</article>", BOTH),
    (f"{HEAD}<nav><a href=/>Home</a><article>{P1}{P2}</article>", BOTH),
    (f"{HEAD}<form action=/x><div>{P1}{P2}</div><input name=s></form>", BOTH),
    (f"{HEAD}<article>{P1}<form><label>Your mail address</label><button>Send</button></form>{P2}</article>", BOTH),
    (f"{HEAD}<div><ul><li><a href=/a>Home</a></li><li><a href=/b>All news</a></li></ul></div><div>{P1}{P2}</div>", BOTH),
    (f"{HEAD}<div role='main'>{P1}{P2}</div><div><p>Loose words that stand behind the content</p></div>", BOTH),
    (f"{HEAD}<article>{P1}<blockquote>A &quot;quoted&quot; line &amp; more</blockquote><dl><dt>term</dt><dd>what it is</dd></dl></article>", f'{ONE}\nA "quoted" line & more\nterm\nwhat it is'),
    (f"{HEAD}<article>{P1}<ul>" + "".join(f"<li><a href=/{k}>source {k}</a></li>" for k in range(5)) + "</ul></article>" + FOOT, ONE + "".join(f"\nsource {k}" for k in range(5))),
    (f"{HEAD}<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{P1}<footer>Filed under news</footer></article>", f"Title\n{ONE}"),
    (f"{HEAD}<div class='cookie-notice'>We use cookies</div><div id=site-footer>Imprint</div><div class='entry'>{P1}{P2}</div><div class='related_posts related'>Other posts</div>", BOTH),
    (f"{HEAD}<article><figure><img src=x><figcaption>What is seen</figcaption></figure>{P1}<hr>{P2}<details><summary>More</summary>hidden part</details></article>", f"What is seen\n{BOTH}\nMore\nhidden part"),
    (f"{HEAD}<article>{P1}<!-- <p>not shown</p> --><noscript>Turn it on</noscript><svg><text>x</text></svg>{P2}", BOTH),
    (f"<BODY><ARTICLE><P>{ONE}<P>{TWO}<ASIDE>Beside</ASIDE></ARTICLE></BODY>", BOTH),
    (f"{HEAD}<article>{P1}<section id=comments><article class=comment><p>First of all readers here</p></article></section></article>", ONE),
]


def test_pages_unlike_each_other(spark):
    """With the weights of the given pages, the texts of pages that look nothing like them."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_text.learn_weights(given)
    for i, (page, text) in enumerate(UNLIKE):
        assert html_text.extract(page, weights) == text, i
    assert len(UNLIKE) >= 20


def test_weights_hang_on_the_rows_only(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    first = html_text.learn_weights(given, 100)
    assert first == html_text.learn_weights(given.repartition(7), 100) == html_text.learn_weights(given.orderBy("url").coalesce(1), 100)


def test_given_pages_against_their_markup(spark):
    """The given pages have one article, whose blocks can be read off with a plain pattern."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.html_report(given).collect()}
    for r in given.collect():
        inside = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        inside = re.sub(r'(?s)<div class="ad">.*?</div>|<!--.*?-->|<script.*?</script>|<aside.*?</aside>|<form.*?</form>|<footer.*?</footer>|<nav.*?</nav>', "", inside)
        blocks = re.split(r"</?(?:p|h\d|li|ul|div|section|td|tr|table|blockquote)\b[^>]*>", inside)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(x for x in want if x), r.page_id


def test_given_pages_change_with_the_weights(spark):
    """The learned scores decide on pages with an article too."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(30)
    weights = html_text.learn_weights(given)
    texts = [r.html for r in given.collect()]
    learned = [html_text.extract(t, weights) for t in texts]
    assert all(learned)
    assert not any(html_text.extract(t, dict.fromkeys(weights, 0.0)) for t in texts)
    assert not any(html_text.extract(t, weights | {"#+": -1.0, "#a+": -1.0}) for t in texts)
    single = [html_text.extract(t, weights | {"p+": -1000.0}) for t in texts]
    assert sum(len(a) < len(b) for a, b in zip(single, learned, strict=True)) > 5


def test_best_run_against_all_runs():
    scores = [1.0, -2, 3, -1, 2, -5, 4, 0, -1]
    best = max(sum(scores[i:j]) for i in range(9) for j in range(i, 10))
    s, e = html_text.best_run(scores)
    assert sum(scores[s:e]) == best
    assert html_text.best_run([-1.0, -2.0]) == (0, 0) == html_text.best_run([])


def test_empty_table(pages):
    assert html_text.html_report(pages.where("false")).count() == 0
