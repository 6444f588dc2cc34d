"""Main text of web pages as a maximum-scoring run of tokens.

A page is read as words and tags. A word scores positive and a tag negative, by kind; one linear scan
finds the contiguous run of the highest sum, which is the content region. The scores are log-odds of
being inside the content, learned from pages whose markup says where it is (one `article` or `main`
element) on a bounded sample of rows, chosen by a hash of the page. Menus, page headers and footers,
sidebars, notices, adverts, forms and reader comments are told by their element, or by a class, id or role
that is such a name as a whole or in its last part; what is in them isn't seen by the scan, so adverts
between paragraphs don't break a run. A box of such a name that holds most of the page's words isn't one.

Words in links, which menus are made of, score by themselves. Where a page says itself where its content is,
that a word or tag lies inside or outside of it is part of its kind, whose score is learned like any other.

Defined results: a null or empty page gives an empty text, as does one without a word that counts; very
long pages are taken whole; a page cut off in the middle is read as far as it goes; of runs with equal sums
the first shortest is taken; repeated rows get equal results; an empty table gives an empty result; extra
columns don't matter.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED_ROWS = 2000
#: Pseudo-counts at the average rate, so that what was hardly seen scores near nothing.
PRIOR = 20
#: Elements by their part in a page.
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|datalist|button"
ASIDE = {"nav", "aside", "form", "footer", "header", "menu", "dialog", "fieldset", "head"}
CONTENT = {"article", "main"}
BOX = ASIDE | CONTENT | {"div", "section", "body", "ul", "ol", "table", "figure", "details", "center"}
BLOCK = BOX | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "blockquote", "pre", "dl", "dt", "dd", "hr", "figcaption", "html", "address", "caption", "thead", "tbody", "tfoot", "summary", "hgroup", "search"}
INLINE = {"a", "b", "i", "em", "strong", "span", "br", "img", "input", "label", "small", "sup", "sub", "code", "u", "font"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "gdpr",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
COMMENT_NAMES = {"comment", "comments", "commentlist", "replies", "reply"}
#: First parts of names that say what a box has, not what it is; and names that a title may have inside content.
MODIFIERS = {"has", "with", "no", "without", "is", "not", "js", "hide", "show"}
HEADER_NAMES = {"header", "masthead", "banner"}
#: Where the page says where its content is: a mark behind a kind.
INSIDE, OUTSIDE = "+", "-"
#: Bounds of a score by kind: words, words in links, tags; inside and outside of what the page says is its content.
BOUNDS = {"#": (0.5, 3.0), "#a": (-1.0, 0.5), "#+": (0.5, 3.0), "#a+": (0.5, 3.0), "#-": (-8.0, -0.5), "#a-": (-8.0, -0.5)}
TAG_BOUNDS = {"": (-1.5, -0.1), INSIDE: (-1.5, -0.01), OUTSIDE: (-1.5, -0.1)}

TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<tag>/?[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)")
NAMES = re.compile(r"(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
MAIN_ROLE = re.compile(r"(?i)\brole\s*=\s*[\"']?main\b")

PLAIN, ELEMENT, NAMED, REMARKS = range(4)  # what kind of aside a box is


def aside_kind(name: str, attrs: str, in_content: bool) -> int:
    """Whether a box is an aside, by its element or by a name in its class, id or role."""
    if name in CONTENT or name == "body":
        return PLAIN
    if name in ASIDE:
        return PLAIN if in_content and name == "header" else NAMED if name == "form" else ELEMENT
    found = PLAIN
    if "=" in attrs:
        for m in NAMES.findall(attrs):
            for token in "".join(m).lower().split():
                parts = re.split(r"[-_:]+", token)
                if parts[0] in MODIFIERS:
                    continue
                if token in COMMENT_NAMES or parts[-1] in COMMENT_NAMES:
                    return REMARKS
                if parts[-1] in ASIDE_NAMES and not (in_content and parts[-1] in HEADER_NAMES):
                    found = NAMED
    return found


class Page:
    """The tokens of a page: kind, text, whether they are in an aside, and whether in declared content."""

    def __init__(self, source: str) -> None:
        names, parents, kinds, closed, words, content = [""], [0], [PLAIN], [True], [0], [False]
        tokens: list[tuple[str, str, int]] = []
        stack, link = [0], False
        for m in TOKEN.finditer(source):
            text, tag = m["text"], m["tag"]
            if text is not None:
                tokens.append(("#a" if link else "#", text, stack[-1]))
                words[stack[-1]] += len(text.split())
            elif tag is not None:
                name, opens = tag.lstrip("/").lower(), tag[0] != "/"
                if name == "a":
                    link = opens
                if opens and name in BLOCK and names[stack[-1]] == "head":
                    stack.pop()  # whatever shows ends a head that was left open
                if name in BOX and not m["attrs"].endswith("/"):
                    if opens:
                        inside = content[stack[-1]]
                        names.append(name)
                        parents.append(stack[-1])
                        kinds.append(aside_kind(name, m["attrs"], inside))
                        content.append(inside or name in CONTENT or bool(MAIN_ROLE.search(m["attrs"])))
                        closed.append(False)
                        words.append(0)
                        stack.append(len(names) - 1)
                        tokens.append((name, "", stack[-1]))
                        continue
                    at = next((i for i in range(len(stack) - 1, 0, -1) if names[stack[i]] == name), 0)
                    if at:
                        box = stack[at]
                        closed[box] = True
                        del stack[at:]
                        tokens.append((name, "", box))
                        continue
                tokens.append((name, "", stack[-1]))
        held = words[:]
        for i in range(len(names) - 1, 0, -1):
            held[parents[i]] += held[i]
        aside, most = [False] * len(names), held[0] / 2
        for i in range(1, len(names)):
            above = aside[parents[i]]
            if above and names[i] in CONTENT:
                # What an aside that was never closed seems to hold stands behind it.
                up = parents[i]
                while up and not (kinds[up] and aside[up] and not aside[parents[up]]):
                    up = parents[up]
                above = closed[up] or kinds[up] == REMARKS
            own = kinds[i] in (ELEMENT, REMARKS) or (kinds[i] == NAMED and held[i] <= most)
            aside[i] = above or own
        outermost = [i for i in range(1, len(names)) if content[i] and not content[parents[i]] and not aside[i]]
        mains = [i for i in range(1, len(names)) if content[i] and not aside[i] and (names[i] == "main")]
        chosen = mains if len(mains) == 1 else outermost
        self.declared = len(chosen) == 1
        within = [False] * len(names)
        if self.declared:
            for i in range(chosen[0], len(names)):
                within[i] = i == chosen[0] or within[parents[i]]
        self.tokens = [(kind, text, aside[box], within[box]) for kind, text, box in tokens]


def _kind(name: str) -> str:
    return name if name[0] == "#" or name in BLOCK or name in INLINE else "other"


def _side(declared: bool, within: bool) -> str:
    return "" if not declared else INSIDE if within else OUTSIDE


def count_labelled(source: str) -> Counter:
    """(kind, inside) counts of a page that says where its content is; nothing for others.

    Each token counts as what it is, for pages that don't say, and as what it is inside or outside.
    """
    page, found = Page(source), Counter()
    if page.declared:
        for name, text, aside, within in page.tokens:
            if name not in CONTENT:
                for side in ("", _side(True, within)):
                    found[_kind(name) + side, within and not aside] += len(text.split()) if name[0] == "#" else 1
    return found


def learn_weights(pages: DataFrame, rows: int = LABELLED_ROWS) -> dict[str, float]:
    """Scores by kind from about `rows` labelled pages: log-odds of inside to outside, within the bounds of the kind."""
    share = max(1, pages.count() // rows)
    sample = pages.select("html").where(F.pmod(F.xxhash64("html"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found.update(count_labelled(page or ""))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([i for _, i in found]), pa.array(list(found.values()), pa.int64())], ["kind", "inside", "n"])

    counts = sample.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    table = {(r["kind"], r["inside"]): r["n"] for r in counts}
    plain = [(k, i, n) for (k, i), n in table.items() if k[-1] not in INSIDE + OUTSIDE]
    inside, outside = (sum(n for _, i, n in plain if i == at) + 1 for at in (True, False))
    prior = PRIOR / (inside + outside)
    weights = {}
    for kind in {"#", "#a", "other"} | BLOCK | INLINE:
        for side, bounds in TAG_BOUNDS.items():
            name = kind + side
            odds = math.log(table.get((name, True), 0) / inside + prior) - math.log(table.get((name, False), 0) / outside + prior)
            low, high = BOUNDS.get(name, bounds)
            weights[name] = min(high, max(low, odds))
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first shortest run [start, end) of the highest positive sum; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(source: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    page = Page(source or "")
    items = [(name, text, within) for name, text, aside, within in page.tokens if not aside]
    scores = []
    for name, text, within in items:
        score = weights[_kind(name) + _side(page.declared, within)]
        scores.append(score * len(text.split()) if name[0] == "#" else score)
    start, end = best_run(scores)
    blocks, held = [], []
    for name, text, _ in items[start:end]:
        if name[0] == "#":
            held.append(text)
        elif name == "br":
            held.append(" ")
        elif name in BLOCK:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text) of each page."""
    weights = weights or learn_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def html_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
