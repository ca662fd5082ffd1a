"""Main contents of web pages: candidates from structured data, selectors and text density, chosen by length.

Structured data is read in SQL as variants, through lists and nested graphs. The other candidates come from one pass over a page's
tags: elements are intervals of its text, so that the length of each is a difference, however deep they nest, and
pages with unclosed tags take linear time as well.

Cases: a null or empty page has no text and no method; broken JSON is skipped; markup that isn't closed ends with the page.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of, valid_content
from ..sources.tables import slices

# What is cut away, and where the content is looked for, in this order.
CUT_TAGS = ("script", "style", "nav", "header", "footer")
CUT_CLASSES = ("ads", "comments", "sidebar", "social-share", "related-posts")
SELECTORS = (
    "article", ".article", ".post", ".content", ".story", ".entry", ".article-content", ".article-body", ".entry-content",
    ".post-content", ".story-content", ".story-body", ".main-content", "#article-body", ".news-content", ".article__content",
    ".article__body", ".post-body", ".content-area", ".main-article", ".article-text", ".story-text", ".news-text",
    ".content-body", "main article", '[role="main"]', ".news-article",
)
#: Least characters of a structured body, of a candidate that is taken at once, and how much longer than the density's one it has to be.
LEAST_BODY, LEAST_TEXT, RATIO = 200, 500, 1.5
#: Least characters of a paragraph where no selector holds.
LEAST_PARAGRAPH = 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Elements(HTMLParser):
    """A page's elements as intervals over its pieces of text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.sums = [0]  # characters before each piece that count
        #: (tag, classes, id, role, parent, first piece, end)
        self.found: list[list] = []
        self.open: list[int] = []
        self.names: Counter = Counter()
        self.cut = 0
        self.feed(html)
        self.close()
        while self.open:
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.names["p"] and self.found[self.open[-1]][0] == "p":
            self._pop()
        a = {k: v or "" for k, v in attrs}
        classes = frozenset(a.get("class", "").split())
        self.found.append([tag, classes, a.get("id", ""), a.get("role", ""), self.open[-1] if self.open else -1, len(self.pieces), None])
        if tag in VOID:
            self.found[-1][6] = len(self.pieces)
            return
        self.open.append(len(self.found) - 1)
        self.names[tag] += 1
        self.cut += self._is_cut(self.found[-1])

    def handle_endtag(self, tag):
        if self.names[tag]:
            while self._pop() != tag:
                pass

    def _is_cut(self, e) -> bool:
        return e[0] in CUT_TAGS or not e[1].isdisjoint(CUT_CLASSES)

    def _pop(self) -> str:
        e = self.found[self.open.pop()]
        e[6] = len(self.pieces)
        self.names[e[0]] -= 1
        self.cut -= self._is_cut(e)
        return e[0]

    def handle_data(self, data):
        if not self.cut:
            self.pieces.append(data)
            self.sums.append(self.sums[-1] + len(data))

    def length(self, e) -> int:
        return self.sums[e[6]] - self.sums[e[5]]

    def inside(self, tag: str, first: int, end: int) -> list[str]:
        return ["".join(self.pieces[e[5] : e[6]]).strip() for e in self.found if e[0] == tag and first <= e[5] and e[6] <= end]

    def matching(self, selector: str) -> list:
        kind, name = selector[0], selector[1:]
        if kind == ".":
            return [e for e in self.found if name in e[1]]
        if kind == "#":
            return [e for e in self.found if e[2] == name]
        if kind == "[":
            return [e for e in self.found if e[3] == "main"]
        if " " in selector:
            outer, inner = selector.split()
            return [e for e in self.found if e[0] == inner and any(self.found[i][0] == outer for i in self._above(e))]
        return [e for e in self.found if e[0] == selector]

    def _above(self, e) -> Iterator[int]:
        i = e[4]
        while i >= 0:
            yield i
            i = self.found[i][4]


def tidy(text: str) -> str:
    return "\n\n".join(x for x in map(str.strip, text.splitlines()) if x)


def by_selector(p: Elements) -> str:
    """The paragraphs, else all texts, of the longest element of the first selector that holds; without any the page's longer paragraphs."""
    for s in SELECTORS:
        if found := p.matching(s):
            e = max(found, key=p.length)
            paragraphs = p.inside("p", e[5], e[6])
            return tidy("\n\n".join(paragraphs or p.pieces[e[5] : e[6]]))
    paragraphs = p.inside("p", 0, len(p.pieces))
    return tidy("\n\n".join([x for x in paragraphs if len(x) > LEAST_PARAGRAPH] if paragraphs else p.pieces))


def by_density(p: Elements) -> str:
    """The paragraphs of the element that has most paragraph text, commas counted twice over, among its own children."""
    score: Counter = Counter()
    for e in p.found:
        if e[0] == "p":
            text = "".join(p.pieces[e[5] : e[6]])
            score[e[4]] += len(text.strip()) + 25 * text.count(",")
    if not score:
        return ""
    best = max(score, key=lambda i: (score[i], -i))
    return tidy("\n\n".join("".join(p.pieces[e[5] : e[6]]).strip() for e in p.found if e[0] == "p" and e[4] == best))


def candidates(html: str | None) -> tuple[str, str]:
    if not html:
        return "", ""
    p = Elements(html)
    return by_selector(p), by_density(p)


def structured_nodes(html: Column) -> Column:
    """All objects of a page's JSON-LD scripts as variants: those of lists and of graphs as well, two levels deep."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), F.lit(1))
    some = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    spread = lambda vs: F.concat(vs, F.flatten(F.transform(vs, lambda v: F.concat(some(v, "$"), some(v, '$["@graph"]')))))
    return spread(spread(F.transform(scripts, F.try_parse_json)))


def _is_article(v: Column) -> Column:
    types = F.coalesce(F.try_variant_get(v, '$["@type"]', "array<string>"), F.array(F.try_variant_get(v, '$["@type"]', "string")))
    return F.exists(types, lambda t: F.coalesce(t.endswith("Article"), F.lit(False)))


def structured_body(nodes: Column) -> Column:
    """The first article body of more than LEAST_BODY characters, or null."""
    bodies = F.transform(F.filter(nodes, _is_article), lambda v: F.try_variant_get(v, "$.articleBody", "string"))
    body = F.get(F.filter(bodies, lambda b: F.length(b) > LEAST_BODY), F.lit(0))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("..", ".")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return body


def structured_date(nodes: Column) -> Column:
    """The first publication date of an article, as YYYY-MM-DD, or null."""
    dates = F.transform(F.filter(nodes, _is_article), lambda v: F.try_variant_get(v, "$.datePublished", "string"))
    day = F.transform(dates, lambda x: F.nullif(F.regexp_extract(x, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")))
    return F.get(F.filter(day, lambda x: x.isNotNull()), F.lit(0))


def main_content(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """(keep, method, text, published_at): each page's content and where it comes from: structured, selector, density, stripped or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [candidates(x.as_py()) for x in b["_html"]]
            found = [pa.array([x[k] for x in both], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, "_selector", "_density"])

    plain = F.regexp_replace(F.regexp_replace(text_of("_html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    nodes = structured_nodes(F.col("_html"))
    kinds = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keep)
    d = pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, f"{kinds}_html string, _selector string, _density string")
    d = d.select(*keep, structured_body(nodes).alias("_body"), structured_date(nodes).alias("published_at"), "_selector", "_density", plain.alias("_plain"))
    long = F.length("_selector") > LEAST_TEXT
    dense = valid_content("_density")
    pick = lambda name, c: F.struct(F.lit(name).alias("method"), F.col(c).alias("text"))
    best = (
        F.when(F.length("_body") > LEAST_TEXT, pick("structured", "_body"))
        .when(long & (~dense | (F.length("_selector") >= F.length("_density") * RATIO)), pick("selector", "_selector"))
        .when(dense, pick("density", "_density"))
        .when(valid_content("_plain"), pick("stripped", "_plain"))
        .otherwise(F.struct(F.lit("none").alias("method"), F.lit("").alias("text")))
    )
    return d.withColumn("_best", best).select(*keep, "_best.method", "_best.text", "published_at")
