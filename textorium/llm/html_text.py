"""Operator 4: main text of web pages by line-block distribution.

Markup is stripped into one line per block element, and what stands in menus, headers, footers, sidebars, notices,
adverts, forms and comments becomes an empty line. Markup only weighs the lines: those of an article or main element by their
length and all others of such a page by nothing, without one by the text outside of links. The weights are then
summed over sliding windows of lines, on every page alike: the main text starts where the sums surge and ends
where they dive to nothing, and every line between the two stays. A surge is a sum of SURGE characters, or of a
PART of the page's largest sum where that is less, so that short articles have one too.

Cases: null html is empty, and a page without main text has an empty text and 0 characters; unclosed and crossed
tags end with their container; repeated rows are extracted each; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a sliding window, and the characters, or the part of the largest sum, that make a surge.
LINES = 3
SURGE, PART = 80, 0.25

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: Elements whose content never is main text.
DROPPED = frozenset("nav header footer aside form menu dialog button select textarea iframe object noscript svg head template canvas audio video map".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind, or of these kinds, ends.
ENDS = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that hold text themselves: their names say what it is about, not where it stands.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Whole ids that still count within the article, where others are anchors.
PARTS = re.compile(r"comments?|comment-?list|respond|replies|disqus\w*|sidebar|related|newsletter|share|sharing|social|ads?|advert\w*|promo\w*|cookie\w*", re.I)
#: Words of a class, id or role that name what isn't the article.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|navbar|breadcrumbs?|header|masthead|footer|notices?"
    r"|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|sharing|social|related|recommend\w*|comments?"
    r"|commentlist|replies|reply|respond|disqus|pagination|pager|toolbar|widget|copyright|legal|disclaimer|contentinfo|complementary|navigation"
    r"|alert|skip|tags?|toc)(?=$|[\s_-])",
    re.I,
)
#: Comments, character data, declarations and tags; a tag whose quotes don't close ends at the next bracket. Each
#: stops at the next tag or reads to the end of the page once, so that broken markup takes linear time.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>", re.S
)
NAMES = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def lines(page: str, forms: bool = False) -> list[tuple[str, bool, bool, int]]:
    """(text, aside, in the article, characters in links) of each block in page order; with forms, these are like any container."""
    out: list[tuple[str, bool, bool, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, aside, article
    opened: Counter = Counter()  # names in the stack
    in_link = 0

    def drop(k):
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def flush():
        t = " ".join(entities.unescape("".join(text)).split())
        if t:
            out.append((t, stack[-1][1] if stack else False, stack[-1][2] if stack else False, len(" ".join(entities.unescape("".join(linked)).split()))))
        text.clear()
        linked.clear()

    def add(s):
        text.append(s)
        if in_link:
            linked.append(s)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1].replace("&", "&amp;"))
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        flush() if any(x[0] in BLOCKS or x[1] for x in stack[k:]) else None
                        drop(k)
                        break
                    if stack[k][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                        break  # a stray end tag doesn't close what holds it
            if name == "a":
                in_link = 0
            continue
        if name == "br" or name == "wbr":
            add(" " if name == "br" else "")
            continue
        if name in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        block = name in BLOCKS
        if block:
            flush()
            while stack and name in ENDS.get(stack[-1][0], ()):
                drop(len(stack) - 1)
            for k in range(len(stack) - 1, -1, -1):  # an open p below inline tags ends as well
                if stack[k][0] == "p" and name in ENDS["p"]:
                    drop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID or m[0].endswith("/>") and not block:
            continue
        if name == "a":
            in_link = 1
        aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        off = name in DROPPED and not (forms and name == "form")
        if not off and m[4] and name not in ("html", "body", "article", "main"):
            named = name not in TEXTS and any(PARTS.fullmatch(x) if article and a.lower() == "id" else ASIDE.search(x) for a, *g in NAMES.findall(m[4]) for x in g if x)
            off = named or bool(HIDDEN.search(m[4]))
        if off and not aside and not block:
            flush()
        stack.append((name, aside or off, article or name in ("article", "main")))
        opened[name] += 1
    flush()
    return out


def main_text(page: str | None) -> str:
    """The blocks between surges and dives, joined by newlines; where forms hold all of a page, of what is in them."""
    return _between(lines(page or "")) or (_between(lines(page, forms=True)) if page and re.search("<form", page, re.I) else "")


def _between(found: list[tuple[str, bool, bool, int]]) -> str:
    named = any(article and not aside for _, aside, article, _ in found)
    out = [aside or named and not article for _, aside, article, _ in found]
    weight = [0 if off else max(0, len(t) - (0 if named else 2 * in_links)) for off, (t, _, _, in_links) in zip(out, found)]
    ahead = [sum(weight[i : i + LINES]) for i in range(len(weight))]
    surge = min(SURGE, PART * max(ahead, default=0))
    kept: list[str] = []
    i = 0
    while i < len(weight):
        if not weight[i]:
            i += 1
            continue
        dive = i  # nothing in the window that starts there
        while dive < len(weight) and ahead[dive] > 0:
            dive += 1
        if max(ahead[i:dive]) >= surge:
            kept += [found[k][0] for k in range(i, dive) if not out[k]]
        i = dive + 1
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html", *keep: str) -> DataFrame:
    """(id, keep..., text, n_chars), a row per row of pages; no shuffle. Kept columns of the last two names give way to them."""
    keep = [k for k in keep if k not in (id_col, "text", "n_chars")]
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    d = pages.select(F.col(id_col).alias("c0"), *(F.col(k).alias(f"c{i + 1}") for i, k in enumerate(keep)), F.col(html).alias("html"))

    def run(batches):
        for b in batches:
            out = b.drop(columns=["html"])
            out["text"] = [main_text(x if isinstance(x, str) else None) for x in b["html"]]
            out["n_chars"] = [len(x) for x in out["text"]]
            yield out

    fields = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    return d.mapInPandas(run, f"{fields}, text string, n_chars long").toDF(id_col, *keep, "text", "n_chars")
