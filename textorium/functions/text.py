"""Text expressions: Column -> Column. Null texts are treated as empty unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a page as an error page rather than content.
ERROR_PHRASES = (
    "verify you are human", "verification successful", "waiting for", "to respond", "security check", "captcha",
    "access denied", "403 forbidden", "404 not found", "page not found", "robot check", "javascript is disabled",
    "enable javascript", "cookies are disabled", "please enable cookies", "cloudflare", "ddos protection",
    "checking your browser", "please wait", "security challenge",
)

# Words that tie a sentence to the one before.
CONNECTORS = (
    "however", "but", "therefore", "despite", "meanwhile", "consequently", "furthermore", "moreover", "nevertheless",
    "nonetheless", "accordingly", "hence", "thus", "whereas", "whereby", "albeit", "though", "although",
)


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def quoted(literal: str) -> str:
    """A literal as a Java regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(r"\S+")).cast("long")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text_of(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def statistics(c: Column | str) -> dict[str, Column]:
    t = text_of(c)
    words, chars = word_count(t), F.length(t).cast("long")
    sentences = F.size(F.filter(F.split(t, "[.]"), lambda s: F.length(F.regexp_replace(s, r"\s+", "")) > 0)).cast("long")
    mean = F.when(words > 0, F.round(chars.cast("double") / words, 2)).otherwise(0.0)
    return {"word_count": words, "char_count": chars, "sentence_count": sentences, "avg_word_length": mean}


def contains_any(c: Column | str, terms: Iterable[str], case_sensitive: bool = False) -> Column:
    t = text_of(c) if case_sensitive else F.lower(text_of(c))
    out = F.lit(False)
    for term in terms:
        out = out | t.contains(term if case_sensitive else term.lower())
    return out


def keyword_match(c: Column | str, keyword: str) -> Column:
    """`word:x` whole words, `regex:p` a pattern (a substring if it doesn't compile), else a substring; no case."""
    t = text_of(c)
    if keyword.startswith("word:"):
        return t.rlike(rf"(?iU)\b{quoted(keyword[5:])}\b")
    if keyword.startswith("regex:"):
        try:
            re.compile(keyword[6:])
            return t.rlike(f"(?i){keyword[6:]}")
        except re.error:
            keyword = keyword[6:]
    return F.lower(t).contains(keyword.lower())


def keyword_pattern(keyword: str, whole_word: bool = True, hyphenation: bool = True, case_sensitive: bool = False) -> str:
    """Pattern of a keyword: whole words, and split by a hyphen or line break anywhere that leaves two characters."""
    forms = [quoted(keyword)]
    if hyphenation and len(keyword) >= 3:
        forms += [rf"{quoted(keyword[:i])}\s*[-\n]\s*{quoted(keyword[i:])}" for i in range(2, len(keyword) - 1)]
    body = f"(?:{'|'.join(forms)})"
    flags = "U" if case_sensitive else "iU"
    return f"(?{flags})" + (rf"\b{body}\b" if whole_word else body)


def keyword_count(c: Column | str, keyword: str, **modes) -> Column:
    return F.regexp_count(text_of(c), F.lit(keyword_pattern(keyword, **modes))).cast("long")


def keyword_position(c: Column | str, keyword: str, **modes) -> Column:
    """0-based place of the first hit; null without one."""
    at = F.regexp_instr(text_of(c), F.lit(keyword_pattern(keyword, **modes)))
    return F.when(at > 0, (at - 1).cast("long"))


def organisation(c: Column | str, short: str, full: Sequence[str]) -> Column:
    """An organisation by its short name as a word, or by its full name across dashes and line breaks, `and` or `&`."""
    gap = r"\s*[-–—\n\s]*"
    words = gap.join("(?:and|&)" if w == "and" else "(?:Centre|Center)" if w in ("Centre", "Center") else quoted(w) for w in full)
    return text_of(c).rlike(rf"(?iU)\b{quoted(short)}\b") | text_of(c).rlike(f"(?iU){words}")


def clean(c: Column | str, trim_after: Sequence[str] = (), exclude: Sequence[str] = (), min_hits: dict[str, int] | None = None) -> Column:
    """Text up to the first trim marker, stripped; null if an exclude pattern or too many phrase hits drop it."""
    patterns = []
    for p in exclude:
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)

    def cut(t: Column, markers: Sequence[str]) -> Column:
        if not markers:
            return t
        at = F.locate(markers[0].lower(), F.lower(t))
        return let(F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), lambda x: cut(x, markers[1:]))

    def kept(t: Column) -> Column:
        drop = F.lit(False)
        for p in patterns:
            drop = drop | t.rlike(f"(?im){p}")
        for phrase, n in (min_hits or {}).items():
            drop = drop | (F.regexp_count(F.lower(t), F.lit(quoted(phrase.lower()))) >= max(1, n))
        return F.when(~drop & (t != ""), t)

    return let(strip(let(strip(c), lambda t: cut(t, trim_after))), kept)


def valid_content(c: Column | str, least_chars: int = 100, least_words: int = 10) -> Column:
    t = text_of(c)
    return (F.length(t) >= least_chars) & (word_count(t) >= least_words) & ~contains_any(t, ERROR_PHRASES)


def starts_with_connector(c: Column | str) -> Column:
    first = F.regexp_replace(F.lower(F.regexp_extract(text_of(c), r"^\s*(\S+)", 1)), r"[.,!?:;]+$", "")
    return first.isin(*CONNECTORS)


def shortened(c: Column | str, n: int) -> Column:
    """At most n characters, cut at the last space, with an ellipsis."""
    t = text_of(c)
    cut = F.concat(F.regexp_replace(F.substring(t, 1, n), r"\s\S*\z", ""), F.lit("..."))
    return F.when(F.length(t) <= n, t).otherwise(cut)


def html_title(c: Column | str) -> Column:
    title = F.regexp_extract(text_of(c), r"(?i)<title[^>]*>([^<]+)</title>", 1)
    heading = F.regexp_extract(text_of(c), r"(?i)<h1[^>]*>([^<]+)</h1>", 1)
    return F.nullif(strip(F.coalesce(F.nullif(title, F.lit("")), heading)), F.lit(""))


def html_plain(c: Column | str) -> Column:
    """Tags gone, white space collapsed, character references as spaces."""
    t = F.regexp_replace(text_of(c), r"<[^>]+>", "")
    t = F.regexp_replace(t, r"\s+", " ")
    return strip(F.regexp_replace(t, r"&[a-zA-Z]+;", " "))


def iso_date_in(c: Column | str) -> Column:
    """The first YYYY-MM-DD in a text that is a date."""
    return F.date_format(F.try_to_date(F.nullif(F.regexp_extract(text_of(c), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd"), "yyyy-MM-dd")


# Dates as they are looked for in pages, in this order, with the formats that each is read by.
DATES = (
    (r"(\d{4}-\d{2}-\d{2})", ("yyyy-MM-dd",)),
    (r"(\d{4}/\d{2}/\d{2})", ("yyyy/MM/dd",)),
    (r"(\d{2}/\d{2}/\d{4})", ("MM/dd/yyyy",)),
    (r"(\d{1,2}\s+\w+\s+\d{4})", ("d MMMM yyyy",)),
    (r"(\w+\s+\d{1,2},?\s+\d{4})", ("MMMM d, yyyy", "MMMM d yyyy")),
)


def date_in(c: Column | str) -> Column:
    """The first date of a text as YYYY-MM-DD, by the first pattern that finds one; null without any."""
    found = []
    for pattern, formats in DATES:
        read = lambda x: F.coalesce(*(F.try_to_date(F.initcap(F.regexp_replace(x, r"\s+", " ")), f) for f in formats))  # noqa: B023, E731
        days = F.transform(F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(1)), read)
        found.append(F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0)))
    return F.date_format(F.coalesce(*found), "yyyy-MM-dd")
