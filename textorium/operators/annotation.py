"""Passages back to their places in the document, and the document as annotated and plain segments.

Each document's passages are taken in order; each gets the first place where it stands in what is still free, without
regard to case, else where it stands but for white space and for up to ELLIPSIS characters behind three dots. What is free is kept
as a list of gaps, so that a document whose passages tile it is gone through once.

Cases: blank passages, those with no frame above zero and those that stand nowhere free have no span; of equal probabilities the
first frame by name counts; a null text has no spans and no segments; repeated passages take further places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import slices

#: Characters that three dots in a passage may stand for.
ELLIPSIS = 160
SPAN = "start int, `end` int, frame string, p double"


def tolerant(passage: str) -> re.Pattern:
    """A passage whose white space may be any, and whose dots may stand for some text."""
    words = r"\s+".join(re.escape(w) for w in passage.split())
    return re.compile(re.sub(r"(?:\\\.){3}|…", f".{{0,{ELLIPSIS}}}?", words), re.IGNORECASE | re.DOTALL)


class Free:
    """What of a text has no span yet: gaps in order, those shorter than any passage left out."""

    def __init__(self, text: str, shortest: int):
        self.text, self.low, self.shortest = text, text.lower(), shortest
        if len(self.low) != len(text):  # a capital whose small form is longer: places would not agree
            self.low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.gaps = [(0, len(text))]

    def take(self, passage: str) -> tuple[int, int] | None:
        low = passage.lower() if len(passage.lower()) == len(passage) else passage
        for i, (a, b) in enumerate(self.gaps):
            if b - a >= len(low) and (at := self.low.find(low, a, b)) >= 0:
                return self._taken(i, at, at + len(low))
        if len(passage.split()) < 2 and not re.search(r"\.{3}|…", passage):
            return None  # no white space within and no dots: nothing to be tolerant of
        pattern = tolerant(passage)
        for i, (a, b) in enumerate(self.gaps):
            if (m := pattern.search(self.text, a, b)) and m.end() > m.start():
                return self._taken(i, m.start(), m.end())
        return None

    def _taken(self, i: int, start: int, end: int) -> tuple[int, int]:
        a, b = self.gaps[i]
        self.gaps[i : i + 1] = [g for g in ((a, start), (end, b)) if g[1] - g[0] >= self.shortest]
        return start, end


def top_frame(probabilities: Column) -> Column:
    """(p, frame) of the largest probability above zero of a map, else null."""
    e = F.transform(F.map_entries(probabilities), lambda x: F.struct((-x["value"]).alias("p"), x["key"].alias("frame")))
    best = F.array_min(F.filter(e, lambda x: x["p"] < 0))
    return F.when(best.isNotNull(), F.struct((-best["p"]).alias("p"), best["frame"].alias("frame")))


def located_spans(docs: DataFrame, passages: DataFrame, order: str, keys: Sequence[str] = ("doc_id",), text: str = "text", passage: str = "passage", top: str = "top") -> DataFrame:
    """(keys, start, end, frame, p, gap): the passages' places, 0-based, ends exclusive; gap: plain characters before a span.

    passages: (keys, order, passage, top), top as by `top_frame`.
    """
    keys = list(keys)
    p = passages.filter(F.col(top).isNotNull() & (F.trim(passage) != "")).groupBy(*keys)
    p = p.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(passage).alias("x"), F.col(f"{top}.frame").alias("f"), F.col(f"{top}.p").alias("p")))).alias("_own"))
    d = docs.select(*keys, F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).join(p, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("frame", pa.string()), ("p", pa.float64())]))
        for b in slices(batches):
            found = []
            for t, own in zip(b["_text"], b["_own"]):
                t, own = t.as_py(), own.as_py()
                free = Free(t, min(len(x["x"].strip()) for x in own))
                at = [(free.take(x["x"]), x) for x in own]
                found.append(sorted((*s, x["f"], x["p"]) for s, x in at if s))
            spans = pa.array([[dict(zip(("start", "end", "frame", "p"), s)) for s in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), spans], [*keys, "_spans"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    s = d.mapInArrow(run, f"{kinds}, _spans array<struct<start:int,`end`:int,frame:string,p:double>>")
    before = F.transform("_spans", lambda x, i: F.struct(x["start"], x["end"], x["frame"], x["p"], (x["start"] - F.when(i > 0, F.col("_spans")[i - 1]["end"]).otherwise(0)).alias("gap")))
    return s.select(*keys, F.explode(before).alias("s")).select(*keys, "s.*")


def segments(docs: DataFrame, spans: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, n, frame, p, segment): the annotated documents in order; frame is null for what lies between spans. Only documents with spans."""
    keys = list(keys)
    own = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "frame", "p"))).alias("_s"))
    d = docs.select(*keys, F.col(text).alias("_t")).join(own, keys)
    part = lambda a, b: F.substring("_t", a + 1, b - a)
    piece = lambda frame, p, x: F.struct(frame.alias("frame"), p.alias("p"), x.alias("segment"))
    no_frame, no_p = F.lit(None).cast("string"), F.lit(None).cast("double")
    both = F.transform("_s", lambda x, i: F.array(
        piece(no_frame, no_p, part(F.when(i > 0, F.col("_s")[i - 1]["end"]).otherwise(0), x["start"])), piece(x["frame"], x["p"], part(x["start"], x["end"]))))
    rest = piece(no_frame, no_p, part(F.element_at("_s", -1)["end"], F.length("_t")))
    every = F.filter(F.concat(F.flatten(both), F.array(rest)), lambda x: x["segment"] != "")
    return d.select(*keys, F.posexplode(every).alias("n", "x")).select(*keys, "n", "x.*")


def html(segments: DataFrame, colours: dict[str, str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, html): each document as markup, its frames as coloured spans by probability, line ends as breaks."""
    escaped = F.col("segment")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    rgb = {f: ", ".join(str(int(c.lstrip("#")[i : i + 2], 16)) for i in (0, 2, 4)) for f, c in colours.items()}
    colour = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in rgb.items() for x in kv)), F.col("frame")), F.lit("0, 0, 0")) if rgb else F.lit("0, 0, 0")
    opacity = F.greatest(F.lit(0.2), F.least(F.lit(0.95), F.col("p")))
    marked = F.when(F.col("frame").isNull(), escaped).otherwise(
        F.format_string('<span class="frame" style="background-color: rgba(%s, %.2f);" title="%s (%.2f)">%s</span>', colour, opacity, F.col("frame"), F.col("p"), escaped))
    d = segments.withColumn("_h", marked)
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "_h"))).alias("_p"))
    return d.select(*keys, F.replace(F.array_join(F.transform("_p", lambda x: x["_h"]), ""), F.lit("\n"), F.lit("<br>\n")).alias("html"))
