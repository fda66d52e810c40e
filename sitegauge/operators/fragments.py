"""Scans of a page that are sequential by nature: bloated segments and chunks for evaluators.

Both run as Arrow batches over the pages; nothing leaves a page, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.patterns import python
from sitegauge.functions.text import STYLING, UNSEEN
from sitegauge.operators.metrics import _NUMERIC, _numeric, stripped_html

# Fixed values.
SEGMENT_TAGS = ("div", "section", "article", "nav", "header", "footer", "aside", "main", "ul", "ol", "table")
LANDMARKS = ("header", "nav", "main", "section", "article", "aside", "footer")
VOID_TAGS = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CHUNK_BYTES = 30 * 1024

_UNSEEN = [python(p) for p in UNSEEN]
_STYLING = [python(p) for p in STYLING]
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)(?![A-Za-z0-9_])([^>]*)>")
_NAMED = ((re.compile("&nbsp;", re.I), " "), (re.compile("&amp;", re.I), "&"), (re.compile("&lt;", re.I), "<"), (re.compile("&gt;", re.I), ">"), (re.compile("&quot;", re.I), '"'), (re.compile("&#39;"), "'"))


def _blank(text: str, patterns: list[re.Pattern[str]]) -> str:
    for p in patterns:
        text = p.sub(" ", text)
    return text


def _weigh(segment: str) -> tuple[int, int]:
    """Bytes of markup and units of visible text."""
    stripped = _blank(segment, _UNSEEN)
    text = re.sub(r"<[^>]+>", " ", stripped)
    for pattern, stand_in in _NAMED:
        text = pattern.sub(stand_in, text)
    text = " ".join(_NUMERIC.sub(_numeric, text).split())
    return len(_blank(stripped, _STYLING).encode()), len(text.encode("utf-16-le", "surrogatepass")) // 2


def _spans(page: str, tag: str) -> list[tuple[int, int]]:
    """``(begin, end)`` of every element of a tag that is closed, by order of its opening."""
    opener = re.compile(rf"<{tag}(?:\s[^>]*)?>", re.I)
    openers = {m.start() for m in opener.finditer(page)}
    waiting: list[int] = []
    found = {}
    for m in re.finditer(rf"<(/?){tag}(?![A-Za-z0-9_])[^>]*>", page, re.I):
        if not m[1]:
            waiting.append(m.start())
        elif waiting:
            found[waiting.pop()] = m.end()
    return sorted((b, e) for b, e in found.items() if b in openers)


def _shape(snippet: str) -> str:
    """What is left of a snippet's structure without texts and attribute values."""
    bare = re.sub(r">[^<]*<", "><", re.sub(r"=[\"'][^\"']*[\"']", '=""', snippet))
    return " ".join(bare.split())[:200]


def top_segments(page: str, top: int = 5, most: int = 80) -> list[tuple[str, float, int, int, int, int, str]]:
    """``(tag, ratio, markup_bytes, visible_chars, begin, end, snippet)`` of the heaviest segments.

    The first ``most`` segments of 300 to 60,000 units with five visible units or more, by
    tag and position, compete; heavier ones exclude those they overlap, and of equal
    structure only the heaviest stays.
    """
    spans = ((tag, *span) for tag in SEGMENT_TAGS for span in _spans(page, tag) if 300 <= span[1] - span[0] <= 60_000)
    weighed = ((tag, begin, end, *_weigh(page[begin:end])) for tag, begin, end in spans)
    pool = list(islice((w for w in weighed if w[4] >= 5), most))
    if not pool:
        return []
    begins, ends, markup, visible = (np.array([w[k] for w in pool]) for k in (1, 2, 3, 4))
    ratios = np.floor(markup / visible * 100 + 0.5) / 100
    names: dict[str, int] = {}
    shapes = np.array([names.setdefault(_shape(page[b:e][:500]), len(names)) for b, e in zip(begins, ends)])
    alive = np.ones(len(pool), bool)
    out = []
    # every pick removes itself, what it overlaps and what is built like it
    while alive.any() and len(out) < top:
        k = int(np.argmax(np.where(alive, ratios, -1.0)))
        out.append((pool[k][0], float(ratios[k]), int(markup[k]), int(visible[k]), int(begins[k]), int(ends[k]), page[begins[k] : ends[k]][:500]))
        alive &= ((ends <= begins[k]) | (begins >= ends[k])) & (shapes != shapes[k])
    return out


def _segments(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.string()]
    names = ["page_id", "rank", "tag", "ratio", "markup_bytes", "visible_chars", "begin", "end", "snippet"]
    for batch in batches:
        rows = [(i, k + 1, *s) for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if page for k, s in enumerate(top_segments(page, top))]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def bloated_segments(pages: DataFrame, top: int = 5) -> DataFrame:
    """``page_id, rank, tag, ratio, markup_bytes, visible_chars, begin, end, snippet``; null html gives no rows."""
    rows = pages.select(F.col("page_id").cast("bigint"), "html")
    return rows.mapInArrow(lambda b: _segments(b, top), "page_id bigint, rank int, tag string, ratio double, markup_bytes int, visible_chars int, begin int, end int, snippet string")


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def byte_prefix(text: str, most: int) -> str:
    """The longest prefix of whole characters within ``most`` bytes."""
    return text.encode("utf-8", "surrogatepass")[: max(most, 0)].decode("utf-8", "ignore")


def slices(text: str, most: int) -> list[str]:
    """A text in runs of whole characters of at most ``most`` bytes; none if not one fits."""
    widths = _widths(text)
    out, at = [], 0
    while at < len(text):
        until = int(np.searchsorted(widths, widths[at] + most, "right")) - 1
        if until == at:
            break
        out.append(text[at:until])
        at = until
    return out


def _widths(text: str) -> np.ndarray:
    """Bytes before every character, and before the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])


class Markup:
    """A text with the tags of one pass over it: where they begin and how they change the depth."""

    def __init__(self, text: str):
        self.text = text
        self.widths = _widths(text)
        found = [(m.start(), m.end(), m[3].endswith("/") or m[2].lower() in VOID_TAGS, bool(m[1])) for m in _ANY_TAG.finditer(text)]
        begin, end, leaf, closing = (np.array([f[k] for f in found], t) for k, t in enumerate((np.int64, np.int64, bool, bool)))
        self.begin, self.end, self.leaf = begin, end, leaf
        self.starting = leaf | ~closing
        self.step = np.where(leaf, 0, np.where(closing, -1, 1))

    def size(self, a: int, b: int) -> int:
        return int(self.widths[b] - self.widths[a])

    def siblings(self, a: int, b: int) -> list[int]:
        """Where the elements at the top level of a range begin, the first one left out.

        A closing tag without an opening one does not go below the top level: the depth is
        the running sum of the steps above its own lowest point so far.
        """
        i, j = np.searchsorted(self.begin, [a, b])
        before = np.concatenate([[0], np.cumsum(self.step[i:j])])[:-1]
        depth = before - np.minimum(np.minimum.accumulate(before), 0) if j > i else before
        top = np.flatnonzero((depth == 0) & self.starting[i:j])
        return (self.begin[i + top[1:]]).tolist()

    def inside(self, a: int, b: int) -> tuple[int, int] | None:
        """The range between the tags of the one element that encloses a range."""
        i = int(np.searchsorted(self.begin, a))
        if i == len(self.begin) or self.end[i] > b or self.text[a : self.begin[i]].strip():
            return None
        name = _ANY_TAG.match(self.text, int(self.begin[i]))
        if name[1] or name[2].lower() in VOID_TAGS:
            return None
        last = self.text.rfind("<", a, b)
        if last < self.end[i] or not re.compile(rf"</\s*{re.escape(name[2])}\s*>\s*\Z", re.I).match(self.text[last:b]):
            return None
        return int(self.end[i]), last


def pack(markup: Markup, ranges: list[tuple[int, int]], most: int) -> list[str | tuple[int, int]]:
    """Ranges in order, as many together as fit, as text; those over the budget stay ranges.

    A range of white space alone joins the next text and is dropped at the end.
    """
    out: list[str | tuple[int, int]] = []
    held = ""
    room = most
    for a, b in ranges:
        n = markup.size(a, b)
        if n > room and held.strip():
            out.append(held)
            held, room = "", most
        if n > most:
            out.append((a, b))
        else:
            held, room = held + markup.text[a:b], room - n
    return [*out, held] if held.strip() else out


def divide(markup: Markup, a: int, b: int, most: int) -> list[str]:
    """A range in pieces within the budget: between siblings, else inside the element that
    encloses it, whose tags stay with the first and the last piece, else by bytes."""
    out: list[str] = []
    work: list[tuple] = [("range", a, b)]
    while work:
        kind, *what = work.pop()
        if kind == "text":
            out.append(what[0])
        elif kind == "wrap":
            # the pieces of what the element holds are those from ``first`` on
            first, opening, closing = what
            out[first] = opening + out[first]
            out[-1] += closing
            out[-1:] = _within(out[-1], most)
            out[first : first + 1] = _within(out[first], most)
        elif markup.size(*what) <= most:
            out.append(markup.text[what[0] : what[1]])
        elif cuts := markup.siblings(*what):
            bounds = [what[0], *cuts, what[1]]
            parts = pack(markup, [r for r in zip(bounds, bounds[1:]) if r[0] < r[1]], most)
            work += [("text", p) if isinstance(p, str) else ("range", *p) for p in reversed(parts)]
        elif (inner := markup.inside(*what)) and markup.text[inner[0] : inner[1]].strip():
            work += [("wrap", len(out), markup.text[what[0] : inner[0]], markup.text[inner[1] : what[1]]), ("range", *inner)]
        else:
            out.extend(slices(markup.text[what[0] : what[1]], most))
    return out


def _within(text: str, most: int) -> list[str]:
    return [text] if _size(text) <= most else slices(text, most) or [text]


def _head_split(text: str) -> tuple[str, str, str]:
    m = re.search(r"<head.*?</head>", text, re.I | re.S)
    return (text[: m.start()], m[0], text[m.end() :]) if m else ("", "", text)


def capped(stripped: str, most: int = CHUNK_BYTES) -> tuple[str, bool]:
    """One payload: as it is if it fits, else the head whole and the body cut, marked as cut."""
    if _size(stripped) <= most:
        return stripped, False
    before, head, body = _head_split(stripped)
    mark = "\n<!-- audit-truncated -->\n"
    return before + head + byte_prefix(body, most - _size(before + head + mark)) + mark, True


_AT_LANDMARK = re.compile(rf"(?=<(?:{'|'.join(LANDMARKS)})[\s>])", re.I)


def chunks(stripped: str, most: int = CHUNK_BYTES) -> list[str]:
    """Payloads within the budget, markers aside: the head, then the body by landmarks."""
    if _size(stripped) <= most:
        return [stripped]
    before, head, body = _head_split(stripped)
    out = []
    if head:
        whole = f"{before}{head}\n<!-- chunk:head -->"
        out = [whole] if _size(whole) <= most else [x + "\n<!-- chunk:head-part -->" for x in divide(Markup(whole), 0, len(whole), most)]
    starts = sorted({0, *(m.start() for m in _AT_LANDMARK.finditer(body)), len(body)})
    whole_body = Markup(body)
    for part in pack(whole_body, [(a, b) for a, b in zip(starts, starts[1:]) if body[a:b].strip()], most):
        if isinstance(part, str):
            out.append(part)
        else:
            text = body[part[0] : part[1]]
            out.extend(x + "\n<!-- chunk:body-part -->" for x in divide(Markup(text), 0, len(text), most))
    return out or [stripped]


def _chunk(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = [(i, k, _size(c), c) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text is not None for k, c in enumerate(chunks(text, most))]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "chunk", "bytes", "text"])


def html_chunks(pages: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """``page_id, chunk, bytes, text``; null html gives no rows, empty html one empty chunk."""
    rows = pages.select(F.col("page_id").cast("bigint"), stripped_html(F.col("html")).alias("html"))
    return rows.mapInArrow(lambda b: _chunk(b, most), "page_id bigint, chunk int, bytes int, text string")
