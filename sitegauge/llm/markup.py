"""Reading the visible text of HTML, block by block, in one linear scan."""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)([^<>]*)>|<![^<>]*>")
_SPACE = re.compile(r"\s+")
_ALT = re.compile(r"\b(?:alt|title)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|text-indent\s*:\s*-\d{3}|\bhidden\b|opacity\s*:\s*0(?![.\d])", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CODE = frozenset(("code", "pre", "samp", "kbd", "xmp"))
_CHROME = frozenset(("nav", "footer", "header"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    """A run of visible text between block-level tags."""

    text: str
    #: the element around it: ``title``, a heading, ``alt`` for a picture description, or the nearest block tag
    kind: str
    #: ``nav``, ``header``, ``footer`` or empty
    region: str
    linked: int
    code: bool
    noscript: bool


def clean(text: str) -> str:
    if "&" in text:
        text = _html.unescape(text)
    return _SPACE.sub(" ", text).strip()


def blocks(source: str, alts: bool = False) -> list[Block]:
    """The title, the visible text in blocks, and with ``alts`` the picture descriptions.

    Scripts, styles, templates, embedded objects and comments are left out, unclosed
    ones to the end of the text. ``noscript`` text is marked; a tag ends at its first
    ``>``; closing tags close the nearest open element of their name.
    """
    source = _DROPPED.sub(" ", source)
    out: list[Block] = []
    buffer: list[str] = []
    linked = 0
    stack: list[str] = []
    nav = footer = header = code = noscript = anchor = 0
    coded = False
    kind = "body"
    position = 0

    def flush() -> None:
        nonlocal linked, coded
        if buffer:
            text = clean("".join(buffer))
            if text:
                region = "nav" if nav else "footer" if footer else "header" if header else ""
                out.append(Block(text, kind, region, linked, coded, noscript > 0))
            buffer.clear()
        linked, coded = 0, False

    for m in _TAG.finditer(source):
        begin = m.start()
        if begin > position:
            piece = source[position:begin]
            buffer.append(piece)
            if anchor:
                linked += len(piece)
            if code and not piece.isspace():
                coded = True
        position = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if alts and name == "img" and (got := _ALT.search(m[3])):
            text = clean(got[1] or got[2] or "")
            if text:
                out.append(Block(text, "alt", "nav" if nav else "footer" if footer else "header" if header else "", 0, False, noscript > 0))
        inline = name in _INLINE
        if not inline:
            flush()
        elif name != "a":
            buffer.append("" if name in ("b", "i", "em", "strong", "wbr", "font", "mark") else " ")
        if name in _VOID or m[3].endswith("/"):
            continue
        step = -1 if m[1] else 1
        if step < 0:
            if name not in stack:
                continue
            while stack[-1] != name:
                dead = stack.pop()
                if dead == "nav":
                    nav -= 1
                elif dead == "footer":
                    footer -= 1
                elif dead == "header":
                    header -= 1
                elif dead == "noscript":
                    noscript -= 1
                elif dead == "a":
                    anchor -= 1
                elif dead in _CODE:
                    code -= 1
            stack.pop()
        else:
            stack.append(name)
        if name == "a":
            anchor += step
        elif name == "nav":
            nav += step
        elif name == "footer":
            footer += step
        elif name == "header":
            header += step
        elif name == "noscript":
            noscript += step
        elif name in _CODE:
            code += step
        if not inline:
            kind = name if step > 0 else stack[-1] if stack else "body"
    if position < len(source):
        buffer.append(source[position:])
    flush()
    return out
