"""One notation for patterns, rendered for the JVM and for SQL engines with linear matching.

The notation is that of ECMAScript regular expressions: ``\\b`` and word characters are
ASCII, ``\\s`` covers the Unicode spaces, ``[\\s\\S]`` is any character. The JVM reads
``\\b`` by Unicode letters and ``\\s`` as ASCII, and linear engines lack look-around, so
both get their own rendering. Every pattern is matched without regard to letter case
unless it begins with ``(?-i)``.
"""

from __future__ import annotations

import re

_SPACES_JAVA = r"\t\n\x0B\f\r    -     　﻿"
_SPACES_RE2 = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_SPACES_PY = r"\t\n\x0b\f\r    -     　﻿"


def _render(pattern: str, spaces: str, before: str, after: str) -> str:
    case = "(?i)"
    if pattern.startswith("(?-i)"):
        case, pattern = "", pattern[5:]
    out: list[str] = []
    in_class = False
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith(r"[\s\S]", k):
            out.append("(?s:.)")
            k += 6
            continue
        if c == "\\" and k + 1 < len(pattern):
            d = pattern[k + 1]
            if d == "s":
                out.append(spaces if in_class else f"[{spaces}]")
            elif d == "b":
                out.append(before if k + 2 < len(pattern) and (pattern[k + 2].isalnum() or pattern[k + 2] == "(") else after)
            else:
                out.append(c + d)
            k += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(c)
        k += 1
    return case + "".join(out)


def java(pattern: str) -> str:
    return _render(pattern, _SPACES_JAVA, "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])")


def python(pattern: str) -> re.Pattern[str]:
    return re.compile(_render(pattern, _SPACES_PY, "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"))


def linear(pattern: str) -> str:
    """For engines whose ``\\b`` is ASCII and which have no look-around, as a quoted SQL literal."""
    return "'" + _render(pattern, _SPACES_RE2, r"\b", r"\b").replace("'", "''") + "'"
