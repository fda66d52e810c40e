"""Column kernels shared by the audit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.patterns import java

#: Regions that never count as structure, in the order they are cut out (fixed values).
INERT = (r"<!--[\s\S]*?-->", r"<!\[CDATA\[[\s\S]*?\]\]>", r"<script\b[\s\S]*?<\/script>", r"<style\b[\s\S]*?<\/style>", r"<noscript\b[\s\S]*?<\/noscript>", r"<template\b[\s\S]*?<\/template>", r"<iframe\b[\s\S]*?<\/iframe>")
#: Regions without visible text, likewise.
UNSEEN = (*INERT[:6], r"<textarea\b[\s\S]*?<\/textarea>", INERT[6], r"<object\b[\s\S]*?<\/object>", r"<embed\b[^>]*>")
#: References to style sheets and inline styles.
STYLING = (r"<link\b[^>]*\brel\s*=\s*[\"']stylesheet[\"'][^>]*>", r"<link\b[^>]*\bas\s*=\s*[\"']style[\"'][^>]*>", r"\sstyle\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")


def blank(c: Column, patterns: tuple[str, ...]) -> Column:
    """Each match of each pattern, one pattern after the other, becomes a space."""
    for p in patterns:
        c = F.regexp_replace(c, java(p), " ")
    return c


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(group))


def first(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or the empty string."""
    return F.regexp_extract(c, java(pattern), group)


def has(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(java(pattern)))


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def shorten(c: Column, most: int = 300) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, java(r"^\s+|\s+$"), "")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding by ``floor(x + 0.5)``, as doubles."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def meta_content(head: Column, name: str) -> Column:
    """Content of the named meta element: null without the element, empty without the attribute."""
    tag = first(head, rf"<meta\b[^>]*\bname\s*=\s*[\"']{name}[\"'][^>]*>")
    return F.when(tag != "", first(tag, r"\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1))


def each(rows: DataFrame, elements: Column, name: str, *keep: Column | str) -> DataFrame:
    """``keep`` and one row per element that is not null.

    The plain generator makes the optimizer infer a filter on the array and push it down
    to the scan, where the whole expression is evaluated once more, before any exchange;
    the outer generator does not.
    """
    return rows.select(*keep, F.explode_outer(elements).alias(name)).filter(F.col(name).isNotNull())
