"""Size and text metrics of a page, and the advice codes that follow from them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.patterns import java
from sitegauge.functions.text import STYLING, UNSEEN, blank, count, find_all, half_up, trim_all, units

STYLE_BLOCK = r"<style\b[^>]*>([\s\S]*?)<\/style>"
_OBJECT = re.compile(r'\{\s*"')
_KEYED = re.compile(r'"(?:@context|@type|@graph|@id|__\w+)"\s*:')
_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{}]", re.S)
_NUMERIC = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,6})|(\d{1,7}));")


def _numeric(m: re.Match[str]) -> str:
    n = int(m[1], 16) if m[1] else int(m[2])
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else " "


def _object_end(text: str, begin: int) -> int:
    """Where the brace at ``begin`` closes, strings skipped; -1 if it does not."""
    depth = 0
    for m in _QUOTED.finditer(text, begin):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


def without_objects(text: str, most: int = 4000) -> str:
    """Cuts out up to ``most`` runs of object notation; other braces before a quote just go."""
    done, rest = [], text
    for _ in range(most):
        m = _OBJECT.search(rest)
        if not m:
            break
        begin = m.start()
        end = _object_end(rest, begin)
        block = rest[begin:end].strip() if end > 0 else ""
        data = len(block) >= 24 and (_KEYED.search(block) or (block.count('"') >= 6 and block.count(":") >= 3))
        done.append(rest[:begin] + " ")
        rest = rest[end if data else begin + 1 :]
    return "".join(done) + rest


@F.pandas_udf(T.StringType())
def _finish(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else without_objects(_NUMERIC.sub(_numeric, t)))


def _named(c: Column) -> Column:
    # the ampersand comes first, so that text escaped twice is read twice
    for name, text in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        c = F.regexp_replace(c, f"(?i)&{name};", text)
    return F.replace(c, F.lit("&#39;"), F.lit("'"))


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, java(r"\s+"), " "))


def with_visible_chars(rows: DataFrame, stripped: str) -> DataFrame:
    """Adds ``visible_chars``: units of text without tags, references decoded.

    Only texts that hold numeric references or what looks like object notation pass
    through Python. Each step is a column, so that no step is evaluated twice.
    """
    rows = rows.withColumn("_text", _named(F.regexp_replace(stripped, "<[^>]+>", " ")))
    rows = rows.withColumn("_slow", F.when(F.col("_text").rlike(r"&#[0-9xX]|\{\s*\""), F.col("_text")))
    rows = rows.withColumn("_done", _finish("_slow"))
    return rows.withColumn("visible_chars", units(collapse(F.coalesce("_done", "_text")))).drop("_text", "_slow", "_done")


def ratio(markup: Column, visible: Column) -> Column:
    return half_up(markup / F.greatest(visible, F.lit(1)), 2)


def text_metrics(pages: DataFrame) -> DataFrame:
    """``page_id, html_bytes, markup_bytes, visible_chars, html_to_text_ratio``; no rows for null html."""
    base = pages.filter("html is not null").select("page_id", "html", blank(F.col("html"), UNSEEN).alias("stripped"))
    sized = base.select("page_id", "stripped", F.octet_length("html").alias("html_bytes"), F.octet_length(blank(F.col("stripped"), STYLING)).alias("markup_bytes"))
    return with_visible_chars(sized, "stripped").drop("stripped").withColumn("html_to_text_ratio", ratio(F.col("markup_bytes"), F.col("visible_chars")))


def sheet_pattern(domain: str) -> str:
    d = re.escape(domain)
    rel, href = r"\brel\s*=\s*[\"']stylesheet[\"']", rf"\bhref\s*=\s*[\"'][^\"']*{d}[^\"']*[\"']"
    return rf"<link\b[^>]*{rel}[^>]*{href}[^>]*>|<link\b[^>]*{href}[^>]*{rel}[^>]*>"


def css_metrics(pages: DataFrame, domain: str) -> DataFrame:
    """``page_id, css_chars, css_ext_count, css_inline_count, css_to_text_ratio``."""
    styles = find_all(F.col("html"), STYLE_BLOCK, 1)
    css = pages.filter("html is not null").select(
        "page_id",
        F.aggregate(F.transform(styles, units), F.lit(0), lambda a, b: a + b).alias("css_chars"),
        count(F.col("html"), sheet_pattern(domain)).alias("css_ext_count"),
        F.size(styles).alias("css_inline_count"),
        blank(F.col("html"), UNSEEN).alias("stripped"),
    )
    return with_visible_chars(css, "stripped").select("page_id", "css_chars", "css_ext_count", "css_inline_count", ratio(F.col("css_chars"), F.col("visible_chars")).alias("css_to_text_ratio"))


def page_metrics(pages: DataFrame, domain: str, *more: Column) -> DataFrame:
    """``text_metrics`` and ``css_metrics`` of a page in one scan; inline styles as ``inline_css_chars``,
    and ``more`` columns of its html."""
    styles = find_all(F.col("html"), STYLE_BLOCK, 1)
    base = pages.filter("html is not null").select(
        "page_id",
        F.octet_length("html").alias("html_bytes"),
        F.aggregate(F.transform(styles, units), F.lit(0), lambda a, b: a + b).alias("inline_css_chars"),
        count(F.col("html"), sheet_pattern(domain)).alias("css_ext_count"),
        F.size(styles).alias("css_inline_count"),
        blank(F.col("html"), UNSEEN).alias("stripped"),
        *more,
    )
    sized = base.withColumn("markup_bytes", F.octet_length(blank(F.col("stripped"), STYLING)))
    full = with_visible_chars(sized, "stripped").drop("stripped")
    return full.withColumn("html_to_text_ratio", ratio(F.col("markup_bytes"), F.col("visible_chars"))).withColumn("css_to_text_ratio", ratio(F.col("inline_css_chars"), F.col("visible_chars")))


def size_advice(pages: DataFrame, domain: str) -> DataFrame:
    """``page_id, ord, tactic``: at most six codes of what would make the page lighter."""
    m = page_metrics(pages, domain)
    r = F.col("html_to_text_ratio")
    codes = F.array(
        F.when(r > 30, "ratio_very_high").when(r > 15, "ratio_high").otherwise("ratio_fine"),
        F.when(F.col("css_to_text_ratio") > 2, "inline_css_heavy").when(F.col("css_inline_count") > 2, "many_style_blocks"),
        F.when(F.col("css_ext_count") > 5, "many_style_sheets"),
        F.when(F.col("html_bytes") > 200_000, "page_too_large"),
        F.when(F.col("markup_bytes") > 80_000, "markup_too_large"),
        F.lit("minify"),
    )
    kept = F.slice(F.filter(codes, lambda c: c.isNotNull()), 1, 6)
    return m.select("page_id", F.posexplode(kept).alias("ord", "tactic"))


def stripped_html(c: Column) -> Column:
    """Markup without scripts, styles and widgets, runs of white space shortened."""
    c = blank(blank(c, UNSEEN), STYLING)
    c = F.regexp_replace(F.regexp_replace(c, r"[\t\f\x0B]+", " "), " {2,}", " ")
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))
