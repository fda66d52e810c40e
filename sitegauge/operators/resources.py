"""Scripts and style sheets of pages: classification, totals, unused shares."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.text import count, each, find_all, half_up, has, units

# Fixed values.
JS_PACKAGE_FILE = r"\b(vendors?[-~.]|chunk[-.]?vendor|react(?:-dom)?|jquery|lodash|underscore|polyfill|core[-.]?js|regenerator|runtime[-.]|framework[-.]|angular|vue\b|bootstrap|webpack[-.]runtime|three\b|d3\b)\b"
JS_BANNER = r"\/\*![\s\S]{0,300}(?:React|ReactDOM|jQuery|Lodash|Underscore|Angular|Vue\.js)\b"
JS_COPYRIGHT = r"Copyright\s.*(?:Facebook|Meta|jQuery Foundation|Google Inc)"
CSS_PACKAGE_FILE = r"\b(bootstrap|normalize|reset|tailwind|bulma|foundation|materialize|semantic[-.]ui|fontawesome|font-awesome|animate|slick|swiper|owl[-.]carousel|vendors?[-~.]|vendor[-.]|framework)\b"
CSS_BANNER = r"(?:Bootstrap|Normalize\.css|Tailwind|Font Awesome|Bulma)\s+v?\d"
CLASS_CALLS = (
    r"classList\s*\.\s*(?:add|remove|toggle|replace|contains)\s*\(\s*(['\"`])([^'\"`\n]+)\1",
    r"(?-i)\.className\s*\+?=\s*(['\"`])([^'\"`\n]+)\1",
    r"setAttribute\s*\(\s*['\"`]class(?:Name)?['\"`]\s*,\s*(['\"`])([^'\"`\n]+)\1",
    r"\.(?:addClass|removeClass|toggleClass)\s*\(\s*(['\"`])([^'\"`\n]+)\1",
    r"(?-i)\bclassName\s*=\s*(['\"`])([^'\"`\n]+)\1",
)
QUOTED_NAME = r"(?-i)['\"`](-?[a-zA-Z][a-zA-Z0-9_-]{3,})['\"`]"
CLASS_NAME = r"(?-i)\.(-?[a-zA-Z][a-zA-Z0-9_-]*)"


def file_name(url: Column) -> Column:
    return F.lower(F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), 1))


def is_package(kind: Column, url: Column, content: Column) -> Column:
    """Whether a script or style sheet is a package rather than the site's own."""
    js_head, css_head = F.substring(content, 1, 6000), F.substring(content, 1, 2000)
    marks = lambda head: count(head, r"\/\*!")
    js = has(file_name(url), JS_PACKAGE_FILE) | (marks(js_head) >= 3) | has(js_head, JS_BANNER) | (count(content, r"(?-i)\/\/ EXTERNAL MODULE:") >= 5) | has(js_head, JS_COPYRIGHT)
    css = has(file_name(url), CSS_PACKAGE_FILE) | has(css_head, CSS_BANNER) | (marks(css_head) >= 2)
    return F.when(kind == "js", js).otherwise(css)


def vendor_chars(content: str) -> int:
    """Characters of a bundle that belong to packages: modules under their path marks, else
    the stretches from one licence comment to the next, the last one the comment alone."""
    if '/***/ "./node_modules/' in content:
        marks = [(m.start(), "node_modules" in m[1]) for m in re.finditer(r"/\*\*\*/ \"(\./[^\"]+)\":", content)]
        ends = [at for at, _ in marks[1:]] + [len(content)]
        if total := sum(end - at for (at, vendor), end in zip(marks, ends) if vendor):
            return total
    spans = [m.span() for m in re.finditer(r"/\*!.*?\*/", content, re.S)]
    if not spans:
        return 0
    return spans[-1][1] - spans[0][0]


def at_rule_chars(css: str) -> int:
    """Characters of animations, fonts and statements that coverage never marks as used."""
    total = 0
    for m in re.finditer(r"@(?:-webkit-|-moz-|-o-)?keyframes\s+\S+\s*\{", css, re.I):
        depth = 1
        for b in re.finditer(r"[{}]", css[m.end() :]):
            depth += 1 if b[0] == "{" else -1
            if depth == 0:
                total += m.end() + b.end() - m.start()
                break
    total += sum(len(m[0]) for m in re.finditer(r"@font-face\s*\{[^}]*\}|@(?:charset|namespace)\b[^;]*;", css, re.I))
    return min(total, len(css))


@F.pandas_udf(T.IntegerType())
def _vendor(content: pd.Series) -> pd.Series:
    return content.map(lambda c: 0 if c is None else vendor_chars(c)).astype("int32")


@F.pandas_udf(T.IntegerType())
def _at_rules(content: pd.Series) -> pd.Series:
    return content.map(lambda c: 0 if c is None else at_rule_chars(c)).astype("int32")


def distinct_resources(resources: DataFrame) -> DataFrame:
    """One row per page, kind and address, kind in lower case; the last content in order wins.
    Rows without content or of another kind are left out."""
    rows = resources.withColumn("kind", F.lower("kind")).filter("content is not null and kind in ('js', 'css')")
    return rows.groupBy("page_id", "kind", "url").agg(F.max("content").alias("content"))


def resource_totals(resources: DataFrame) -> DataFrame:
    """``page_id, kind, n_files, n_packages, chars, app_chars`` of each page's files.

    Only scripts with a licence mark or a module mark can hold package code and pass
    through Python.
    """
    files = distinct_resources(resources).withColumn("package", is_package(F.col("kind"), F.col("url"), F.col("content")))
    size = units(F.col("content"))
    marked = (F.col("kind") == "js") & ~F.col("package") & (F.col("content").contains("/*!") | F.col("content").contains('/***/ "./node_modules/'))
    vendor = F.when(marked, _vendor(F.when(marked, F.col("content")))).otherwise(0)
    own = F.when(F.col("package"), 0).otherwise(F.greatest(F.lit(0), size - vendor))
    sized = files.select("page_id", "kind", "package", size.alias("chars"), own.alias("own"))
    return sized.groupBy("page_id", "kind").agg(F.count("*").alias("n_files"), F.count_if("package").alias("n_packages"), F.sum("chars").alias("chars"), F.sum("own").alias("app_chars"))


def css_classes(css: Column) -> Column:
    """Distinct class names of four characters or more that a style sheet mentions."""
    return F.filter(F.array_distinct(find_all(css, CLASS_NAME, 1)), lambda c: F.length(c) >= 4)


def dynamic_classes(js: Column) -> Column:
    """Distinct class names that a script sets through one of the usual calls."""
    raw = F.flatten(F.array(*[find_all(js, p, 2) for p in CLASS_CALLS]))
    parts = F.flatten(F.transform(raw, lambda r: F.split(r, r"[\s,]+")))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 4) & p.rlike(r"^-?[a-zA-Z][a-zA-Z0-9_-]*$")))


def covered(ranges: Column) -> Column:
    """Length of the union of ``array<struct<start, end>>``."""
    step = lambda s, r: F.struct(
        (s["used"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], s["last"]))).cast("int").alias("used"), F.greatest(s["last"], r["end"]).cast("int").alias("last")
    )
    return F.aggregate(F.array_sort(ranges), F.struct(F.lit(0).alias("used"), F.lit(-1).alias("last")), step, lambda s: s["used"])


def unused_scripts(coverage: DataFrame) -> DataFrame:
    """``page_id, url, total_chars, unused_chars, unused_pct`` of ``page_id, url, text, ranges<start, end, count>``."""
    ran = F.transform(F.filter("ranges", lambda r: r["count"] > 0), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    rows = coverage.filter(F.length("text") > 0).select("page_id", "url", units(F.col("text")).alias("total_chars"), covered(ran).alias("used"))
    return _shares(rows.withColumn("unused_chars", F.col("total_chars") - F.col("used")))


def _shares(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "url", "total_chars", "unused_chars", half_up(F.col("unused_chars") / F.col("total_chars") * 100).cast("int").alias("unused_pct"))


def unused_styles(coverage: DataFrame, scripts: DataFrame) -> DataFrame:
    """As ``unused_scripts`` for style sheets, with credit for rules that coverage misses and
    for classes that the page's scripts (``page_id, content``) set or mention."""
    called = each(scripts, dynamic_classes(F.col("content")), "c", "page_id", F.lit(True).alias("strong"))
    named = each(scripts, F.array_distinct(find_all(F.col("content"), QUOTED_NAME, 1)), "c", "page_id", F.lit(False).alias("strong"))
    known = called.unionByName(named).groupBy("page_id", "c").agg(F.max("strong").alias("strong"))
    sheets = coverage.filter(F.length("text") > 0).select("page_id", "url", units(F.col("text")).alias("total_chars"), covered(F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))).alias("used"), _at_rules("text").alias("ruled"), css_classes(F.col("text")).alias("names"))
    hits = each(sheets, F.col("names"), "c", "page_id", "url").join(known, ["page_id", "c"]).groupBy("page_id", "url").agg(F.count_if("strong").alias("n_set"), F.count_if(~F.col("strong")).alias("n_named"))
    joined = sheets.join(hits, ["page_id", "url"], "left").fillna(0, ["n_set", "n_named"])
    rest = F.greatest(F.lit(0), F.col("total_chars") - F.col("used") - F.col("ruled"))
    names = F.greatest(F.size("names"), F.lit(1))
    credit = half_up(rest * F.least(F.lit(0.85), F.col("n_set") / names + F.col("n_named") / names * 0.3))
    used = F.least(F.col("total_chars"), F.col("used") + F.col("ruled") + credit)
    return _shares(joined.withColumn("unused_chars", (F.col("total_chars") - used).cast("int")))


def named_files(html: Column, domain: str) -> tuple[Column, Column]:
    """The distinct addresses of a domain's scripts and style sheets that a page names."""
    d = re.escape(domain)
    src = rf"<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']*{d}[^\"']*)[\"']"
    href = rf"<link(?=\s)(?=[^>]*\brel\s*=\s*[\"']stylesheet[\"'])[^>]*\bhref\s*=\s*[\"']([^\"']*{d}[^\"']*)[\"']"
    return F.array_distinct(find_all(html, src, 1)), F.array_distinct(find_all(html, href, 1))


def referenced_files(pages: DataFrame, domain: str) -> DataFrame:
    """``page_id, kind, url`` of the scripts and style sheets of a domain that the html names."""
    scripts, sheets = named_files(F.col("html"), domain)
    js = F.transform(scripts, lambda u: F.struct(F.lit("js").alias("kind"), u.alias("url")))
    css = F.transform(sheets, lambda u: F.struct(F.lit("css").alias("kind"), u.alias("url")))
    return each(pages.filter("html is not null"), F.concat(js, css), "f", "page_id").select("page_id", "f.*")


def with_fallback(captured: DataFrame, referenced: DataFrame) -> DataFrame:
    """``page_id, kind, url, content``: the captured resources, and for pages without any those
    that their html names, as captured elsewhere.

    ``captured`` are distinct resources; ``referenced`` has ``page_id, kind, url``. What no
    page captured is left out.
    """
    columns = ["page_id", "kind", "url", "content"]
    elsewhere = captured.groupBy("kind", "url").agg(F.max("content").alias("content"))
    bare = referenced.join(captured.select("page_id").distinct(), "page_id", "left_anti").distinct()
    return captured.select(*columns).unionByName(bare.join(elsewhere, ["kind", "url"]).select(*columns))
