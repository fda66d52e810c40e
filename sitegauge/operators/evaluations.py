"""Findings that an external evaluator made: checked against page facts, filtered, merged."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.patterns import java
from sitegauge.functions.text import INERT, blank, count, each, find_all, first, half_up, has
from sitegauge.operators.metrics import page_metrics
from sitegauge.operators.resources import named_files
from sitegauge.operators.rules import ALLOWED_CHILDREN, P, child_violations, open_tag, parent_span
from sitegauge.operators.views import file_label

# What is out of scope, and the words that claim something missing or doubled.
SCOPE = {
    "sharing_tags": r"\bopen\s*graph\b|\bog:[a-z_-]+",
    "letter_case": r"\b(?:upper[\s-]?case|lower[\s-]?case|capitaliz(?:e|ation)|all[\s-]caps|title[\s-]case|mixed[\s-]case|casing)\b",
    "beyond_chunk": r"\b(?:duplicate\s+id(?:s|\b)|duplicate\s+attribute(?:s|\b)|skip[\s-]link|skipnav|skip[\s-]to[\s-](?:main|content))\b",
    "structured_data": r"\b(?:json[\s-]?ld|structured\s+data|schema(?:\.org)?(?:\s+markup)?|rich\s+(?:snippet|result))\b",
    "opener": r"\b(?:noopener|noreferrer|rel\s*=\s*[\"']?(?:noopener|noreferrer)|opener)\b",
    "page_meta": r"\b(?:meta\s+(?:title|description|desc)|<title\b|title\s+tag|title\s+(?:length|too\s+(?:long|short)|missing|absent)|meta\s+desc(?:ription)?|canonical\s+(?:tag|url|link)|<link[^>]*rel\s*=\s*[\"']?canonical|robots\s+(?:meta|tag|directive)|meta\s+robots|noindex|nofollow)\b",
    "language": r"\b(?:html\s*\[\s*lang\s*\]|lang\s*=\s*[\"']|lang\s+attribute|language\s+attribute|missing\s+lang|incorrect\s+lang|wrong\s+lang|page\s+language|document\s+language)\b",
}
VAGUE = r"^(?:consider\s+(?:add|using|implement)|you\s+(?:may|might|should)\s+consider|it\s+(?:may|might|would)\s+be\s+(?:helpful|beneficial|good|better)\s+to\s+(?:add|use|include))"
NESTING = r"\b(?:deep(?:ly)?\s+nest(?:ed|ing)?|wrapper\s+(?:nesting|bloat|div)|redundant\s+(?:div|wrapper)|unnecessary\s+(?:div|nesting|wrapper)|excessive\s+(?:nesting|use\s+of\s+<?\s*div|div)|div\s+soup|use\s+of\s+<?\s*div\b)\b"
ROOT = r"\bid\s*=\s*[\"']root[\"']"
LIST_ORDER = r"\b(?:dt\b.*\b(?:must|should|needs?\s+to)\s+be\s+(?:directly\s+)?followed\s+by\b.*\bdd|\bdt\b.*\b(?:before|precede[sd]?)\b.*\bdd\b|\bdt\b.*(?:not\s+)?paired\s+with.*\bdd|\bdt\b.*(?:without|missing|no)\s+(?:a\s+|corresponding\s+)?dd|\bmissing\s+<dd\s+for|\bunpaired\s+<dt|\bdt\s+element[^.]*\bmust\s+be\s+followed)\b"
ABOUT_H1 = r"(\bh1\b|<h1|h1\s+(?:tag|element|heading))"
ABOUT_MAIN = r"(<main\b|\bmain\s+(?:landmark|tag|element|content|region)\b)"
MISSING = r"\b(?:missing|absent|lack(?:ing|s)?|without|no|none)\b"
DOUBLED = r"\b(?:multiple|duplicate|several|more\s+than\s+one|two\s+or\s+more)\b"
WRAP_TARGETS = ("article", "section", "main", "header", "footer", "nav", "aside", "figure")
VOID_IN_WALK = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "param", "source", "track", "wbr"))
CAPS = {"semantic": 120, "w3c": 80, "accessibility": 60, "seo": 40, "llm_friendly": 40}
REFUND = 4


def valid_findings(findings: DataFrame) -> DataFrame:
    """Rows that meet the schema: a known severity, texts that are not empty, a score of 0 to 100."""
    texts = [F.length(c) > 0 for c in ("issue", "recommendation", "html_snippet")]
    good = F.col("severity").isin("error", "warning", "info") & F.col("score").between(0, 100)
    for t in texts:
        good &= t
    return findings.filter(good)


def page_facts(pages: DataFrame) -> DataFrame:
    """``page_id, html_bytes, h1_count, main_count, has_root``; a page without html has no heading, main or root."""
    html = F.coalesce("html", F.lit(""))
    structure = F.col("_s")
    rows = pages.select("page_id", "html", blank(html, INERT).alias("_s"))
    return rows.select("page_id", F.octet_length(html).alias("html_bytes"), count(structure, open_tag("h1")).alias("h1_count"), count(structure, open_tag("main")).alias("main_count"), has(html, rf"<div\b[^>]*{ROOT}").alias("has_root"))


def evaluator_facts(pages: DataFrame, domain: str) -> DataFrame:
    """What an evaluator is told of every page, in one scan: ``page_facts``, its metrics, and the
    sorted names of its domain's ``js_files`` and ``css_files``. A page without html has zeros."""
    html = F.coalesce("html", F.lit(""))
    names = lambda urls: F.array_sort(F.array_distinct(F.transform(urls, file_label)))
    scripts, sheets = named_files(F.col("html"), domain)
    more = [has(F.col("html"), rf"<div\b[^>]*{ROOT}").alias("has_root"), names(scripts).alias("js_files"), names(sheets).alias("css_files"), blank(F.col("html"), INERT).alias("_s")]
    rows = page_metrics(pages.select("page_id", html.alias("html")), domain, *more)
    counts = [count(F.col("_s"), open_tag(t)).alias(f"{t}_count") for t in ("h1", "main")]
    return rows.select("page_id", "html_bytes", *counts, "has_root", "html_to_text_ratio", "inline_css_chars", "css_ext_count", "css_inline_count", "css_to_text_ratio", "js_files", "css_files")


def _first_list_tag_is_term(text: Column, snippet: Column) -> Column:
    """Every definition has a term before it exactly if the first of both tags is a term."""
    low = F.lower(text)
    tag = F.lower(first(snippet, r"<(dt|dd)\b", 1))
    return (low.contains("dt") | low.contains("dd")) & (tag == "dt")


def _children_are_fine(text: Column, snippet: Column) -> Column:
    """The text names a parent whose first element in the snippet has only allowed children."""
    claims = []
    for parent, allowed in ALLOWED_CHILDREN.items():
        # the walk is for the few findings that show the parent and name it: conjunctions end at the first no
        claims.append(has(snippet, parent_span(parent)) & has(text, rf"\b{parent}\b") & (F.size(_bad_children(first(snippet, parent_span(parent), 1), allowed)) == 0))
    out = claims[0]
    for c in claims[1:]:
        out |= c
    return out


def _bad_children(inner: Column, allowed: tuple[str, ...]) -> Column:
    def step(state: Column, tag: Column) -> Column:
        name = F.lower(first(tag, P["tag_name"], 1))
        closing = tag.startswith("</")
        bad = ~closing & (state["depth"] == 0) & ~name.isin(*allowed)
        depth = F.when(closing, F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"] + F.when(tag.endswith("/>"), 0).otherwise(1))
        return F.struct(depth.cast("int").alias("depth"), F.when(bad, F.concat(state["bad"], F.array(name))).otherwise(state["bad"]).alias("bad"))

    begin = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("bad"))
    return F.aggregate(find_all(inner, P["tag"]), begin, step, lambda s: s["bad"])


def drop_reason(findings: DataFrame, facts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Adds ``drop_reason``, null for findings that stand. Facts of unknown pages count as none.

    With ``pages``, findings that propose what the page already has are dropped as well,
    where nothing else drops them."""
    subject = F.concat_ws(" ", F.col("issue"), F.coalesce("recommendation", F.lit("")))
    issue = F.col("issue")
    rows = findings.withColumns({"_subject": subject, "_snippet": F.coalesce("html_snippet", F.lit(""))})
    subject, snippet = F.col("_subject"), F.col("_snippet")
    checks = [(name, has(subject, p)) for name, p in SCOPE.items()]
    checks += [
        ("vague", has(issue, VAGUE)),
        ("children_fine", _children_are_fine(subject, snippet)),
        ("list_order", has(subject, LIST_ORDER) | _first_list_tag_is_term(subject, snippet)),
        ("root_nesting", has(subject, NESTING) & has(snippet, ROOT)),
    ]
    # all patterns are tried before the facts are joined, where the rows lie as they were read
    h1, main, missing, doubled = (has(issue, p) for p in (ABOUT_H1, ABOUT_MAIN, MISSING, DOUBLED))
    rows = rows.withColumns({"_reason": F.coalesce(*[F.when(c, F.lit(name)) for name, c in checks]), "_h1_missing": h1 & missing, "_h1_doubled": h1 & doubled, "_main_missing": main & missing, "_main_doubled": main & doubled})
    n_h1, n_main = F.coalesce("h1_count", F.lit(0)), F.coalesce("main_count", F.lit(0))
    by_facts = [
        ("h1_present", F.col("_h1_missing") & ((n_h1 >= 1) | F.coalesce("has_root", F.lit(False)))),
        ("h1_single", F.col("_h1_doubled") & (n_h1 <= 1)),
        ("main_present", F.col("_main_missing") & (n_main >= 1)),
        ("main_single", F.col("_main_doubled") & (n_main <= 1)),
    ]
    reason = F.coalesce(F.col("_reason"), *[F.when(c, F.lit(name)) for name, c in by_facts])
    judged = rows.join(facts.drop("html_bytes"), "page_id", "left").withColumn("drop_reason", reason).select(*findings.columns, "drop_reason")
    if pages is None:
        return judged
    had = satisfied_suggestions(findings, pages).distinct().withColumn("_had", F.lit("already_there"))
    return judged.join(had, "issue_id", "left").withColumn("drop_reason", F.coalesce("drop_reason", "_had")).drop("_had")


def suggested_wrappers(text: Column) -> Column:
    """The elements that a text proposes to wrap something in."""
    def proposed(tag: str) -> Column:
        return has(text, rf"(?:<{tag}\b)|(?:wrap[a-z]*\s+(?:in|with|inside)\s+(?:an?\s+)?<?{tag}\b)|(?:use\s+(?:an?\s+)?<?{tag}\b)|(?:replace[\s\S]{{0,60}}with\s+<?{tag}\b)")

    # every form holds the name of the element, which is the cheaper test
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.when(F.contains(low, F.lit(t)), proposed(t)).otherwise(F.lit(False)), F.lit(t)) for t in WRAP_TARGETS]), lambda t: t.isNotNull())


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)(?![A-Za-z0-9_])([^>]*)>")


def _attribute(attributes: str, name: str) -> str | None:
    m = re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}\s*=\s*[\"']([^\"']+)[\"']", attributes, re.I)
    return m[1] if m else None


def _located(page: str, snippet: str, most: int = 32) -> list[tuple[int, str]]:
    """``(position, tag)`` of the places a snippet may stand for: its literal text, else
    elements that share an identifier, all classes of one list, or a data attribute."""
    tag = re.search(r"<([a-zA-Z][a-zA-Z0-9-]*)", snippet)
    literal = [(m.start(), tag[1].lower() if tag else "") for m in re.finditer(f"(?={re.escape(snippet)})", page)][:most]
    if literal:
        return literal
    quoted = r"\s*=\s*[\"']([^\"']+)[\"']"
    ids = {i.strip().lower() for i in re.findall(rf"(?<![A-Za-z0-9_])id{quoted}", snippet, re.I)} - {""}
    lists = [set(c.split()) for c in re.findall(rf"(?<![A-Za-z0-9_])class{quoted}", snippet, re.I) if c.split()]
    data = {(n.lower(), v.lower()) for n, v in re.findall(rf"(?<![A-Za-z0-9_])(data-[a-zA-Z0-9-]+){quoted}", snippet, re.I)}
    found = []
    for m in _TAG.finditer(page):
        if m[1]:
            continue
        classes = set((_attribute(m[3], "class") or "").split())
        if (_attribute(m[3], "id") or "").lower() in ids or any(c <= classes for c in lists) or any((_attribute(m[3], n) or "").lower() == v for n, v in data):
            found.append((m.start(), m[2].lower()))
            if len(found) == most:
                break
    return found


def already_wrapped(page: str | None, snippet: str | None, wanted: list[str] | None) -> bool:
    """Whether every place of the snippet is, or lies within, an element that is proposed."""
    if not page or not snippet or wanted is None or not len(wanted):
        return False
    places = _located(page, snippet)
    if not places:
        return False
    open_: dict[str, int] = {}
    todo = sorted(places)
    for m in _TAG.finditer(page):
        while todo and m.start() >= todo[0][0]:
            if todo[0][1] not in wanted and not any(open_.get(w, 0) > 0 for w in wanted):
                return False
            todo.pop(0)
        if not todo:
            break
        name = m[2].lower()
        if not m[3].endswith("/") and name not in VOID_IN_WALK:
            open_[name] = open_.get(name, 0) + (-1 if m[1] else 1)
    return all(t in wanted or any(open_.get(w, 0) > 0 for w in wanted) for _, t in todo)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _wrapped(page: pd.Series, asked: pd.Series) -> pd.Series:
    return pd.Series([[a["issue_id"] for a in some if already_wrapped(p, a["html_snippet"], list(a["_w"]))] for p, some in zip(page, asked)])


def satisfied_suggestions(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """``issue_id`` of findings that propose what the page already has.

    Only findings that propose a wrapper and show a snippet meet their page, all of a
    page together, so that its text travels once; a page with very many is dealt to sixteen.
    """
    text = F.concat_ws(" ", "issue", F.coalesce("recommendation", F.lit("")))
    asking = findings.filter(F.length("html_snippet") > 0).withColumn("_t", text).withColumn("_w", suggested_wrappers(F.col("_t"))).filter((F.size("_w") > 0) & (F.length("html_snippet") > 0))
    part = F.pmod(F.xxhash64("issue_id"), F.lit(16))
    of_page = asking.groupBy("page_id", part.alias("_part")).agg(F.collect_list(F.struct(F.col("issue_id").cast("bigint").alias("issue_id"), "html_snippet", "_w")).alias("_a"))
    joined = of_page.join(pages.filter("html is not null").select("page_id", "html"), "page_id")
    return joined.select(F.explode(_wrapped("html", "_a")).alias("issue_id"))


def merge_key() -> Column:
    """What makes two findings of a criterion the same: severity, and text with snippet or the head of the text."""
    snippet = F.coalesce(F.substring(F.regexp_replace("html_snippet", java(r"\s+"), " "), 1, 120), F.lit(""))
    strict = F.concat_ws("|", "severity", "issue", snippet)
    head = F.substring(F.regexp_replace(F.lower("issue"), java(r"^\s+|\s+$"), ""), 1, 100)
    return F.when(F.col("criterion").isin("semantic", "w3c"), strict).otherwise(F.concat_ws("|", "severity", head))


def merged_findings(findings: DataFrame) -> DataFrame:
    """Findings of all chunks with ``rank`` in their page and criterion: the first of each key,
    in order of chunk and place, up to the criterion's cap. Null criteria are capped like the others."""
    order = [F.col("chunk"), F.col("ord"), F.col("issue_id")]
    keyed = findings.withColumn("_key", merge_key())
    best = keyed.groupBy("page_id", "criterion", "_key").agg(F.min(F.struct(*order)).alias("_first"))
    kept = best.select("page_id", "criterion", F.col("_first.chunk").alias("chunk"), F.col("_first.ord").alias("ord"), F.col("_first.issue_id").alias("issue_id"))
    rank = F.row_number().over(Window.partitionBy("page_id", "criterion").orderBy(*order))
    caps = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    # the constant bound lets every task keep only so many rows of a page before the shuffle
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= max(CAPS.values()))
    return ranked.filter(F.col("rank") <= F.coalesce(F.element_at(caps, F.col("criterion")), F.lit(40)))


def merged_scores(findings: DataFrame) -> DataFrame:
    """``page_id, criterion, n_kept, n_dropped, score`` from rows with ``drop_reason``.

    A chunk's score is that of its first valid finding; the mean is rounded; where all
    findings were dropped, four points each are given back, up to 100. Scores out of
    range or null are ignored; without any the score is null.
    """
    order = F.struct("ord", "issue_id")
    chunk = findings.groupBy("page_id", "criterion", "chunk").agg(
        F.min_by(F.when(F.col("score").between(0, 100), F.col("score")), F.when(F.col("score").between(0, 100), order)).alias("score"),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"),
        F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"),
    )
    merged = chunk.groupBy("page_id", "criterion").agg(F.sum("kept").alias("n_kept"), F.sum("dropped").alias("n_dropped"), F.avg("score").alias("_mean"))
    mean = half_up(F.col("_mean")).cast("int")
    score = F.when((F.col("n_dropped") > 0) & (F.col("n_kept") == 0), F.least(F.lit(100), mean + REFUND * F.col("n_dropped"))).otherwise(mean)
    return merged.select("page_id", "criterion", "n_kept", "n_dropped", score.cast("int").alias("score"))


def final_scores(merged: DataFrame, pages: DataFrame, violations: DataFrame) -> DataFrame:
    """``page_id, criterion, score`` for every page with html and every criterion.

    Two points go for each forbidden child element (rows of ``page_id``) from the semantic
    score, down to 0; a criterion that no evaluator scored has 0.
    """
    every = each(pages.filter("html is not null"), F.array(*map(F.lit, CAPS)), "criterion", "page_id")
    counted = violations.groupBy("page_id").agg(F.count("*").alias("_v"))
    joined = every.join(merged.select("page_id", "criterion", "score"), ["page_id", "criterion"], "left").join(counted, "page_id", "left")
    lost = F.when(F.col("criterion") == "semantic", 2 * F.coalesce("_v", F.lit(0))).otherwise(0)
    return joined.select("page_id", "criterion", F.greatest(F.lit(0), F.coalesce("score", F.lit(0)) - lost).cast("int").alias("score"))


#: What a report says where no evaluation came through, and of forbidden child elements.
NO_EVALUATION = ("the page could not be evaluated", "Run the evaluation again.", "<html>…</html>")
CHILD_ADVICE = "Move the element to where the content model allows it."


def merged_report(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, criterion, rank, origin, severity, issue, recommendation, html_snippet``: the
    report of every page with html, from rows with ``drop_reason``.

    Forbidden child elements (``rules``) that the evaluator did not name go before its
    findings in the semantic area, the last one first, beyond the cap if need be. A page
    without any finding of the evaluator gets one error per area instead (``none``).
    """
    standing = findings.filter("drop_reason is null")
    kept = merged_findings(standing).join(standing.select("issue_id", "severity", "issue", "recommendation", "html_snippet"), "issue_id")
    columns = ["page_id", "criterion", "severity", "issue", "recommendation", "html_snippet"]
    model = kept.select(*columns, F.lit("model").alias("origin"), F.col("rank").alias("place"))
    known = pages.filter("html is not null").select("page_id", "html")
    found = known.select("page_id", F.posexplode_outer(child_violations(F.col("html"))).alias("k", "v")).filter("v is not null")
    says = F.format_string("element not allowed as direct child: %s in %s", "v.child", "v.parent")
    own = found.select("page_id", F.lit("semantic").alias("criterion"), F.lit("error").alias("severity"), says.alias("issue"), F.lit(CHILD_ADVICE).alias("recommendation"), F.col("v.span").alias("html_snippet"), F.lit("rules").alias("origin"), (-F.col("k") - 1).alias("place"))
    named = model.filter("criterion = 'semantic'").select("page_id", merge_key().alias("_key")).distinct()
    own = own.withColumn("_key", merge_key()).join(named, ["page_id", "_key"], "left_anti").drop("_key")
    seen = findings.select("page_id").distinct()
    silent = each(known.join(seen, "page_id", "left_anti"), F.array(*map(F.lit, CAPS)), "criterion", "page_id")
    none = silent.select("page_id", "criterion", F.lit("error").alias("severity"), *[F.lit(t).alias(n) for t, n in zip(NO_EVALUATION, columns[3:])], F.lit("none").alias("origin"), F.lit(1).alias("place"))
    rows = model.join(known.select("page_id"), "page_id").unionByName(own.join(seen, "page_id", "left_semi")).unionByName(none)
    # at most the caps and a page's own violations share a page and an area
    rank = F.row_number().over(Window.partitionBy("page_id", "criterion").orderBy("place"))
    return rows.withColumn("rank", rank).select("page_id", "criterion", "rank", "origin", *columns[2:])


def doc_size(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, size, recommendation`` of every page with html: its bytes, and the first advice on
    size that is not blank, of ``page_id, chunk, recommendation``, in the order of the chunks."""
    told = chunks.filter(F.length(F.regexp_replace("recommendation", java(r"^\s+|\s+$"), "")) > 0)
    first_told = told.groupBy("page_id").agg(F.min_by("recommendation", "chunk").alias("recommendation"))
    return pages.filter("html is not null").select("page_id", F.octet_length("html").alias("size")).join(first_told, "page_id", "left")


def fix_queue(findings: DataFrame, most: int = 20, shortest: int = 6) -> DataFrame:
    """``page_id, issue_id, rank``: the findings of a page to look at first, by criterion and
    place, those with too short a snippet left out."""
    place = F.array_position(F.array(*map(F.lit, ("llm_friendly", "w3c", "seo", "semantic", "accessibility"))), F.col("criterion"))
    kept = findings.filter(F.length(F.regexp_replace("html_snippet", java(r"^\s+|\s+$"), "")) >= shortest)
    order = Window.partitionBy("page_id").orderBy(place, "chunk", "ord", "issue_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("page_id", "issue_id", "rank")
